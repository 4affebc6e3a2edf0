"""Each PDF file is parsed once."""

from __future__ import annotations

from corpusloom.plans import sources


def test_pdf_columns_reads_stored_elements(spark, tiny):
    plan = sources.pdf_columns(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Relation [path" in plan
