"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from corpusloom import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, tiny, name):
    _, differs = compare(catalog.QUERIES[name](spark, tiny), catalog.ORACLE_SQL[name], tiny)
    assert not differs, differs


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).take(1)) == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"html_text", "chunk_fixed_tokens", "chunk_children_tokens"}


def test_html_parser_on_whole_pages(spark, tiny):
    """Each page once, no error, and the text of the paragraphs that the patterns find too."""
    rows = catalog.QUERIES["html_text"](spark, tiny).collect()
    assert len(rows) == spark.read.parquet(f"{tiny}/pages.parquet").count()
    assert all(r["error"] is None and r["n_chars"] > 0 for r in rows)
