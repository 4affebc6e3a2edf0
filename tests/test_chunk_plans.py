"""Chunks are made by one fold a file: no filter that Spark derives makes them again."""

from __future__ import annotations

import pytest

from corpusloom import catalog
from corpusloom.operators import chunking as ch


@pytest.mark.parametrize("name", ["chunk_fixed", "chunk_children", "chunk_parents", "chunk_routed", "parent_expand", "section_assign", "parents_insert_new", "similar_with_parents"])
def test_no_filter_folds(spark, tiny, name):
    plan = catalog.QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not [f for f in filters if "aggregate(" in f]


def test_file_without_pieces_has_no_chunk(spark):
    rows = spark.createDataFrame([("a", "h", []), ("b", "i", [("x y", 1, 2)])], "file_name string, file_hash string, pieces array<struct<s:string,page:int,n:int>>")
    assert [r["file_name"] for r in ch.chunk_fixed(rows).collect()] == ["b"]
    assert [r["file_name"] for r in ch.chunk_children(ch.parents_of(rows)).collect()] == ["b"]
