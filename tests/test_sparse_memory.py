"""Sparse vectors are counted item by item."""

from __future__ import annotations

import math

from corpusloom.operators.sparse import sparse_vectors


def test_no_aggregate_over_terms(spark, tiny):
    from corpusloom.plans import views as v

    plan = sparse_vectors(v.pages(spark, tiny), "doc_id", "tenant_id")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.split("\n")]
    grouped = [line for line in lines if line.startswith("Aggregate")]
    assert len(grouped) == 1 and "collect_list" in grouped[0]
    assert not [line for line in lines if line.startswith("Filter") and "array_sort" in line]


def test_counts_by_key_over_rows_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, "beta alpha beta"), (1, "alpha beta gamma"), (2, None), (3, ""), (4, "the a")], "k int, text string")
    got = {}
    for r in sparse_vectors(rows, "k").collect():
        got.setdefault(r["k"], []).append(round(r["weight"], 9))
    assert {k: sorted(x) for k, x in got.items()} == {1: sorted(round(1 + math.log(n), 9) for n in (1, 2, 3))}
