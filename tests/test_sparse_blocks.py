"""Sparse search over blocks of postings against the search that reads all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.sparse import block_bounds, block_maxima, block_postings, sparse_search, sparse_search_blocks


def postings(rng, docs, tenants, start=0):
    """Slot 0 is in every document; lengths differ much; a third of all documents belongs to one tenant."""
    rows = []
    for i in range(docs):
        tenant = tenants[0] if i % 3 == 0 else rng.choice(tenants)
        slots = {0} | {int(rng.paretovariate(0.7)) % 400 for _ in range(rng.choice([1, 2, 5, 40, 300]))}
        rows += [(start + i, tenant, s, 1.0 + round(rng.random() * 3, 2)) for s in slots]
    return rows


@pytest.mark.parametrize(("k", "block", "first"), [(5, 7, 2), (1, 3, 1), (50, 10, 3), (1000, 16, 2)])
def test_equals_brute_force(spark, k, block, first):
    rng = random.Random(k)
    tenants = ["a", "b", "", None]
    p = spark.createDataFrame(postings(rng, 300, tenants), "doc_id long, tenant_id string, idx int, weight double")
    q = spark.createDataFrame(postings(rng, 12, ["a", "b", "", "none"], 5000), "query_id long, tenant_id string, idx int, weight double")
    dealt = block_postings(p, block_items=block).cache()
    want = sorted(map(tuple, sparse_search(q, p, k).select("query_id", "doc_id", "score", "rank").collect()))
    got = sorted(map(tuple, sparse_search_blocks(q, dealt, block_maxima(dealt), k, first=first).select("query_id", "doc_id", "score", "rank").collect()))
    assert got == want and got
    dealt.unpersist()


def test_blocks_split_a_common_slot_and_bounds_hold(spark):
    rng = random.Random(1)
    p = spark.createDataFrame(postings(rng, 400, ["a", "b"]), "doc_id long, tenant_id string, idx int, weight double")
    q = spark.createDataFrame(postings(rng, 6, ["a"], 5000), "query_id long, tenant_id string, idx int, q_weight double")
    dealt = block_postings(p, block_items=10).cache()
    assert dealt.where("idx = 0").groupBy("tenant_id", "size", "part").count().agg(F.max("count")).first()[0] <= 40
    assert dealt.count() == p.count()
    bounds = block_bounds(q, block_maxima(dealt))
    scored = q.join(dealt, ["tenant_id", "idx"]).groupBy("query_id", "doc_id", "tenant_id", "size", "part").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("s"))
    worst = scored.join(bounds, ["query_id", "tenant_id", "size", "part"], "left").agg(F.max(F.col("s") - F.col("bound")), F.count(F.when(F.col("bound").isNull(), 1))).first()
    assert worst[0] <= 1e-9 and worst[1] == 0
    # Short documents cannot hold many terms of a long query, so their blocks promise less.
    least = bounds.groupBy("size").agg(F.max("bound").alias("b")).orderBy("size").collect()
    assert least[0]["b"] < least[-1]["b"]
    dealt.unpersist()


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, tenant_id string, idx int, weight double")
    q = spark.createDataFrame([(1, "a", 0, 1.0)], "query_id long, tenant_id string, idx int, weight double")
    dealt = block_postings(none)
    assert sparse_search_blocks(q, dealt, block_maxima(dealt), 3).count() == 0
