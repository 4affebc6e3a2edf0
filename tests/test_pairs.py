"""Blocks of queries and items against a row a pair."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pairs
from corpusloom.operators import retrieval as r
from corpusloom.operators.sparse import sparse_search, sparse_search_packed, top_k

VECTORS = "id long, tenant_id string, embedding array<float>"


def _vectors(rng, n, start, tenants):
    """Many copies and near copies; some vectors are null, empty, zero, of another length, or hold nulls and what is no number."""
    odd = [None, [], [0.0] * 6, [1.0, 2.0], [1.0, None, 0.0, 0.0, 0.0, 1.0], [float("nan")] * 6]
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(n):
        v = rng.choice(odd) if rng.random() < 0.15 else [x + (rng.random() < 0.2) * 1e-7 for x in rng.choice(base)] if rng.random() < 0.6 else [rng.gauss(0, 1) for _ in range(6)]
        rows.append((start + i, tenants[0] if rng.random() < 0.4 else rng.choice(tenants), v))
    return rows


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_dense_search_equals_a_row_a_pair(spark, k):
    rng = random.Random(k)
    p = spark.createDataFrame(_vectors(rng, 300, 0, ["a", "b", "", None]), VECTORS).withColumnRenamed("id", "doc_id")
    q = spark.createDataFrame(_vectors(rng, 60, 1000, ["a", "b", "", None, "none"]), VECTORS).withColumnRenamed("id", "query_id")
    unit = lambda rows, key: rows.select(key, "tenant_id", r.unit(F.col("embedding")).alias("_v"))
    both = unit(q.where("tenant_id <> ''"), "query_id").join(unit(p, "doc_id").withColumnRenamed("_v", "_p"), "tenant_id")
    want = top_k(both.select("query_id", "doc_id", F.round(r.dot(F.col("_v"), F.col("_p")), 6).alias("score")), "query_id", "doc_id", k)
    blocks = pairs.best(unit(q.where("tenant_id <> ''"), "query_id"), unit(p, "doc_id"), "query_id", "doc_id", ("tenant_id",), k, pairs.by_dot, 16, 5)
    small = top_k(blocks.withColumn("score", F.round("score", 6)), "query_id", "doc_id", k)
    rows = lambda found: sorted(map(repr, found.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(want) == rows(r.dense_search(q, p, k)) == rows(small) and want.count() > 30


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_packed_sparse_search_equals_a_row_a_slot(spark, k):
    rng = random.Random(k)

    def postings(n, start, tenants):
        sets = [{0} | {int(rng.paretovariate(0.7)) % 400 for _ in range(rng.choice([1, 2, 5, 40]))} for _ in range(n // 3)]
        return [(start + i, tenant, s, 1.0 + s % 3) for i in range(n) for tenant in [rng.choice(tenants)] for s in sets[i % len(sets)] | ({i} if i % 2 else set())]

    p = spark.createDataFrame(postings(200, 0, ["a", "b", "", None]), "doc_id long, tenant_id string, idx int, weight double")
    q = spark.createDataFrame(postings(20, 5000, ["a", "b", "", "none"]), "query_id long, tenant_id string, idx int, weight double")
    pack = lambda rows, key: rows.groupBy(key, "tenant_id").agg(F.collect_list(F.struct("idx", "weight")).alias("s")).select(key, "tenant_id", F.col("s.idx").alias("slots"), F.col("s.weight").alias("weights"))
    rows = lambda found: sorted(tuple(x) for x in found.select("query_id", "doc_id", "score", "rank").collect())
    assert rows(sparse_search_packed(pack(q, "query_id"), pack(p, "doc_id"), k)) == rows(sparse_search(q, p, k))


def test_blocks_return_few_rows(spark):
    """A third of all items are copies of what is asked: a row a pair was 60,000 rows."""
    p = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("tenant_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.rand(1), F.rand(2))).alias("v"))
    q = p.where("doc_id % 150 = 0").withColumnRenamed("doc_id", "query_id")
    found = pairs.best(q, p, "query_id", "doc_id", ("tenant_id",), 4, pairs.by_dot, 500)
    assert 20 * 4 <= found.count() <= 20 * 4 * 6 * 2
    assert [x["doc_id"] for x in top_k(found, "query_id", "doc_id", 4).where("query_id = 150").orderBy("rank").collect()] == [0, 3, 6, 9]


def test_top_keeps_what_rounds_alike():
    scores = np.array([1.0, 0.5000001, 0.5000002, 0.5, 0.5, 0.5, 0.1])
    assert sorted(pairs.top(scores, np.array([9, 8, 7, 6, 5, 4, 3]), 2)) == [0, 1, 2, 4, 5]


def test_no_join_makes_a_row_a_pair(spark, tiny):
    from corpusloom.plans import retrieval as plans

    for query in (plans.dense_topk, plans.rrf_multi_query, plans.rrf_fusion, plans.hybrid_retrieve, plans.prompt_context):
        plan = query(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan
        assert not [line for line in plan.split("\n") if "Join Inner" in line and "idx" in line]
