"""The question flow, its ledgers and the cache join."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as r
from corpusloom.operators.flow import EMPTY_ERROR, Flow
from corpusloom.storage import Ledger, new_folder

QUESTION = "query_id long, tenant_id string, question string, asked_at long, embedding array<double>"


def vector(rng, n=6):
    return [rng.gauss(0, 1) for _ in range(n)]


def brute_hits(queries, cache, similarity, ttl):
    out = {}
    for qid, tenant, source, at, q in queries:
        best = None
        for cid, t, created, c in cache:
            if not tenant or t != tenant or source in ("sql", "hybrid") or not q or not c or not at - ttl <= created <= at:
                continue
            size = sum(x * x for x in q) ** 0.5 * sum(x * x for x in c) ** 0.5
            score = round(sum(x * y for x, y in zip(q, c, strict=True)) / size, 6) if size else 0.0
            if score >= similarity and (best is None or (-score, cid) < best):
                best = (-score, cid)
        if best:
            out[qid] = best[1]
    return out


@pytest.mark.parametrize(("similarity", "ttl", "axis"), [(0.92, 50, 0), (0.5, 20, 3), (0.0, 30, 1), (1.0, 100, 0)])
def test_cache_hits_equal_all_pairs(spark, similarity, ttl, axis):
    """Times at the very bounds of a life, negative times, vectors that are empty, missing or zero, equal vectors, no tenant."""
    rng = random.Random(5)
    pool = [vector(rng) for _ in range(12)] + [[0.0] * 6, [], None]
    near = lambda x: [y + rng.gauss(0, 0.05) for y in x] if x else x
    cache = [(i, rng.choice(["a", "b", "", None]), rng.randrange(-120, 200), near(rng.choice(pool))) for i in range(300)]
    queries = [(1000 + i, rng.choice(["a", "b", "", None]), rng.choice(["rag", "rag", "sql"]), rng.randrange(-100, 260), near(rng.choice(pool))) for i in range(150)]
    queries += [(2000 + i, c[1], "rag", c[2] + k, c[3]) for i, (c, k) in enumerate((c, k) for c in cache[:40] for k in (0, ttl, ttl + 1, -1))]
    q = spark.createDataFrame(queries, "query_id long, tenant_id string, data_source string, asked_at long, embedding array<double>")
    c = spark.createDataFrame(cache, "cache_id long, tenant_id string, created_at long, embedding array<double>")
    got = {x["query_id"]: x["cache_id"] for x in r.cache_hits(q, c, similarity, ttl, axis).collect()}
    assert got == brute_hits(queries, cache, similarity, ttl) and got


def test_pairs_grow_with_the_rows(spark):
    """Ten times the history at one rate forms ten times the pairs, not a hundred."""
    made = []
    for n in (300, 3000):
        rows = spark.range(n).select("id", F.lit("t").alias("tenant_id"), (F.col("id") * 10).alias("at"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 7))).alias("embedding"))
        q = rows.select(F.col("id").alias("query_id"), "tenant_id", F.col("at").alias("asked_at"), "embedding")
        c = rows.select(F.col("id").alias("cache_id"), "tenant_id", F.col("at").alias("created_at"), "embedding")
        made.append(r.cache_candidates(q, c, 0.92, 500).count())
    assert 8 * made[0] < made[1] < 13 * made[0]
    # Along its axis a similarity of 0.92 leaves fewer pairs than time alone.
    assert made[1] < 0.9 * r.cache_candidates(q, c, 0.0, 500).count()


def flow_of(spark, texts):
    """A flow over stored texts: the first search finds those that share the question's first letter, the second all of the tenant."""
    stored = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "id long, tenant_id string, text string")

    def search(whole):
        def run(rows):
            met = rows.join(stored, "tenant_id").where(F.lit(whole) | (F.left("text", F.lit(1)) == F.left("question", F.lit(1))))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
            return met.select("query_id", rank.alias("rank"), "text", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("source"), F.lit(1.0).alias("score"))

        return run

    chunks = F.col("chunks")
    score = F.when(F.size(chunks) >= 2, F.lit("0.9")).otherwise(F.lit("0.2"))
    write = F.concat(F.lit("From [Source: "), F.get(chunks, F.lit(0)).source, F.lit(", page 1]"))
    return Flow(spark, new_folder(spark, "test-flow"), (search(False), search(True)), write, F.struct(score.alias("faithfulness"), score.alias("relevance")), 0.9, 100)


TEXTS = [("a", "xa"), ("a", "xb"), ("a", "y"), ("b", "y"), ("b", " "), ("a", None)]
ASKED = [
    (1, "a", "x first", 0, [1.0, 0.0]),  # two passages at once
    (2, "a", "y one", 0, [0.0, 1.0]),  # one, then all: passes in the second search
    (3, "b", "y one", 0, [0.0, 1.0]),  # one of use in either
    (4, "c", "nothing stored", 0, [1.0, 1.0]),
    (5, "a", "  \t", 0, [1.0, 0.0]),
    (6, "a", None, 0, [1.0, 0.0]),
    (7, "a", "what is my balance", 0, [1.0, -1.0]),
    (8, "a", "my balance without data", 0, [-1.0, 1.0]),
    (9, "a", "xyz without a vector", 0, None),
]


def test_first_batch(spark):
    flow = flow_of(spark, TEXTS)
    account = spark.createDataFrame([(7, "Balance: $5")], "query_id long, account_result string")
    got = {x["query_id"]: x for x in flow.run_batch(spark.createDataFrame(ASKED, QUESTION), 0, account).collect()}
    assert sorted(got) == list(range(1, 10))
    assert (got[1]["answer"], got[1]["sources"], got[1]["retry_count"], got[1]["faithfulness"]) == ("From [Source: f0.txt, page 1]", ["f0.txt, page 1"], 0, 0.9)
    assert (got[2]["retry_count"], got[2]["faithfulness"]) == (1, 0.9)
    assert (got[3]["retry_count"], got[3]["faithfulness"]) == (1, 0.2)
    assert got[4]["answer"].startswith("I cannot find") and got[4]["retry_count"] == 1
    assert got[5]["error"] == got[6]["error"] == EMPTY_ERROR and got[5]["answer"] == "Please provide a question."
    assert got[7]["answer"] == "Balance: $5" and got[7]["retry_count"] == 0
    assert got[8]["answer"].endswith("transaction records.") and got[8]["retry_count"] == 1
    assert sorted(x["cache_id"] for x in flow.cache.read().collect()) == [1, 2, 9]
    log = {(x["query_id"], x["attempt"], x["source"]): x["cited"] for x in flow.chunks.read().collect()}
    # Passed rows are not searched again; account questions are searched in the retry only; blank passages are logged but not used.
    assert {k[:2] for k in log} == {(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (8, 1), (9, 0)}
    assert log[1, 0, "f0.txt"] and not log[1, 0, "f1.txt"] and log[3, 1, "f3.txt"] and not log[3, 1, "f4.txt"]
    assert not any(c for k, c in log.items() if k[0] == 8)


def test_later_batches_and_replay(spark):
    flow = flow_of(spark, TEXTS)
    one = spark.createDataFrame(ASKED, QUESTION)
    flow.run_batch(one, 0)
    again = [(q + 10, t, text, 90, e) for q, t, text, _, e in ASKED] + [(30, "a", "x at another time", 101, [1.0, 0.0]), (31, "b", "x of another tenant", 50, [1.0, 0.0])]
    two = spark.createDataFrame(again, QUESTION)
    got = {x["query_id"]: x for x in flow.run_batch(two, 1).collect()}
    assert got[11]["cached"] and got[11]["cache_id"] == 1 and got[11]["answer"] == "From [Source: f0.txt, page 1]" and got[11]["retry_count"] == 0
    assert got[12]["cached"] and got[12]["cache_id"] == 2
    assert not got[13]["cached"] and not got[30]["cached"] and not got[31]["cached"] and not got[19]["cached"]
    tables = (flow.answers, flow.cache, flow.chunks)
    before = [sorted(map(str, t.read().collect())) for t in tables]
    flow.run_batch(two, 1)
    flow.run_batch(one, 0)
    assert [sorted(map(str, t.read().collect())) for t in tables] == before
    assert 30 in {x["cache_id"] for x in flow.cache.read().collect()}
    assert not {11, 12} & {x["query_id"] for x in flow.chunks.read().collect()}


def test_empty_batch(spark):
    flow = flow_of(spark, TEXTS)
    assert flow.run_batch(spark.createDataFrame([], QUESTION), 0).count() == 0
    assert flow.chunks.read().count() == flow.cache.read().count() == 0


def test_ledger(spark):
    """Earlier batches only, complete ones only, a batch that runs again in place, and merged batches."""
    led = Ledger(spark, new_folder(spark, "ledger"), "n int")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "n int")
    read = lambda *a: sorted(x["n"] for x in led.read(*a).collect())
    assert read() == [] and led.read().columns == ["n"]
    for k in range(4):
        led.append(rows(k, 10 + k), k)
    led.append(rows(7), 2)
    assert read() == [0, 1, 3, 7, 10, 11, 13] and read(2) == [0, 1, 10, 11] and read(0) == []
    spark.createDataFrame([(99,)], "n int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{led.path}/batch=9")
    assert 99 not in read()
    led.compact(3)
    assert read() == [0, 1, 3, 7, 10, 11, 13] and len(led._folders(None)) == 2
    led.append(rows(50), 4)
    led.compact(5)
    assert read() == [0, 1, 3, 7, 10, 11, 13, 50] and len(led._folders(None)) == 1
