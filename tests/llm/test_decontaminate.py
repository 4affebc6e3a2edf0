from __future__ import annotations

import hashlib

import pytest

from corpusloom.llm import decontaminate as dc
from tests.llm.data import ROWS, SENTENCE, brute_hits, documents

ITEMS = [
    (1, SENTENCE), (2, "One, TWO"), (10, "ut labore"), (None, "jumps over the lazy dog"), (5, None), (6, ""), (2, "nothing here at all"),
    (7, "the quick brown fox jumps over the lazy dog and runs away the quick"), (8, "-- ! --"), (9, "123"),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "?") for r in rows], "item_id long, text string, id string")


def digest(ids):
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize("shard_bytes,block_bytes", [(1 << 24, 1 << 24), (100, 40)])
def test_awkward_rows(spark, shard_bytes, block_bytes):
    index = dc.build_index(documents(spark), shard_bytes=shard_bytes)
    got = dc.report(dc.search(index, items(spark), block_bytes=block_bytes)).collect()
    want = []
    for r in ROWS:
        n, hit, found = brute_hits(r[1], ITEMS)
        want.append((r[0], n, hit, len(found), digest(found), hit > 0 and 20 * hit >= n))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_no_match_across_documents(spark):
    rows = [(1, "a b c", None, None), (2, "d e f", None, None)]
    got = dc.search(dc.build_index(documents(spark, rows).coalesce(1)), items(spark, [(1, "c d"), (2, "b c")])).collect()
    assert {r["id"]: r["items"] for r in got} == {1: ["2"], 2: []}


def test_proximity(spark):
    rows = [(1, "alpha x x beta x gamma", None, None), (2, "alpha " + "x " * 50 + "beta gamma", None, None), (3, "gamma alpha", None, None), (4, "beta", None, None)]
    index = dc.build_index(documents(spark, rows).coalesce(1))
    got = {(r["id"], r["item"]): r["n_places"] for r in dc.proximity(index, items(spark, [(1, "gamma beta alpha")]), within=5).collect()}
    assert got == {(1, "1"): 1}
    assert {r["id"] for r in dc.proximity(index, items(spark, [(1, "gamma beta alpha")]), within=60).collect()} == {1, 2}


def test_one_block_at_a_time(spark, tiny, monkeypatch):
    """Many blocks give the rows of one block, and no task is sent more than one; repeated items fill no block."""
    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    bench = bench.unionByName(bench.withColumn("text", dc.F.substring("text", 40, 200))).unionByName(bench)
    index = dc.build_index(docs, shard_bytes=20_000)
    key = lambda r: r["id"]
    whole = sorted(dc.search(index, bench).collect(), key=key)
    sizes = []
    made = dc.Items.__init__
    monkeypatch.setattr(dc.Items, "__init__", lambda self, rows, window: (sizes.append(sum(len(t) for _, t in rows)), made(self, rows, window))[1])
    got = sorted(dc.search(index, bench, block_bytes=3000).collect(), key=key)
    assert got == whole and any(r["n_hit"] for r in got)
    assert len(sizes) > 3 and max(sizes) < 3 * 3000 and len(dc.search(index, bench.limit(0), block_bytes=10).collect()) == len(whole)
    near = [sorted(tuple(r) for r in dc.proximity(index, bench, 30, block_bytes=b).collect()) for b in (1 << 24, 3000)]
    assert near[0] == near[1] and near[0]


def test_empty_tables(spark):
    assert dc.search(dc.build_index(documents(spark, [])), items(spark)).count() == 0
    got = dc.search(dc.build_index(documents(spark)), items(spark, [])).collect()
    assert len(got) == len(ROWS) and not any(r["n_hit"] for r in got)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_keep_clean(spark, broadcast_rows):
    docs = documents(spark)
    kept = dc.keep_clean(docs, items(spark, [(1, SENTENCE)]), broadcast_rows=broadcast_rows)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i) == [4, 5, 6, 7, 8, 9, 10, 11, 11, 12] and ids.count(None) == 1


def test_query(spark, tiny):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in dc.query(spark, tiny).collect()}
    for i, t in docs.items():
        n, hit, found = brute_hits(t, bench)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, hit, len(found), digest(found))
