from __future__ import annotations

import hashlib

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe
from tests.llm.data import brute_components, brute_hits, documents


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    good = stage("quality")(spark, docs, tiny).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns
    marked = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in marked) >= 0.99 * len(marked)
    assert not any(i in kept for i, q in labels.items() if q == 0)
    known = stage("language")(spark, good, tiny).cache()
    assert known.columns == docs.columns and known.count() == len(kept)
    one = stage("near-duplicates")(spark, known, tiny).cache()
    rows = known.orderBy("doc_id").collect()
    comp = brute_components([r["text"] for r in rows])
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == [rows[c]["doc_id"] for i, c in enumerate(comp) if i == c]
    clean = stage("decontamination")(spark, one, tiny).cache()
    left = set()
    for r in one.collect():
        n, hit, _ = brute_hits(r["text"], bench)
        if not (hit > 0 and 20 * hit >= n):
            left.add(r["doc_id"])
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == left
    t = Tokenizer.from_file(P.path(bpe.VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    want = {(i, hashlib.sha256(" ".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest()) for i, x in texts.items()}
    assert {(r["doc_id"], r["ids_sha256"]) for r in stage("tokens")(spark, clean, tiny).collect()} == want
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, tiny).collect()} == want


def test_awkward_rows_pass_through(spark, tiny):
    docs = documents(spark)
    for name, f in corpus_pipeline.STAGES:
        for rows in (docs, documents(spark, [])):
            out = f(spark, rows, tiny)
            assert out.count() <= rows.count()
            assert name == "tokens" or out.columns == docs.columns
