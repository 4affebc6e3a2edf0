from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid
from tests.llm.data import ROWS, documents


def test_grams_do_not_cross_texts():
    h, own = langid.grams(["ab", "", "cd", "a"])
    alone = [langid.grams([t])[0].tolist() for t in ("ab", "", "cd", "a")]
    assert [sorted(h[own == i].tolist()) for i in range(4)] == [sorted(x) for x in alone]
    assert langid.grams([])[0].tolist() == [] and alone[1] == []


def test_folding():
    assert langid.grams(["A  b!?"])[0].tolist() == langid.grams(["a b "])[0].tolist()


def test_counts_are_those_of_one_pass(spark):
    """The matrix summed across tasks against plain counting."""
    rows = [(i, t, g, None) for i, (t, g) in enumerate([("the cat sat", "en"), ("der hund lief", "de"), ("the dog ran", "en"), ("eine katze", "de")])]
    model = langid.fit(documents(spark, rows).repartition(3))
    for g, k in (("de", 0), ("en", 1)):
        c = Counter(x for _, t, lang, _ in rows if lang == g for x in langid.grams([t])[0].tolist())
        n = sum(c.values())
        for x, m in list(c.items())[:20]:
            assert math.isclose(model.matrix[x, k], math.log((m + langid.ALPHA) / (n + langid.ALPHA * langid.BUCKETS)), rel_tol=1e-5)
    assert model.languages == ["de", "en"]


def test_awkward_rows(spark):
    docs = documents(spark)
    got = langid.predict(docs, langid.fit(docs), keep={"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(ch.isalpha() for ch in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0.0 <= r["score"] <= 1.0 and (letters or r["score"] == 0.0)
    by = {r["text"]: r["lang_pred"] for r in got}
    assert by[ROWS[0][1]] == "la" and by["one two"] == "en"


def test_empty_and_unlabelled(spark):
    assert langid.fit(documents(spark, [])) is None
    assert langid.predict(documents(spark, []), None).count() == 0
    rows = [(1, "some words", None, None)]
    assert [r["lang_pred"] for r in langid.predict(documents(spark, rows), langid.fit(documents(spark, rows)), keep={"i": F.col("doc_id")}).collect()] == ["und"]


def test_language_limit(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.fit(documents(spark))


def test_keep_known(spark):
    docs = documents(spark)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert all(any(ch.isalpha() for ch in r["text"]) for r in kept.collect())


def test_keep_known_without_languages(spark):
    rows = [(1, "some words", None, None), (2, "12 34", None, None), (3, None, None, None), (4, "слова", None, None)]
    assert {r["doc_id"] for r in langid.keep_known(documents(spark, rows)).collect()} == {1, 4}


def test_keep_known_between_like_languages(spark):
    """Texts that several languages share stay, although no language has half of the posterior; an unknown script goes."""
    rows = [(i, "the cat sat on the mat and the dog ran", f"l{i % 5}", None) for i in range(50)]
    rows += [(100, "the cat", None, None), (101, "совсем другие слова", None, None)]
    kept = {r["doc_id"] for r in langid.keep_known(documents(spark, rows)).collect()}
    assert kept == {*range(50), 100}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = langid.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 0
