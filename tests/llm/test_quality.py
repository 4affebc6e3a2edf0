from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality
from tests.llm.data import ROWS, documents


def test_grams_stay_within_texts():
    texts = [b"ab", b"", b"x", b"abcdef"]
    assert [sorted(g.tolist()) for g in quality.grams(texts)] == [sorted(next(quality.grams([t])).tolist()) for t in texts]
    sizes = [len(g) for g in quality.grams(texts)]
    assert sizes == [1, 0, 0, 5 + 4 + 3]


@pytest.mark.parametrize("text,run", [(b"", 0), (b"a", 1), (b"a b a", 1), (b"x The the THE y", 3), (b"a a b b b", 3)])
def test_longest_repeat(text, run):
    assert quality.longest_repeat(text) == run


def test_descent_meets_the_optimality_conditions():
    """Dual coordinate descent on a small problem: margins of free vectors are 1, of others beyond it on the right side."""
    rng = random.Random(3)
    good = ["".join(rng.choice("abcdef ") for _ in range(40)) for _ in range(40)]
    bad = ["".join(rng.choice("uvwxyz!") for _ in range(40)) for _ in range(20)]
    maps = quality.bitmaps([t.encode() for t in good + bad])
    y = [1] * 40 + [0] * 20
    m = quality.NBSVM(maps, y, epochs=200)
    margins = np.array([m._margin(m._row(b)) for b in maps]) * np.where(np.array(y) == 1, 1, -1)
    assert (margins > 0.9).all()
    scores = m.score([t.encode() for t in good + bad])
    assert min(scores[:40]) > 0.5 > max(scores[40:])


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, "?"), (2, 1, "?"), (9, 0, "?"), (9, 0, "?"), (12, 0, "?"), (4, None, "?"), (None, 1, "?"), (77, 1, "?"), (5, 3, "?")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, keep={"doc_id": F.col("doc_id"), "t": F.col("text")}).collect()
    assert len(got) == len(ROWS)
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["t"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(ROWS)


def test_one_class_or_none(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert {r["score"] for r in quality.score(docs, None, keep={"i": F.col("doc_id")}).collect()} == {0.5}
    assert quality.score(documents(spark, []), None, keep={"i": F.col("doc_id")}).count() == 0
    assert quality.fit(documents(spark, []), labels.limit(0)) is None


def test_model_does_not_depend_on_partitions(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(5), labels.repartition(3))
    assert (a.scaled == b.scaled).all() and (a.a, a.b, a.bias) == (b.a, b.b, b.bias)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = quality.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.97
    assert (got[got.quality == 1].predicted == 1).mean() >= 0.99
    assert (got[got.quality == 0].predicted == 0).mean() >= 0.9
