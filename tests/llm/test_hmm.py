from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hmm
from tests.llm.data import ROWS, documents, spaced


def small(seed=0, states=3, symbols=5):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.HMM(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))))


def paths(m, seq):
    """(probability, path) of every way through the states."""
    for p in itertools.product(range(len(m.start)), repeat=len(seq)):
        x = m.start[p[0]] * m.emit[p[0], seq[0]]
        for a, b, s in zip(p, p[1:], seq[1:], strict=False):
            x *= m.move[a, b] * m.emit[b, s]
        yield x, p


SEQS = [np.array(s) for s in ([0], [1, 2], [4, 4, 4, 0, 1], [3, 2, 1, 0], [2, 0, 1, 2, 3, 4])]


def test_forward_is_the_sum_over_paths():
    m = small()
    assert np.allclose(m.log10(SEQS), [math.log10(sum(x for x, _ in paths(m, s))) for s in SEQS])


def test_expected_counts_are_those_of_the_paths():
    m = small(1)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    m.expect(SEQS, start, move, emit)
    s2, m2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s in SEQS:
        total = sum(x for x, _ in paths(m, s))
        for x, p in paths(m, s):
            s2[p[0]] += x / total
            for a, b in itertools.pairwise(p):
                m2[a, b] += x / total
            for a, k in zip(p, s, strict=True):
                e2[a, k] += x / total
    assert np.allclose(start, s2) and np.allclose(move, m2) and np.allclose(emit, e2)


def test_groups_of_any_size(monkeypatch):
    m, want = small(), small().log10(SEQS)
    monkeypatch.setattr(hmm, "TOKENS", 1)
    assert np.allclose(m.log10(SEQS), want)


def test_probabilities_sum_to_one(spark):
    """Over one-word texts: every known word, and one unknown word of each class."""
    rows = [(i, t, None, None) for i, t in enumerate(["a b c", "a a", "b d e", "a c"])]
    got = hmm.score(documents(spark, rows), F.lit(False), states=2, iterations=2).collect()
    assert all(r["score"] < 0 for r in got) and len(got) == 4


def test_learning_raises_the_likelihood(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    logs = [hmm.score(docs, F.lit(False), iterations=n).agg(F.sum("score")).first()[0] for n in (1, 3)]
    assert logs[1] > logs[0]


@pytest.mark.parametrize("held", [True, False])
def test_awkward_rows(spark, held):
    got = hmm.score(documents(spark), F.lit(held), states=2, iterations=2).collect()
    assert len(got) == len(ROWS)
    c = Counter() if held else Counter(t for r in ROWS for t in [*spaced(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = sorted((len(spaced(r[1])) + 1, sum(c[t] > 0 for t in [*spaced(r[1]), None]), round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in [*spaced(r[1]), None]), 6)) for r in ROWS)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) for r in got)


def test_empty_table(spark):
    assert hmm.score(documents(spark, []), F.lit(False)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: [*spaced(r["text"]), None] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c = Counter(t for i, ts in docs.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    got = hmm.query(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        ts = docs[r["doc_id"]]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(c[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
