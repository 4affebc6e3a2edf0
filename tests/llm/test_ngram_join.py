from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm import ngram_join
from corpusloom.llm.textvec import SPACED, shingles, word_hashes
from tests.llm.data import ROWS, brute_components, documents, shingle_set


def check(spark, rows, **how):
    """Distinct non-null ids: component ids must be those of the brute force."""
    got = {r["doc_id"]: r for r in ngram_join.join(documents(spark, rows), **how).collect()}
    comp = brute_components([r[1] for r in rows])
    least: dict[int, int] = {}
    for r, c in zip(rows, comp, strict=True):
        least[c] = min(least.get(c, r[0]), r[0])
    for r, c in zip(rows, comp, strict=True):
        assert (got[r[0]]["n_shingles"], got[r[0]]["component_id"]) == (len(shingle_set(r[1])), least[c]), r[0]


def family(rng, base, n, most):
    """Copies of ``base`` with up to ``most`` words changed, some cut short."""
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", f"w{rng.randint(0, 10**6)}"])
        out.append(" ".join(w if i % 5 else w[rng.randint(0, 6) :]))
    return out


@pytest.mark.parametrize("rare,seed", [(32, 200), (2, 200), (1, 20), (3, 60)])
def test_families_of_near_copies(spark, rare, seed):
    rng = random.Random(rare * 1000 + seed)
    texts = []
    for f in range(5):
        base = [f"f{f}v{rng.randint(0, 60)}" for _ in range(rng.choice([6, 20, 60, 120]))]
        texts += family(rng, base, 40, 5)
    shared = [f"p{i}" for i in range(60)]
    texts += [" ".join(shared[: rng.randint(20, 60)] + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]) for _ in range(40)]
    rng.shuffle(texts)
    check(spark, [(i, t, None, None) for i, t in enumerate(texts)], rare=rare)


def test_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60]), None, None) for i in range(20)]
    check(spark, rows)


def test_exactly_at_the_threshold(spark):
    a = [f"w{i}" for i in range(13)]  # 9 shingles
    rows = [(1, " ".join(a), None, None), (2, " ".join(a[:12]), None, None), (3, " ".join(a[:11]), None, None), (4, " ".join(a[:8]), None, None), (5, " ".join(a[:9]), None, None)]
    check(spark, rows)


def test_awkward_rows(spark):
    got = ngram_join.join(documents(spark)).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {by_id[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert [(by_id[i]["n_shingles"], by_id[i]["component_id"]) for i in (4, 5, 6)] == [(0, 4), (0, 5), (0, 6)]
    assert {by_id[i]["component_id"] for i in (7, 8)} == {7}
    nulls = sorted(r["n_shingles"] for r in got if r["doc_id"] is None)
    assert nulls[0] == 0 and next(r for r in got if r["doc_id"] is None and r["n_shingles"])["component_id"] == 1


def test_empty_tables(spark):
    assert ngram_join.join(documents(spark, [])).count() == 0
    assert ngram_join.keep_one(documents(spark, [])).count() == 0


def test_keep_one(spark):
    docs = documents(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12]
    assert [r["text"] for r in rows if r["doc_id"] is None] == [None]


def test_query(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()]
    comp = brute_components([t for _, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.query(spark, tiny).collect()}
    assert got == {i: (len(shingle_set(t)), rows[c][0]) for (i, t), c in zip(rows, comp, strict=True)}


def test_long_lists_in_parts(spark, monkeypatch):
    """Many texts that share frequent shingles, some linked and some not: lists of many parts, over several rounds of pivots."""
    monkeypatch.setattr(ngram_join, "PART", 5)
    rng = np.random.default_rng(9)
    common = [f"w{i}" for i in range(120)]
    texts = [" ".join(common[:k] + [f"r{j}x{i}" for i in range(int(rng.integers(0, 50)))]) for j in range(140) for k in (100 + j % 21,)]
    texts += texts[:20]
    comp = brute_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == {i: (len(shingle_set(t)), c) for i, (t, c) in enumerate(zip(texts, comp, strict=True))}
    assert 1 < len(set(comp)) < len(texts)


def test_similar_sets_of_any_size_share_an_entry():
    """Every pair of similar sets stands in a list together, which says that they can share as much as they do."""
    rng = np.random.default_rng(5)
    order = np.sort(rng.integers(0, 1 << 63, 6000, np.uint64))
    held = rng.choice([2, 5, 40, 90, 3000], len(order), p=[0.02, 0.02, 0.3, 0.36, 0.3])
    linked = singles = 0
    for _ in range(1500):
        n = int(rng.choice([5, 9, 10, 39, 40, 55, 160, 199, 320, 399, 640, 1300, 2560]))
        base = rng.choice(len(order), n, replace=False)
        other = base[rng.random(n) > rng.random() * 0.2]
        more = rng.choice(len(order), int(rng.integers(0, n // 9 + 1)))
        a, b = np.unique(base), np.unique(np.concatenate([other, more]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 80 * (len(a) + len(b) - shared):
            continue
        linked += 1
        (ka, ma), (kb, mb) = (ngram_join.index_keys(order[x], held[x], len(x)) for x in (a, b))
        _, ia, ib = np.intersect1d(ka, kb, return_indices=True)
        assert (np.minimum(ma[ia], mb[ib]) >= shared).any(), (len(a), len(b), shared)
        assert len(ka) <= 8 + 1.5 * len(a)
        singles += not len(ia)
    assert linked > 500 and not singles


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, np.uint64)
    for n in (0, 1, 7, 90, 700, 3000):
        a, b = (np.unique(rng.choice(pool, n)) for _ in range(2))
        apart = sum(int(x ^ y).bit_count() for x, y in zip(*(ngram_join.parities(t).view(np.uint64).tolist() for t in (a, b)), strict=True))
        assert apart <= len(np.setxor1d(a, b)) and (apart > 0 or n == 0)
        assert not (ngram_join.parities(a) ^ ngram_join.parities(a)).any()


def test_combinations():
    group = np.array([3, 1, 3, 3, 0, 1], np.uint64)
    got = sorted(zip(*(x.tolist() for x in ngram_join._combinations(group)), strict=True))
    assert got == [(0, 2), (0, 3), (1, 5), (2, 3)] and not len(ngram_join._combinations(group[:0])[0])


def test_shingles_of_texts():
    texts = ["a b c d e f", "A  b\tc d e", "a b", "", "b a", "a b c d e f a b c d e f"]
    sets = shingles(*word_hashes([t.encode() for t in texts], SPACED))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert set(sets[1]) < set(sets[0]) and set(sets[2]) != set(sets[4])


def test_very_long_text_is_cut_between_words():
    text = ("word%d " * 3 % (1, 2, 3)) * 300_000
    h, counts = word_hashes([text.encode()])
    assert counts.tolist() == [900_000] and len(set(h[:3])) == 3 and (h[:3] == h[-3:]).all()
