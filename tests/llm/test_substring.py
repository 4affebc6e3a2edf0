from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import substring as s
from tests.llm.data import EXTRA, ROWS, documents
from tests.oracle import compare


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(texts):
    """(n_words, n_removed, digest of what is left) of each text."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in all_words for i in range(len(w) - 34))
    out = []
    for w in all_words:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward():
    rng = random.Random(7)
    passage, line = prose(rng, 60), prose(rng, 35)
    rows = list(ROWS)
    for i in range(100, 140):
        # A common passage and a common line in other words, a near copy, a passage that differs in one word.
        rows.append((i, f"{prose(rng, i)} {passage} {prose(rng, 20)}\t{line}\n{prose(rng, 3)}", "en", "s"))
    changed = passage.split(" ")
    changed[30] = "other"
    rows += [
        (200, " ".join(changed), "en", "s"),
        (201, rows[-1][1] + " and more", "en", "s"),
        (202, "x " * 5000, "en", "s"),
        (203, "a b " * 40, "en", "s"),
        (204, " ".join(f"u{i}" for i in range(120_000)) + " " + line, "en", "s"),
        (205, prose(rng, 34, 3), "en", "s"),
        (206, line, "en", "s"),
        (207, line.upper(), "en", "s"),
        (208, prose(rng, 4000, 2), "en", "s"),
    ]
    return rows


@pytest.mark.parametrize("hot", [0, 3, s.HOT])
def test_awkward_documents(spark, hot):
    """Nulls, empty, very long and repeated texts, passages that many share, clashing columns; with every anchor hot, some, none."""
    rows = awkward()
    docs = documents(spark, rows)
    assert set(EXTRA) <= set(docs.columns)
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in s.report(docs, hot=hot).collect()))
    assert got == sorted((r[0] or -1, *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True))


def test_general_interface_gives_texts_and_spans(spark):
    rows = awkward()
    found = {r["key"]: r for r in s.deduplicate(documents(spark, rows)).collect()}
    for (_, text, *_), (n, gone, digest) in zip(rows, brute([r[1] for r in rows]), strict=True):
        r = found[hashlib.md5((text or "").encode()).hexdigest()]
        w = words(text)
        assert (r["n_words"], r["n_removed"]) == (n, gone) and hashlib.sha256(r["kept"]).hexdigest() == digest
        spans = [(x["begin"], x["end"]) for x in r["spans"]]
        assert sum(b - a for a, b in spans) == gone and all(b - a >= 35 for a, b in spans)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        inside = {j for a, b in spans for j in range(a, b)}
        assert " ".join(x for j, x in enumerate(w) if j not in inside).encode() == bytes(r["kept"])


def test_empty_table(spark):
    assert s.report(documents(spark, [])).collect() == []


def longest_other(segments, k, i):
    """Longest match of place i of segment k with any other place, word by word."""
    best = 0
    for m, other in enumerate(segments):
        for j in range(len(other)):
            n = 0
            while (m, j) != (k, i) and i + n < len(segments[k]) and j + n < len(other) and segments[k][i + n] == other[j + n]:
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_factors_are_greedy_and_longest(seed):
    rng = random.Random(seed)
    segments = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 30))] for _ in range(8)]
    ref = s.Reference(segments)
    found = list(zip(*(x.tolist() for x in ref.factors()), strict=True))
    want = []
    for k, seg in enumerate(segments):
        i = 0
        while i < len(seg):
            n = max(1, longest_other(segments, k, i))
            want.append((k, ref.begin[k] + i, ref.begin[k] + i + n))
            i += n
    assert found == want


@pytest.mark.parametrize("seed", range(8))
def test_spans_hold_every_duplicate_window(seed):
    """Spans against windows looked up one by one, on segments cut out of each other so that factors end within windows."""
    rng = random.Random(seed)
    base = [b"%d" % rng.randrange(40) for _ in range(150)]
    segments = []
    for _ in range(12):
        a = rng.randrange(100)
        seg = base[a : a + rng.randrange(35, 50)] + base[(b := rng.randrange(100)) : b + rng.randrange(0, 30)]
        segments.append(seg[:62])
    seen = Counter(tuple(x[i : i + 35]) for x in segments for i in range(len(x) - 34))
    want = {(k, j) for k, x in enumerate(segments) for i in range(len(x) - 34) if seen[tuple(x[i : i + 35])] > 1 for j in range(i, i + 35)}
    got = {(k, j) for k, a, b in zip(*(v.tolist() for v in s.Reference(segments).spans()), strict=True) for j in range(a, b)}
    assert got == want


def test_segments_hold_each_window_once():
    rng = random.Random(3)
    texts = [prose(rng, n, v).encode() for n, v in ((200, 3), (34, 9), (35, 9), (500, 1000), (0, 1), (90, 1))]
    found = s.Segments(texts)
    windows = Counter((t, f + i) for t, f, n in zip(found.text.tolist(), (found.first - found.begin[found.text]).tolist(), found.windows.tolist(), strict=True) for i in range(n))
    assert windows == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 34))
    assert found.windows.max() <= 28
    # An anchor follows from the words of a window alone.
    anchors = {}
    for t, f, n, a in zip(found.text.tolist(), (found.first - found.begin[found.text]).tolist(), found.windows.tolist(), found.anchor.tolist(), strict=True):
        for i in range(n):
            assert anchors.setdefault(tuple(texts[t].split()[f + i : f + i + 35]), a) == a


def test_word_hashes_tell_case_and_bounds():
    h, n = s.word_hashes([b"a A ab", b"", b"\ta\x0bab \n"])
    assert n.tolist() == [3, 0, 2] and h[0] == h[3] and h[2] == h[4] and len(np.unique(h)) == 3


def test_query_equals_sql(spark, tiny):
    n, differs = compare(s.query(spark, tiny), s.SQL, tiny)
    assert n and not differs, differs
