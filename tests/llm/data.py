"""A table of awkward documents, and plain-Python versions of what the operators compute."""

from __future__ import annotations

import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()
SENTENCE = " ".join(WORD)
#: Names that operators use inside must do no harm as extra columns.
EXTRA = ["key", "node", "score", "predicted", "block", "ids", "start", "lang_pred", "shard", "_y", "most", "n"]
ROWS: list[tuple] = [
    (1, SENTENCE, "la", "s1"),
    (2, SENTENCE, "la", "s1"),
    (3, SENTENCE.upper(), None, None),
    (4, None, "la", "s2"),
    (5, "", None, "s2"),
    (6, " \t\n ", "la", "s2"),
    (7, "one two", "en", "s1"),
    (8, "one two", "en", "s1"),
    (9, "the quick brown fox jumps over the lazy dog and runs away " * 400, "en", "s3"),
    (10, "x" * 9000, "en", "s3"),
    (11, "don't <|endoftext|> stop 123 éÉ straße ﬁ İ́ 日本語 🎈", "en", "s3"),
    (11, "don't <|endoftext|> stop 123 éÉ straße ﬁ İ́ 日本語 🎈", "en", "s3"),
    (None, SENTENCE + " magna", "la", None),
    (None, None, None, None),
    (12, "!!! ??? 12 34", "en", "s1"),
]


def documents(spark, rows=ROWS):
    fields = [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType())]
    fields += [StructField(c, StringType()) for c in EXTRA]
    return spark.createDataFrame([(*r, *(["?"] * len(EXTRA))) for r in rows], StructType(fields))


def ascii_lower(s: str) -> str:
    return s.translate({i: i + 32 for i in range(65, 91)})


def spaced(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(s or ""))


def alphanumeric(s: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(s or ""))


def shingle_set(s: str | None, k: int = 5) -> frozenset:
    w = spaced(s)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts: list[str | None]) -> list[int]:
    """Component number (smallest row number) of each text."""
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def brute_hits(text: str | None, items: list[tuple], window: int = 13) -> tuple[int, int, set]:
    """(words, hit words, item ids) of a text."""
    w, hit, found = alphanumeric(text), set(), set()
    for item, t in items:
        v = alphanumeric(t)
        k = min(window, len(v))
        for i in range(len(v) - k + 1) if v else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), found
