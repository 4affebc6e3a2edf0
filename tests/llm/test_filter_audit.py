from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit as fa
from tests.llm.data import ROWS, documents
from tests.oracle import compare

MORE = [
    (20, "word " * 60, "en", "s1"),
    (21, "word " * 60, "en", None),
    (22, " ".join(f"w{i}" for i in range(70)), "en", ""),
    (23, " ".join(f"w{i}" for i in range(70)), "en", "s1"),
    (23, " ".join(f"w{i}" for i in range(70)), "en", "s1"),
    (24, "CAPITALS " * 55 + "$", "en", "s1"),
    (25, "costs 5$ a&b " + " ".join(f"v{i}" for i in range(300)), "en", "s4"),
    (26, "é" * 100_000 + " A", "en", "s4"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (7, 1, 1), (8, 1, 0), (8, 0, 1), (23, 1, 0), (24, None, 1), (99, 1, 1), (None, 1, 1), (11, 1, 0)]


def brute(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, _, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(w) < 50:
            fails.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and i > least[t]:
            fails.add("E")
        docs.append((source or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                own = [d for d in docs if d[0] == part]
                gone = [d for d in own if f in d[1] and not d[1] & before]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not d[1] & (before | {f}) for d in own), len(gone), sum(f in d[1] and bool(d[1] & before) for d in own),
                    sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_awkward_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, labels that repeat or name no document, columns with clashing names."""
    rows = ROWS + MORE
    docs = documents(spark, rows).withColumns({c: F.lit("?") for c in ("part", "mask", "good", "_id", "subset", "filter")})
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit(1))
    got = fa.audit(fa.document_masks(docs, labels)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(got) == len(found) == 600 * len({r[3] or "" for r in rows})
    assert found == brute(rows, LABELS)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fa.audit(fa.document_masks(documents(spark, []), labels)).collect() == []
    assert fa.audit(fa.document_masks(documents(spark), labels)).where("good_lost + toxic_lost > 0").count() == 0


def test_edges_are_the_lattice(spark):
    """80 edges, 600 steps, and as many orders on an edge as its subset and the rest have orders."""
    assert fa.lattice(spark).select("subset", "filter").distinct().count() == 80
    of = {(r["subset"], r["filter"]): r["count"] for r in fa.steps(spark).groupBy("subset", "filter").count().collect()}
    orders = [24, 6, 4, 6, 24]
    assert sum(of.values()) == 600 and all(n == orders[bin(s).count("1")] for (s, _), n in of.items())


@pytest.mark.parametrize("letters", ["AB", "ABC"])
def test_other_numbers_of_filters(spark, letters):
    masks = spark.createDataFrame([("x", m, m + 1, m, 1) for m in range(1 << len(letters))], "part string, mask int, n long, good long, toxic long")
    rows = fa.audit(masks, letters).collect()
    total = sum(m + 1 for m in range(1 << len(letters)))
    last = [r for r in rows if r["step"] == len(letters)]
    assert all(r["kept"] == 1 for r in last)
    for order in {r["filter_order"] for r in rows}:
        assert sum(r["removed"] for r in rows if r["filter_order"] == order) == total - 1


def test_query_equals_sql(spark, tiny):
    n, differs = compare(fa.query(spark, tiny), fa.SQL, tiny)
    assert n and not differs, differs
