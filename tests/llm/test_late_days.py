from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import late_days
from corpusloom.llm.common import scratch

EPOCH = datetime(1970, 1, 1)
TYPES = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def us(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def order(row):
    """Sorting key of a row's values, nulls first."""
    return tuple((v is not None, v if v is not None else 0) for v in (row[5], *row))


def winners(rows):
    best = {}
    for r in rows:
        if r[0] not in best or order(r) > order(best[r[0]]):
            best[r[0]] = r
    return best


def layout(rows, size):
    days = defaultdict(list)
    for r in winners(rows).values():
        days[day(r[4])].append(r)
    out = {}
    for d, own in days.items():
        own.sort(key=lambda r: ((r[4] is not None, r[4] or EPOCH), (r[0] is not None, r[0] or 0)))
        for k in range(0, len(own), size):
            out[d, k // size] = own[k : k + size]
    return out


def brute(rows, cutoff, size):
    """(files of the final layout, dirty days)."""
    early = [r for r in rows if r[5] is not None and r[5] < cutoff]
    start, end = winners(early), winners(rows)
    dirty = set()
    for key, r in end.items():
        if key not in start or r != start[key]:
            dirty.add(day(r[4]))
            if key in start:
                dirty.add(day(start[key][4]))
    return layout(rows, size), dirty


def figures(rows):
    cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in rows)
    text = lambda x: "" if x is None else str(x)
    crc = sum(zlib.crc32(f"{text(r[0])}:{text(us(r[4]))}:{text(us(r[5]))}".encode()) for r in rows)
    return len(rows), cents, crc, hashlib.sha256(",".join(text(r[0]) for r in rows).encode()).hexdigest()


def on_disk(folder):
    root, found = folder.removeprefix("file://"), {}
    for at, _, names in os.walk(root):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{at}/{n}", "rb") as f:
                    found[f"{at}/{n}"] = f.read()
    return found


T = datetime(2024, 4, 1, 12)
CUT = datetime(2024, 4, 10)
H = timedelta(hours=1)
FIXTURE = [
    *((i, 1, "done", i / 8, T + (i % 5) * H, T + 2 * H, 1) for i in range(20)),  # one day in many files
    *((30 + i, 2, None, None, T - timedelta(days=3), T, None) for i in range(5)),
    (30, 2, "late", 1.5, T - timedelta(days=3), CUT, None),  # at the cutoff: late, same day
    (31, 2, "moved", 2.5, T + timedelta(days=5), CUT + H, 3),  # to a day of its own
    (40, 3, "only", 0.125, T + timedelta(days=9), T, 1),
    (40, 3, "moved", 0.5, None, CUT + H, 1),  # its day has no row left
    (41, 3, "old", 1.0, T + timedelta(days=12), T, 1),
    (41, 3, "stale", 1.0, T + timedelta(days=13), T - H, 1),  # came earlier
    (42, None, "same", 1.0, T + timedelta(days=14), T, 1),
    (42, None, "same", 1.0, T + timedelta(days=14), T, 1),  # twice
    (43, None, "tie a", 1.0, T + timedelta(days=15), CUT, 1),
    (43, None, "tie b", 1.0, T + timedelta(days=15), CUT, 1),
    (44, 1, "never", 7.0, T + timedelta(days=16), None, 1),  # no arrival: late, loses to none
    (45, 1, "never", 7.0, T + timedelta(days=17), None, 1),
    (45, 1, "early", 7.0, T + timedelta(days=18), T, 1),  # ... but to any other
    (None, 1, "no id", 7.0, T, T, 1),
    (None, 1, "no id, later", 7.0, T + timedelta(days=19), CUT + H, 1),
    (46, 1, None, -3.455, datetime(1969, 12, 30, 5), T, 1),
    (47, 1, "x" * 100_000, 1.0, T, CUT + 3 * H, 1),
]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_view_equals_a_layout_of_all_rows(spark, size):
    """Nulls, ties, repeats, a very long text and extra columns with names that are used inside."""
    extra = {c: F.lit(c) for c in ("day", "file_no", "weight", "range", "place", "k", "best", "n", "d", "p")}
    rows = spark.createDataFrame(FIXTURE, TYPES).withColumns(extra)
    view = late_days.View(scratch(spark, "test-view"), rows.schema, size)
    early = F.coalesce(F.col("arrived_at") < F.lit(CUT), F.lit(False))
    late_days.create(rows.where(early), view)
    before = on_disk(view.folder)
    dirty = {r["day"] for r in late_days.apply_late(rows.where(~early), view).collect()}
    after = on_disk(view.folder)
    want, days = brute(FIXTURE, CUT, size)
    assert dirty == days
    got = {}
    for path, data in after.items():
        d, f = (int(p.split("=")[1]) for p in path.split("/")[-3:-1])
        table = pq.ParquetFile(path).read()
        assert table.column_names == rows.columns
        assert (d, f) not in got
        got[d, f] = [tuple(r.values())[:7] for r in table.to_pylist()]
        assert (path in before) == (d not in days)
        assert d in days or before[path] == data
    assert got == want
    found = {(r["day_"] if "day_" in r else r["day"], r["file_no"]): r for r in late_days.digests(late_days.files(view, spark)).collect()}
    assert {k: (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"]) for k, r in found.items()} == {k: figures(v) for k, v in want.items()}
    assert {r["columns"] for r in found.values()} == {",".join(rows.columns)}


def test_times_with_a_zone_count_in_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        t = datetime(2024, 1, 1, 1, tzinfo=timezone.utc)
        df = spark.createDataFrame([(t, None)], "a timestamp, b timestamp").withColumn("n", F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"))
        got = df.select(late_days.day_of(df, "a"), late_days.day_of(df, "n"), late_days.day_of(df, "b"), late_days.micros(df, "a"), late_days.micros(df, "n")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (19723, 19723, -1, us(datetime(2024, 1, 1, 1)), us(datetime(2024, 1, 1, 1)))


def test_empty_tables(spark):
    """No rows at all, no early rows, no late rows."""
    rows = spark.createDataFrame(FIXTURE[:3], TYPES)
    none = rows.where("false")
    for early, late, n in ((none, none, 0), (none, rows, 3), (rows, none, 3)):
        view = late_days.View(scratch(spark, "test-view"), rows.schema, 1)
        late_days.create(early, view)
        assert late_days.apply_late(late, view).count() == (1 if late is rows else 0)
        found = late_days.digests(late_days.files(view, spark)).collect()
        assert sum(r["n_rows"] for r in found) == n == len(found)


def test_query_equals_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/sales.parquet").collect()]
    size = 1 + len(rows) // 700
    copies = []
    for r in rows:
        h = zlib.crc32(str(r[0]).encode())
        if h % 3 == 0 and day(r[4]) % 7 == 0:
            copies.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), None if r[5] is None else r[5] + timedelta(days=1 + h % 97), r[6]))
    want, dirty = brute(rows + copies, CUT, size)
    got = late_days.query(spark, tiny).collect()
    assert len(got) == len(want) and copies and dirty and any(d not in dirty for d, _ in want)
    for r in got:
        assert (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"]) == figures(want[r["day"], r["file_no"]])
        assert r["rewritten"] == (r["day"] in dirty)
        assert r["columns"] == "sale_id,client_id,status,total,sold_at,arrived_at,priority"
        assert pq.ParquetFile(r["path"].removeprefix("file://")).metadata.num_rows == r["n_rows"]
