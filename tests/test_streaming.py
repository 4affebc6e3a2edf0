from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.admission import admit, admit_in_ranges
from corpusloom.streaming.admission import admit_stream
from corpusloom.storage import Buckets, complete, file_system
from corpusloom.streaming.failures import Ingestion, delay, failure_class
from corpusloom.streaming.ingest import upsert_stream, windowed_counts

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
SCHEMA = "user string, at double, n int"


def deque_admission(rows, limit, window):
    taken, out = {}, {}
    for u, t, n in sorted(rows, key=lambda r: (r[1], r[2])):
        own = [x for x in taken.get(u, []) if x >= t - window]
        out[n] = len(own) < limit
        taken[u] = own + [t] * out[n]
    return out


ROWS = [(f"u{i % 3}", float((i * i) % 400), i) for i in range(200)]


def test_batch_admission(spark):
    got = {r["n"]: r["accepted"] for r in admit(spark.createDataFrame(ROWS, SCHEMA), "user", "at", "n", 3, 20.0).collect()}
    assert got == deque_admission(ROWS, 3, 20.0)


@pytest.mark.parametrize("rounds, limit, window", [(0, 3, 20), (1, 2, 5000), (4, 1, 10), (4, 0, 5)])
def test_admission_in_ranges(spark, rounds, limit, window):
    """A key with half of all rows, irregular and saturated; one whose exits never agree; ties, repeats, null keys and times."""
    rng = random.Random(7)
    rows = [("hot", rng.randrange(4000), i) for i in range(500)] + [("even", 3 * i, 500 + i) for i in range(300)]
    rows += [(rng.choice("abc"), rng.randrange(4000), 800 + i) for i in range(150)] + [(None, rng.randrange(900), 950 + i) for i in range(60)]
    df = spark.createDataFrame([*rows, ("hot", None, 2000), (None, None, 2001)], "user string, at long, n int").repartition(3)
    got = {r["n"]: r["accepted"] for r in admit_in_ranges(df, "user", "at", "n", limit, window, 8, rounds).collect()}
    assert got == {**deque_admission(rows, limit, window), 2000: None, 2001: None}


def test_admission_in_ranges_of_nothing(spark):
    rows = spark.createDataFrame([], "user string, at long, n int, more string")
    got = admit_in_ranges(rows, "user", "at", "n")
    assert got.columns == ["user", "at", "n", "more", "accepted"] and got.count() == 0


def test_streamed_admission_equals_batch(spark, tmp_path, request):
    rows = sorted(ROWS, key=lambda r: (r[1], r[2]))
    request.addfinalizer(lambda: spark.conf.unset(NO_DATA))
    spark.conf.set(NO_DATA, "false")
    for i, part in enumerate((rows[:90], rows[90:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        q = admit_stream(stream, "user", "at", "n", 3, 20.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None, i
    got = {r["n"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == deque_admission(ROWS, 3, 20.0)


def test_upserts(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    for part in ([("a", "processing", 1), ("b", "processing", 2)], [("a", "complete", 3)], [("a", "processing", 2)]):
        spark.createDataFrame(part, "file string, status string, seq int").coalesce(1).write.mode("append").json(source)
        upsert_stream(spark.readStream.schema("file string, status string, seq int").json(source), path, "file", "seq", str(tmp_path / "cp")).awaitTermination(120)
    table = Buckets(spark, path, "file string, status string, seq int", "file", "seq")
    assert sorted((r["file"], r["status"], r["seq"]) for r in table.read().collect()) == [("a", "complete", 3), ("b", "processing", 2)]
    assert Buckets(spark, str(tmp_path / "none"), "file string", "file", "file").read().count() == 0


def folders(spark, path):
    fs, p = file_system(spark, f"{path}/data")
    return sorted(b.getPath().getParent().getName() + "/" + b.getPath().getName() for v in fs.listStatus(p) for b in fs.listStatus(v.getPath()) if b.getPath().getName().startswith("_bucket="))


def test_buckets_touched_only(spark, tmp_path):
    """A batch rewrites the buckets of its keys; replays change nothing; ties, old rows, null keys; versions nobody needs go."""
    table = Buckets(spark, str(tmp_path / "t"), "k long, seq int, x string", "k", "seq", 16)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, seq int, x string")
    stands = lambda n=None: sorted(map(tuple, table.read(n).collect()), key=str)
    first = [(i, 1, "first") for i in range(200)] + [(None, 1, "no key"), (5, 0, "older"), (6, 1, "a tie")]
    assert len(table.upsert(rows(*first), 0)) == 16
    want = {i: (i, 1, "first") for i in range(200)} | {None: (None, 1, "no key")}
    assert stands() == sorted(want.values(), key=str)
    touched = table.upsert(rows((3, 2, "new"), (4, 0, "late"), (7, 1, "again"), (3, 1, "not the newest")), 1)
    assert 1 <= len(touched) <= 3 and len(folders(spark, table.path)) == 16 + len(touched)
    want |= {3: (3, 2, "new"), 7: (7, 1, "again")}
    assert stands() == sorted(want.values(), key=str)
    assert table.upsert(rows((3, 2, "new"), (4, 0, "late"), (7, 1, "again"), (3, 1, "not the newest")), 1) == touched
    assert stands() == sorted(want.values(), key=str) and stands(1) == sorted(({i: (i, 1, "first") for i in range(200)} | {None: (None, 1, "no key")}).values(), key=str)
    assert table.upsert(rows(), 2) == []
    assert table.vacuum(2) == 0
    table.upsert(rows((3, 3, "newest")), 3)
    table.vacuum(1)
    want[3] = (3, 3, "newest")
    assert stands() == sorted(want.values(), key=str) and len(folders(spark, table.path)) == 16


def outcome(rows):
    """A parser whose files say how they fail: the number of transient failures, or a permanent one, or pages."""
    kind = F.substring(F.col("content").cast("string"), 1, 1)
    times = F.substring(F.col("content").cast("string"), 2, 9).cast("int")
    error = F.when(kind == "P", F.lit("ValueError: bad: data")).when((kind == "T") & (F.col("attempt") <= times), F.lit("TimeoutError: slow"))
    pages = F.explode(F.when(error.isNull(), F.sequence(F.lit(1), times)).otherwise(F.array(F.lit(None).cast("int"))))
    return rows.select("file_hash", error.alias("error"), pages.alias("page"))


FILES = [("a", "G2", 1), ("b", "P0", 2), ("c", "T1", 3), ("d", "T3", 4), ("e", "T9", 5), ("a", "G2", 9)]


def expected(step):
    state = {r["file_hash"]: (r["state"], r["attempt"]) for r in step.states().collect()}
    return state, sorted((r["file_hash"], r["page"]) for r in step.results.read().collect())


def test_failures_come_back_or_stay(spark, tmp_path):
    step = Ingestion(spark, str(tmp_path / "i"), outcome, "page int")
    rows = spark.createDataFrame([(h, f"{h}.x", c.encode(), t) for h, c, t in FILES], "file_hash string, path string, content binary, arrived_at long")
    none = rows.where("false")
    step.step(rows, 0)
    assert expected(step) == ({"a": ("done", 1), "b": ("dead", 1), "c": ("waiting", 1), "d": ("waiting", 1), "e": ("waiting", 1)}, [("a", 1), ("a", 2)])
    step.step(none, 1, 6)  # nothing is due yet: the first wait is at least two seconds from the fifth
    assert expected(step)[0]["c"] == ("waiting", 1)
    for batch, now in ((2, 100), (3, 200), (4, 300), (5, 400)):
        step.step(none, batch, now)
    state, pages = expected(step)
    assert state == {"a": ("done", 1), "b": ("dead", 1), "c": ("done", 2), "d": ("done", 4), "e": ("dead", 4)}
    assert pages == [("a", 1), ("a", 2), ("c", 1), ("d", 1), ("d", 2), ("d", 3)]
    letters = {r["file_hash"]: (r["kind"], r["attempts"], r["path"]) for r in step.dead_letters().collect()}
    assert letters == {"b": ("permanent", 1, "b.x"), "e": ("transient", 4, "e.x")}
    before = sorted(map(str, step.attempts.read().collect()))
    step.step(rows, 0)
    step.step(none, 3, 200)
    step.step(rows, 6, 500)  # known files are not attempted again
    assert sorted(map(str, step.attempts.read().collect())) == before
    assert step.attempts.read().groupBy("file_hash", "attempt").count().where("count > 1").count() == 0


def test_failures_as_a_stream(spark, tmp_path):
    schema = "file_hash string, path string, content binary, arrived_at long"
    step = Ingestion(spark, str(tmp_path / "i"), outcome, "page int")
    for part in (FILES[:5], [("z", "G1", 1000)], [("y", "G1", 2000)], [("x", "P1", 3000)]):
        spark.createDataFrame([(h, f"{h}.x", c.encode(), t) for h, c, t in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = step.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    state, _ = expected(step)
    assert state == {"a": ("done", 1), "b": ("dead", 1), "c": ("done", 2), "d": ("done", 4), "e": ("dead", 4), "z": ("done", 1), "y": ("done", 1), "x": ("dead", 1)}
    assert complete(spark, step.attempts.path, "batch=") == [0, 1, 2, 3]


def test_failure_classes_and_delays(spark):
    rows = spark.createDataFrame([(e,) for e in (None, "TimeoutError: x: y", "OSError", "ConnectionResetError: z", "ValueError: TimeoutError", "no pages", "")], "e string")
    assert [r[0] for r in rows.select(failure_class(F.col("e"))).collect()] == ["done", "transient", "transient", "transient", "permanent", "permanent", "permanent"]
    waits = [r[0] for r in spark.range(200).select(delay(F.col("id").cast("string"), F.lit(3))).collect()]
    assert min(waits) >= 8 and max(waits) <= 10 and len(set(waits)) > 1


def test_windowed_counts(spark, tmp_path, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, F.col("ts"), "1 day", "1 day", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
