"""Operator 12: late arrivals overwrite day partitions, by signed-delta view maintenance.

The view is a folder of Parquet files: the latest-arrived row of each key, dealt by day, each day sorted and cut into files of a fixed
number of rows.  ``create`` writes it; ``apply_late`` brings it up to date with rows that came later:

1. A late row wins if it arrived later than the stored row of its key.  A winner emits the stored row with weight -1 and itself with +1.
2. The days of these signed rows are dirty, all others stay as they are, byte for byte.
3. Stored rows of dirty days count +1; weights of equal rows are added up, and rows whose sum is positive stand.
4. Dirty days are ranked and cut anew and replace what stood there, by Spark's dynamic partition overwrite; files that a day no longer
   has go.

A day may hold any share of the rows, so no day is ranked in one task: rows are sorted by range over all tasks, (day, range) counts are
added up, and a row's rank is its place in its range plus the rows of its day in the ranges before.  A file is written by one task, as a
stream, and read back the same way.

Defined results: a null time is day -1 and sorts first; a null arrival is the earliest and never early; rows without a key are one key;
of rows of one key that arrived at once, the largest by its columns in order stays; repeated rows are one row; an empty table gives no
files; other columns are kept in the files, and may have any names.  A folder that exists is an error for ``create``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import enter, filesystem, intermediates, materialize, release, scratch

CUTOFF = "2024-04-10 00:00:00"
#: A table is cut into about so many files, whatever its size.
FILES = 700
DAY_MICROS = 86_400_000_000


def _unlike(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970, in UTC whatever the session's zone."""
    moment = F.col(c)
    if dict(df.dtypes)[c] == "timestamp_ntz":
        moment = F.expr(f"convert_timezone('UTC', current_timezone(), `{c}`)").cast("timestamp")
    return F.unix_micros(moment)


def day_of(df: DataFrame, c: str) -> Column:
    """Whole days since 1970, -1 for null."""
    kind = dict(df.dtypes)[c]
    days = F.unix_date(F.col(c).cast("date")) if kind == "timestamp_ntz" else F.floor(F.unix_micros(c) / F.lit(DAY_MICROS))
    return F.coalesce(days.cast("long"), F.lit(-1).cast("long"))


@dataclass(frozen=True)
class View:
    """A view's place and shape."""

    folder: str
    schema: StructType
    rows_per_file: int
    key: str = "sale_id"
    time: str = "sold_at"
    arrived: str = "arrived_at"

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def day(self) -> str:
        return _unlike(self.columns, "day")

    @property
    def file_no(self) -> str:
        return _unlike(self.columns, "file_no")

    def read(self, spark: SparkSession) -> DataFrame:
        """All stored rows, with their day and file number."""
        schema = StructType(list(self.schema.fields)).add(self.day, "long").add(self.file_no, "long")
        return spark.read.schema(schema).parquet(self.folder)


def latest(rows: DataFrame, view: View) -> DataFrame:
    """The latest-arrived row of each key."""
    order = F.struct(F.col(view.arrived), *(F.col(c) for c in view.columns))
    best = rows.groupBy(F.col(view.key).alias("k")).agg(F.max(F.struct(order.alias("o"), F.struct(*view.columns).alias("row"))).alias("best"))
    return best.select("best.row.*")


def _ranked(rows: DataFrame, view: View) -> tuple[DataFrame, DataFrame]:
    """(rows with their day and file number, (day, n) of all days); ``rows`` have their day."""
    place, part = _unlike(view.columns, "place"), _unlike(view.columns, "range")
    order = [view.day, view.time, view.key]
    ordered = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # Written once, so that both what is counted and what is ranked have the same ranges.  The id is the range and the place in it.
    ordered = materialize(ordered.withColumn(place, F.monotonically_increasing_id()), "ranges").withColumn(part, F.shiftright(place, 33))
    d, p, first, before = (_unlike([*view.columns, view.day], c) for c in ("_d", "_p", "_first", "_before"))
    counts = ordered.groupBy(F.col(view.day).alias(d), F.col(part).alias(p)).agg(F.count("*").alias("n"), F.min(place).alias(first))
    counts = materialize(counts, "range-counts")  # a row for each range and each day, at most
    so_far = Window.partitionBy(d).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(d, p, first, F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias(before))
    met = ordered.join(starts, (F.col(view.day) == F.col(d)) & (F.col(part) == F.col(p)))
    rank = F.col(place) - F.col(first) + F.col(before)
    numbered = met.withColumn(view.file_no, F.floor(rank / F.lit(view.rows_per_file)).cast("long"))
    return numbered.select(*view.columns, view.day, view.file_no), counts.groupBy(F.col(d).alias("day")).agg(F.sum("n").alias("n"))


def _write(rows: DataFrame, view: View, mode: str) -> DataFrame:
    """Rank, cut and write ``rows``; returns (day, n) of the days written."""
    rows, days = _ranked(rows, view)
    dealt = rows.repartition(view.day, view.file_no).sortWithinPartitions(view.day, view.file_no, view.time, view.key)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(view.day, view.file_no).parquet(view.folder)
    return days


def create(rows: DataFrame, view: View) -> None:
    """Write the view of ``rows`` (with the view's columns and nothing else)."""
    with intermediates(rows.sparkSession):
        _write(latest(rows, view).withColumn(view.day, day_of(rows, view.time)), view, "errorifexists")


def signed_delta(stored: DataFrame, late: DataFrame, view: View) -> DataFrame:
    """(the view's columns, day, weight): what late rows change."""
    weight = _unlike([*view.columns, view.day], "weight")
    new = latest(late, view).withColumn(view.day, day_of(late, view.time))
    whole = [*view.columns, view.day]
    a = new.select(F.struct(*whole).alias("new"), F.col(view.key).alias("k"))
    b = stored.select(F.struct(*whole).alias("old"), F.col(view.key).alias("k2"))
    order = lambda s: F.struct(F.col(f"{s}.`{view.arrived}`"), *(F.col(f"{s}.`{c}`") for c in view.columns))
    met = a.join(b, F.col("k").eqNullSafe(F.col("k2")), "left").where(F.col("old").isNull() | (order("new") > order("old")))
    two = F.array(F.struct(F.col("old").alias("row"), F.lit(-1).alias("w")), F.struct(F.col("new").alias("row"), F.lit(1).alias("w")))
    each = met.select(F.explode(two).alias("e")).where("e.row is not null")
    return each.select("e.row.*", F.col("e.w").alias(weight))


def apply_late(late: DataFrame, view: View) -> DataFrame:
    """Bring the view up to date; returns the dirty days, a written table (day long)."""
    spark = late.sparkSession
    whole = [*view.columns, view.day]
    weight = _unlike(whole, "weight")
    stored = view.read(spark)
    path = scratch(spark, "dirty-days")
    with intermediates(spark):
        delta = materialize(signed_delta(stored, late, view), "delta")
        delta.select(F.col(view.day).alias("day")).distinct().write.parquet(path)
        dirty = spark.read.schema("day long").parquet(path)
        touched = stored.join(dirty.select(F.col("day").alias(view.day)), view.day, "left_semi")
        signed = touched.select(*whole, F.lit(1).alias(weight)).unionByName(delta)
        stands = signed.groupBy(*whole).agg(F.sum(weight).alias(weight)).where(F.col(weight) > 0).drop(weight)
        old = materialize(touched.groupBy(view.day, view.file_no).count(), "old-files")  # a row a file
        days = _write(stands, view, "overwrite")
        kept = days.select(F.col("day").alias(view.day), F.ceil(F.col("n") / F.lit(view.rows_per_file)).alias("files"))
        gone = old.join(kept, view.day, "left").where(F.col(view.file_no) >= F.coalesce("files", F.lit(0)))
        for d, f in gone.select(view.day, view.file_no).collect():  # of at most ``FILES`` files and one for each day
            release(spark, f"{view.folder}/{view.day}={d}/{view.file_no}={f}")
    return dirty


def files(view: View, spark: SparkSession) -> DataFrame:
    """(path string, day long, file_no long) of the view's files, listed by Spark; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(view.folder).select("path")
    tail = F.regexp_extract("path", f"({view.day}=-?[0-9]+/{view.file_no}=[0-9]+/[^/]+)$", 1)
    number = lambda c: F.regexp_extract("path", f"/{c}=(-?[0-9]+)/", 1).cast("long")
    return found.select(F.concat(F.lit(view.folder + "/"), tail).alias("path"), number(view.day).alias("day"), number(view.file_no).alias("file_no"))


def digests(found: DataFrame, key: str = "sale_id", time: str = "sold_at", arrived: str = "arrived_at", amount: str = "total") -> DataFrame:
    """Each file, read as a stream by one task: n_rows, cents, rows_crc long, columns, ids_sha256 string."""
    import pyarrow as pa

    def one(path: str) -> tuple:
        import numpy as np
        import pyarrow.parquet as pq

        fs, at = filesystem(path)
        n = cents = crc = 0
        sha = hashlib.sha256()
        with fs.open_input_file(at) as source, pq.ParquetFile(source) as file:
            columns = ",".join(file.schema_arrow.names)
            for batch in file.iter_batches(65_536, columns=[key, time, arrived, amount]):
                ids = ["" if x is None else str(x) for x in batch.column(key).to_pylist()]
                times = []
                for c in (time, arrived):
                    us = batch.column(c).cast(pa.timestamp("us", batch.column(c).type.tz)).cast(pa.int64())
                    times.append(["" if x is None else str(x) for x in us.to_pylist()])
                money = np.floor(100.0 * batch.column(amount).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) + 0.5)
                cents += int(np.where(np.isfinite(money), money, 0).astype(np.int64).sum())
                crc += sum(zlib.crc32(":".join(r).encode()) for r in zip(ids, *times, strict=True))
                sha.update((("," if n and ids else "") + ",".join(ids)).encode())
                n += len(ids)
        return n, cents, crc, columns, sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("late_days")
        for batch in batches:
            rows = [one(p) for p in batch.column(0).to_pylist()]
            more = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["path", "day", "file_no", "n_rows", "cents", "rows_crc", "columns", "ids_sha256"])

    dealt = found.select("path", "day", "file_no").repartition("path")
    return dealt.mapInArrow(run, "path string, day long, file_no long, n_rows long, cents long, rows_crc long, columns string, ids_sha256 string")


def with_copies(sales: DataFrame, key: str = "sale_id", time: str = "sold_at", arrived: str = "arrived_at", amount: str = "total") -> DataFrame:
    """The contract's rows: some sales come again later, changed."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(days=n.cast("int"))
    later = {amount: F.col(amount) + F.lit(1), time: F.col(time) + days(h % 2), arrived: F.col(arrived) + days(1 + h % 97)}
    again = sales.where((h % 3 == 0) & (day_of(sales, time) % 7 == 0))
    return sales.unionByName(again.select(*(later.get(c, F.col(c)).cast(t).alias(c) for c, t in sales.dtypes)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the layout of early sales, overwritten by late ones, file by file."""
    from corpusloom.llm.common import table

    sales = table(spark, sf_dir, "sales")
    rows = with_copies(sales)
    view = View(scratch(spark, "sales-by-day"), sales.schema, 1 + sales.count() // FILES)
    early = F.coalesce(micros(rows, view.arrived) < F.unix_micros(F.lit(CUTOFF + " UTC").cast("timestamp")), F.lit(False))
    create(rows.where(early), view)
    dirty = apply_late(rows.where(~early), view)
    found = digests(files(view, spark))
    return found.join(dirty.withColumn("rewritten", F.lit(True)), "day", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(False)))
