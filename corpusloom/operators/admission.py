"""Sliding-window admission: a request is accepted unless ``limit`` requests of its key were accepted within the window before it.

``admit`` takes each key's rows in turn, in one task.  ``admit_in_ranges`` folds the ranges of one hot key in parallel: what a range needs
of the past is the key's last ``limit`` accepted times (its entry), and what it leaves is the same (its exit).  All ranges start with an
empty entry; then every range whose entry was wrong is folded again, until no exit changes.  Different pasts soon come to the same
exit where arrivals are irregular or sparse, so few rounds are needed; ranges that still disagree after ``ROUNDS`` are taken in turn."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from corpusloom.deploy import ship
from corpusloom.storage import new_folder

LIMIT, WINDOW_SECONDS = 10, 60.0
ROUNDS = 4
RANGE = "_range_"


def admit(requests: DataFrame, key: str, at: str, order: str, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """Adds accepted boolean.  ``at``: seconds as double; ties in time go by ``order``.

    Whether one request passes depends on those accepted before it, so a key's rows are taken in turn; they stream through a
    sorted partition, and a key's state is its last ``limit`` accepted times, however many rows it has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, taken = None, deque(maxlen=limit)
        for f in frames:
            out = []
            for k, t in zip(f[key].tolist(), f[at].tolist(), strict=True):
                if k != last:
                    last, taken = k, deque(maxlen=limit)
                ok = limit > 0 and (len(taken) < limit or taken[0] < t - window)
                if ok:
                    taken.append(t)
                out.append(ok)
            yield f.assign(accepted=out)

    ordered = requests.repartition(key).sortWithinPartitions(key, at, order)
    return ordered.mapInPandas(run, requests.schema.add("accepted", "boolean"))


def _decide(batches: Iterator, key: str, at: str, limit: int, window: float, entries: dict, carry: bool = False) -> Iterator[tuple]:
    """(batch, accepted, exits {range: last accepted times of its last key} so far) of rows sorted by range, key and time.

    ``entries``: by range, for its first key.  With ``carry``, a key that goes on in the next range keeps its own times."""
    place, last, taken, exits = None, None, deque(maxlen=limit), {}
    for batch in batches:
        out = []
        for r, k, t in zip(*(batch.column(c).to_pylist() for c in (RANGE, key, at)), strict=True):
            if r != place:
                goes_on = carry and place is not None and k == last
                taken = deque(taken if goes_on else entries.get(r, ()), maxlen=limit)
                place, last = r, k
            elif k != last:
                last, taken = k, deque(maxlen=limit)
            ok = limit > 0 and (len(taken) < limit or taken[0] < t - window)
            if ok:
                taken.append(t)
            out.append(ok)
            exits[r] = taken
        yield batch, out, exits


def admit_in_ranges(requests: DataFrame, key: str, at: str, order: str, limit: int = LIMIT, window: float = WINDOW_SECONDS, ranges: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Adds accepted boolean, as ``admit`` does, with any key's rows in several tasks.

    ``key``: of any type but floating point; null is a key of its own.  ``at``: a number, in the unit of ``window``; requests without one
    are not judged (accepted is null) and count for nothing.  Equal rows are interchangeable.  ``ranges``: tasks, by default as many as
    the session shuffles to.  Rows are placed once, in a written table; the driver holds ``limit`` numbers for each range, never rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = requests.sparkSession
    ship(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    timed, path = requests.where(F.col(at).isNotNull()), new_folder(spark, "admission")
    sortable = timed.repartitionByRange(ranges, key, at, order).sortWithinPartitions(key, at, order)
    sortable.withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)

    def fold(rows: DataFrame, by: str, entries: dict, carry: bool = False) -> dict[int, tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exits: dict = {}
            for _, _, exits in _decide(batches, key, at, limit, window, entries, carry):
                pass
            yield pa.RecordBatch.from_arrays([pa.array(list(exits), pa.int32()), pa.array([list(x) for x in exits.values()], times)], [RANGE, "taken"])

        kind = requests.schema[at].dataType
        times = pa.list_(to_arrow_type(kind))
        dealt = rows.select(RANGE, key, at, order).repartition(ranges, by).sortWithinPartitions(RANGE, key, at, order)
        found = dealt.mapInArrow(run, f"`{RANGE}` int, taken array<{kind.simpleString()}>").collect()
        return {r[RANGE]: tuple(r["taken"]) for r in found}

    # One row for each range: the first and the last key, and the first time.
    first, end = (f(F.struct(F.struct(key).alias("k"), at)) for f in (F.min, F.max))
    spans = {r[RANGE]: (r["a"].k[0], r["e"].k[0], r["a"][1]) for r in placed.groupBy(RANGE).agg(first.alias("a"), end.alias("e")).collect()}
    exits, used, count = fold(placed, RANGE, {}), {}, 0
    while True:
        entries, before = {}, None
        for r in sorted(spans):
            if before is not None and spans[before][1] == spans[r][0]:
                entries[r] = tuple(x for x in exits[before] if x >= spans[r][2] - window)
            before = r
        # Where a range holds several keys, what it leaves does not hang on what it got.
        todo = [r for r, e in entries.items() if spans[r][0] == spans[r][1] and e != used.get(r, ())]
        if not todo:
            break
        used |= {r: entries[r] for r in todo}
        count += 1
        if count <= rounds:
            exits |= fold(placed.where(F.col(RANGE).isin(todo)), RANGE, entries)
            continue
        # In turn: from each key's first range that is not settled to its last.
        starts = {}
        for r in todo:
            starts.setdefault(spans[r][0], r)
        rest = [r for r in sorted(spans) if spans[r][0] == spans[r][1] and r >= starts.get(spans[r][0], r + 1)]
        exits |= fold(placed.where(F.col(RANGE).isin(rest)), key, entries, carry=True)
        for a, b in zip(rest, rest[1:], strict=False):
            if spans[a][0] == spans[b][0]:
                used[b] = tuple(x for x in exits[a] if x >= spans[b][2] - window)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, accepted, _ in _decide(batches, key, at, limit, window, entries):
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(accepted, pa.bool_())], [*names, "accepted"])

    names = requests.columns
    dealt = placed.repartition(ranges, RANGE).sortWithinPartitions(RANGE, key, at, order)
    judged = dealt.mapInArrow(judge, StructType([*requests.schema.fields, StructField("accepted", BooleanType())]))
    return judged.unionByName(requests.where(F.col(at).isNull()).withColumn("accepted", F.lit(None).cast("boolean")))
