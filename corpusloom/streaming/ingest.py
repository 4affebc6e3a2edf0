"""Streams into stored tables: upserts by key, and counts by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.storage import Buckets


def upsert_stream(rows: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Keep the newest row of each key below ``path``: every micro-batch rewrites the buckets of its keys (``storage.Buckets``), a batch
    that runs again writes the same, and what only manifests before the last ``keep`` name is deleted."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def write(batch: DataFrame, number: int) -> None:
        table = Buckets(batch.sparkSession, path, schema, key, order, buckets)
        table.upsert(batch, number)
        table.vacuum(keep)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: Column, window: str = "1 hour", late: str = "1 day", *keys: str) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn("event_time", at).withWatermark("event_time", late)
    counts = rows.groupBy(F.window("event_time", window), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n")
