"""Idempotent ingestion: hashes, gates, state transitions, upserts, points, batches, deletes and logs.

Tables are DataFrames; every operator returns the new rows or the new table, to be appended or to overwrite partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a file, and batch sizes of the vector store and the embedding model.
COMPLETE, PROCESSING = "complete", "processing"
UPSERT_BATCH, EMBED_BATCH = 256, 90


def hash_of(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def hash_gate(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files whose content has not been ingested completely."""
    return files.join(status.where(F.col("status") == COMPLETE).select("file_hash"), "file_hash", "left_anti")


def first_of_each_hash(files: DataFrame, order: str) -> DataFrame:
    """One file of each content, that with the smallest ``order``.  A hash aggregate, so copies shrink before the shuffle."""
    cols = [c for c in files.columns if c not in ("file_hash", order)]
    first = files.groupBy("file_hash").agg(F.min_by(F.struct(order, *cols), order).alias("f"))
    return first.select("file_hash", "f.*")


def upload_actions(files: DataFrame, status: DataFrame) -> DataFrame:
    """Adds action: skip what is complete, restart what was left in progress (its partial rows go first), ingest the rest."""
    known = status.select("file_hash", F.col("status").alias("_status"))
    action = F.when(F.col("_status") == COMPLETE, "skip").when(F.col("_status") == PROCESSING, "restart").otherwise("ingest")
    return files.join(known, "file_hash", "left").withColumn("action", action).drop("_status")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key by ``order``; of equal ones the one from ``new``."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = old.columns
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, "_new")).alias("r"))
    return newest.select("r.*")


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` does not have, one for each key."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def points(chunks: DataFrame, tenant_id: str = "") -> DataFrame:
    """Stored points: dense (empty if missing), sparse indices and values (empty if missing), payload with the tenant."""
    tenant = F.lit(tenant_id) if tenant_id else F.col("tenant_id")
    payload = F.struct("text", "file_name", "file_hash", "page", "chunk_index", tenant.alias("tenant_id"))
    return chunks.select(
        F.sha2(F.concat_ws("|", "file_hash", F.col("chunk_index").cast("string")), 256).alias("point_id"),
        F.coalesce("dense", F.array().cast("array<float>")).alias("dense"),
        F.coalesce(F.map_keys("sparse"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.map_values("sparse"), F.array().cast("array<double>")).alias("values"),
        payload.alias("payload"),
    )


def batches(rows: DataFrame, key: str, order: str, size: int = UPSERT_BATCH) -> DataFrame:
    """Adds batch int: consecutive batches of ``size`` rows within ``key``."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(number / size).cast("int"))


def delete_files(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The table without the rows of these file hashes."""
    return rows.join(hashes.select("file_hash").distinct(), "file_hash", "left_anti")


def assign_tenants(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """tenant_id from (file_name, tenant_id); files that are not mapped keep theirs."""
    m = mapping.select("file_name", F.col("tenant_id").alias("_tenant"))
    return rows.join(m, "file_name", "left").withColumn("tenant_id", F.coalesce("_tenant", "tenant_id")).drop("_tenant")


def tenant_counts(rows: DataFrame) -> DataFrame:
    """Points of each tenant, and of all in the row with a null tenant."""
    return rows.rollup("tenant_id").agg(F.count("*").alias("n"))


def mark_cited(chunks: DataFrame, cited: DataFrame) -> DataFrame:
    """cited becomes true where (query_id, tenant_id, source) is a cited file of the query."""
    marks = cited.select("query_id", "tenant_id", "source").distinct().withColumn("_c", F.lit(True))
    joined = chunks.join(marks, ["query_id", "tenant_id", "source"], "left")
    return joined.withColumn("cited", F.coalesce("_c", "cited")).drop("_c")


def audit_rows(results: DataFrame) -> DataFrame:
    """One log row a query, whether it succeeded or failed; its key is the query's id."""
    return results.select(
        F.col("query_id").alias("id"),
        "tenant_id",
        "customer_id",
        "question",
        "query_type",
        "data_source",
        "answer",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.col("faithfulness").cast("decimal(4,3)").alias("faithfulness"),
        F.col("relevance").cast("decimal(4,3)").alias("relevance"),
        F.col("latency_ms").cast("decimal(10,2)").alias("latency_ms"),
        "error",
        "created_at",
    )


def split_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows) of a parser's output with a column error."""
    return parsed.where(F.col("error").isNull()).drop("error"), parsed.where(F.col("error").isNotNull())


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
