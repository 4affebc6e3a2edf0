"""Tables that one batch reads and then appends to: folders of numbered batches in the shared folder.

A batch sees what earlier batches wrote and writes a folder named by its own number, so a batch that runs again reads the same rows and
writes the same folder: replaying adds nothing.  Readers take complete batches only."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; one of our own only where all tasks run in this process."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, its path object) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the folders ``prefix``n below ``path`` that a write has completed, ascending."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return []
    done = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(prefix)]
    return sorted(int(p.getName().removeprefix(prefix)) for p in found if done(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


class Ledger:
    """An append-only table of numbered batches; ``schema``: its columns as DDL."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, StructType.fromDDL(schema)

    def _folders(self, before: int | None) -> list[str]:
        inside = lambda n: before is None or n < before
        merged = [n for n in complete(self.spark, self.path, "upto=") if inside(n)]
        since = merged[-1] if merged else -1
        later = [n for n in complete(self.spark, self.path, "batch=") if since < n and inside(n)]
        return [f"{self.path}/upto={since}"] * bool(merged) + [f"{self.path}/batch={n}" for n in later]

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of batches before ``before``."""
        folders = self._folders(before)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch: int) -> DataFrame:
        """Write a batch, in place of an earlier run of it; returns its rows, as written."""
        path = f"{self.path}/batch={batch}"
        rows.select(*self.schema.names).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def compact(self, before: int) -> None:
        """Merge the batches before ``before`` into one folder, then delete what it replaces.  Those batches cannot run again."""
        old = self._folders(before)
        numbers = [n for n in complete(self.spark, self.path, "batch=") if n < before]
        if not numbers or len(old) < 2:
            return
        self.read(before).write.mode("overwrite").parquet(f"{self.path}/upto={numbers[-1]}")
        for folder in old:
            delete(self.spark, folder)


class Buckets:
    """A table of the newest row of each key, in buckets of keys: a batch rewrites the buckets that its keys fall into, and no other.

    ``path``/data/version=N/_bucket=B holds what batch N wrote; ``path``/manifest/N says which version of each bucket stands after it.
    The manifest is written last, by a rename, so readers see a batch whole or not at all, and a batch that runs again starts from the
    manifest before it.  ``schema``: the columns as DDL; ``n``: buckets, so that one of them is a task's work."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, n: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.n = spark, path, StructType.fromDDL(schema), key, order, n

    def _manifests(self) -> list[int]:
        fs, root = file_system(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(x) for x in names if x.isdigit())

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Version of each bucket that has rows: at most ``n`` of them."""
        numbers = [x for x in self._manifests() if before is None or x < before]
        if not numbers:
            return {}
        fs, p = file_system(self.spark, f"{self.path}/manifest/{numbers[-1]}")
        source = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _put(self, batch: int, found: dict[int, int]) -> None:
        fs, p = file_system(self.spark, f"{self.path}/manifest/{batch}")
        part = file_system(self.spark, f"{self.path}/manifest/.{batch}.{uuid.uuid4().hex}")[1]
        out = fs.create(part)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(part, p)

    def _rows(self, found: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/version={v}/_bucket={b}" for b, v in sorted(found.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        return self._rows(self.manifest(before))

    def upsert(self, rows: DataFrame, batch: int) -> list[int]:
        """Put ``rows``; returns the buckets written.  The newest row of a key stands; of equally new ones that of the later batch."""
        names = self.schema.names
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n)).cast("int")
        new = rows.select(*names).groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(self.order, *names)).alias("r")).select("r.*")
        touched = [r["b"] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most ``n``
        if not touched:
            return []
        old = self.manifest(batch)
        both = self._rows({b: v for b, v in old.items() if b in touched}).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        newest = both.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(self.order, "_new")).alias("r")).select("r.*")
        dealt = newest.withColumn("_bucket", bucket).repartition("_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/version={batch}")
        self._put(batch, old | dict.fromkeys(touched, batch))
        return sorted(touched)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the last ``keep`` manifests names; returns the number of folders deleted."""
        numbers = self._manifests()
        kept = set()
        for x in numbers[-keep:]:
            kept |= {(v, b) for b, v in self.manifest(x + 1).items()}
        fs, root = file_system(self.spark, f"{self.path}/data")
        gone = 0
        for version in fs.listStatus(root) if fs.exists(root) else []:
            v = int(version.getPath().getName().split("=")[1])
            if v > numbers[-1]:  # being written
                continue
            parts = [s.getPath() for s in fs.listStatus(version.getPath()) if s.getPath().getName().startswith("_bucket=")]
            old = [p for p in parts if (v, int(p.getName().split("=")[1])) not in kept]
            for p in parts if len(old) == len(parts) else old:
                fs.delete(p, True)
            gone += len(old)
            if len(old) == len(parts):
                fs.delete(version.getPath(), True)
        for x in numbers[:-keep]:
            delete(self.spark, f"{self.path}/manifest/{x}")
        return gone
