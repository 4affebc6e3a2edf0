"""What the training-data operators share: table access, scratch space, file access from workers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.deploy import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Intermediate tables have small row groups: a writer holds one in memory, uncompressed, for each task.
ROW_GROUP = {"parquet.block.size": str(16 << 20)}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all tasks run on this machine (tests), a folder
    is made; on a cluster that names none this is an error, since each machine would write to a folder of its own.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors.

    The shuffle files of this one write go as soon as it has ended, since nothing else can read them."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    for made in getattr(_scopes, "open", ()):
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes = threading.local()


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes within go when it ends; what is to stay must have been written elsewhere by then."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    made: list[str] = []
    _scopes.open.append(made)
    try:
        yield
    finally:
        _scopes.open.pop()
        for path in made:
            release(spark, path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch path (any file system that Spark can reach)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files whose plans are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id as decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder URI, for use in workers."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when complete; equal attempts of one task replace each other."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def arrow_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups_by_bytes(items: list[bytes], most: int) -> Iterable[tuple[int, int]]:
    """Consecutive [begin, end) ranges of at most ``most`` bytes, one item at least."""
    begin = total = 0
    for i, x in enumerate(items):
        if i > begin and total + len(x) > most:
            yield begin, i
            begin, total = i, 0
        total += len(x)
    if begin < len(items):
        yield begin, len(items)


_kept: dict[str, object] = {}
_libc: list = []


def enter(operator: str, free=None) -> None:
    """Called by a task when it begins: frees what other operators keep in this worker process (``free`` frees what this one will
    keep), and gives memory that is no longer used back to the system.  The first call sets the C library's allocator to few
    arenas, so that a worker shrinks again after a large batch."""
    import ctypes

    import pyarrow as pa

    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    for name in [n for n in _kept if n != operator]:
        _kept.pop(name)()
    if free:
        _kept[operator] = free
    pa.default_memory_pool().release_unused()
    try:
        if not _libc:
            _libc.append(ctypes.CDLL("libc.so.6"))
            _libc[0].mallopt(-8, 2)  # arenas
        _libc[0].malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file; an environment without them passes its own path."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
