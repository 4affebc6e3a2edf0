"""Ingestion with failure classes, attempts by due time and dead letters, batch by batch or as a stream.

Every file is attempted until it succeeds, fails for good or has used up its attempts.  A file's history is rows of ``attempts``, one for
each (file, attempt); what comes next follows from the last of them.  Batches append to ``Ledger`` tables under their own number and read
only earlier ones, so a batch that runs again repeats its attempts and adds nothing: exactly one row for each (file, attempt)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.storage import Ledger

# Errors worth another attempt, and how many a file gets.
TRANSIENT = ["ConnectionError", "TimeoutError", "OSError"]
#: Names of errors of those kinds.
TRANSIENT_KINDS = [*TRANSIENT, "BrokenPipeError", "ConnectionAbortedError", "ConnectionRefusedError", "ConnectionResetError", "BlockingIOError", "InterruptedError", "FileNotFoundError", "PermissionError"]
RETRIES = 3
#: Seconds before the first repeat; each later one waits twice as long.
BASE_DELAY, JITTER = 2, 0.25

FILES = "file_hash string, path string, content binary, arrived_at bigint, batch int"
ATTEMPTS = "file_hash string, path string, attempt int, error string, kind string, attempted_at bigint, due_at bigint, batch int"
DONE, TRANSIENT_KIND, PERMANENT = "done", "transient", "permanent"


def failure_class(error: Column) -> Column:
    """done without an error, else transient or permanent by the error's name, which stands before the first colon."""
    name = F.trim(F.split_part(error, F.lit(":"), F.lit(1)))
    return F.when(error.isNull(), DONE).when(name.isin(TRANSIENT_KINDS), TRANSIENT_KIND).otherwise(PERMANENT)


def delay(file_hash: Column, attempt: Column) -> Column:
    """Whole seconds until the next attempt: exponential, and up to a quarter longer by a hash of file and attempt, so that files that
    failed together do not come back together, and a batch that runs again computes the same."""
    wait = F.lit(BASE_DELAY) * F.pow(F.lit(2.0), attempt - 1)
    spread = F.pmod(F.xxhash64(file_hash, attempt), F.lit(1000)) / 1000.0 * JITTER
    return F.ceil(wait * (1 + spread)).cast("long")


def last_attempts(attempts: DataFrame) -> DataFrame:
    """The last attempt of each file, with state: done, waiting (due again) or dead."""
    cols = [c for c in attempts.columns if c != "file_hash"]
    last = attempts.groupBy("file_hash").agg(F.max_by(F.struct(*cols), "attempt").alias("l")).select("file_hash", "l.*")
    state = F.when(F.col("kind") == DONE, "done").when(F.col("due_at").isNotNull(), "waiting").otherwise("dead")
    return last.withColumn("state", state)


class Ingestion:
    """``parse``: (file_hash, path, content, attempt) rows to rows with file_hash, error (null if good) and the columns of ``result``."""

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], result: str, retries: int = RETRIES):
        self.spark, self.parse, self.retries = spark, parse, retries
        self.inbox, self.attempts = Ledger(spark, f"{path}/inbox", FILES), Ledger(spark, f"{path}/attempts", ATTEMPTS)
        self.results = Ledger(spark, f"{path}/results", f"file_hash string, {result}")
        self._parsed = Ledger(spark, f"{path}/parsed", f"file_hash string, attempt int, path string, {result}, error string")

    def step(self, files: DataFrame, batch: int, now: int | None = None) -> None:
        """Attempt new files (file_hash, path, content, arrived_at), and those that are due at ``now`` (else the latest arrival)."""
        names = ("file_hash", "path", "content", "arrived_at")
        known = self.inbox.read(before=batch)
        first = files.select(*names).groupBy("file_hash").agg(F.min_by(F.struct("path", "content", "arrived_at"), F.struct("arrived_at", "path")).alias("f")).select("file_hash", "f.*")
        new = self.inbox.append(first.join(known.select("file_hash"), "file_hash", "left_anti").withColumn("batch", F.lit(batch)), batch)
        if now is None:
            now = new.agg(F.max("arrived_at")).first()[0]
            now = known.agg(F.max("arrived_at")).first()[0] if now is None else now
        before = last_attempts(self.attempts.read(before=batch))
        due = before.where((F.col("state") == "waiting") & (F.col("due_at") <= F.lit(now).cast("long")))
        again = known.join(due.select("file_hash", (F.col("attempt") + 1).alias("attempt")), "file_hash")
        tried = new.withColumn("attempt", F.lit(1)).unionByName(again).select("file_hash", "path", "content", "attempt")
        parsed = self._parsed.append(self.parse(tried).join(tried.select("file_hash", "path", "attempt"), "file_hash"), batch)
        # A file fails if any of its rows has an error; all good rows of a good file are its result.
        told = parsed.groupBy("file_hash", "path", "attempt").agg(F.min("error").alias("error"))
        told = told.withColumn("kind", failure_class(F.col("error"))).withColumn("attempted_at", F.lit(now).cast("long"))
        due_at = F.when((F.col("kind") == TRANSIENT_KIND) & (F.col("attempt") <= self.retries), F.col("attempted_at") + delay(F.col("file_hash"), F.col("attempt")))
        told = self.attempts.append(told.withColumns({"due_at": due_at, "batch": F.lit(batch)}), batch)
        self.results.append(parsed.join(told.where(F.col("kind") == DONE).select("file_hash"), "file_hash", "left_semi"), batch)

    def stream(self, files: DataFrame, checkpoint: str) -> StreamingQuery:
        """All files that a stream holds now, a batch a trigger; time is that of arrival."""
        return files.writeStream.foreachBatch(lambda rows, number: self.step(rows, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def states(self) -> DataFrame:
        """The last attempt of every file and its state."""
        return last_attempts(self.attempts.read())

    def dead_letters(self) -> DataFrame:
        """Files that were given up: permanent failures, and transient ones without attempts left."""
        return self.states().where("state = 'dead'").select("file_hash", "path", "error", "kind", F.col("attempt").alias("attempts"), "attempted_at")
