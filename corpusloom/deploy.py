"""Sends the package to the executors, so that worker processes can import it wherever they start."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


#: Rows that cross to a Python worker at once: whole documents, so far fewer than Spark's default.
ROWS_PER_BATCH = "2000"
#: And so many bytes, whatever the length of a row: an executor holds a batch for each running task beside its heap.
BYTES_PER_BATCH, SPARKS_BYTES = str(4 << 20), "67108864b"
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once for each application; a session's batches for Python workers are made small."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(ROWS_PER_BATCH):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    if spark.conf.get(BYTES_SETTING) == SPARKS_BYTES:  # a caller's own bound stays
        spark.conf.set(BYTES_SETTING, BYTES_PER_BATCH)
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("corpusloom", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped[context.applicationId] = target
