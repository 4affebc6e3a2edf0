"""The library without the training-data operators: a copy that lacks their folders still registers its queries and answers the entry."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
from corpusloom import catalog
assert not e.HAS_LLM and not e.HAS_PIPELINE
assert set(e.queries()) == set(catalog.QUERIES), set(e.queries()) ^ set(catalog.QUERIES)
assert set(e.oracle_sql()) == set(catalog.ORACLE_SQL)
if __import__("os").path.exists("corpus_pipeline.py"):  # one of the two copies answers too
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_copy_without_the_folders(tmp_path, pipeline):
    """With and without corpus_pipeline.py, which may be left behind or deleted along with the folders."""
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(f"{ROOT}/corpusloom", copy / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", copy)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, check=False)
    assert done.returncode == 0, done.stderr
