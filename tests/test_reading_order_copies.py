"""Rows of one page with equal keys: the first stored stands, in whichever order Spark reads the files."""

from __future__ import annotations

import datetime
import os

from corpusloom.plans import sources

KINDS = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp"


def test_first_stored_row_of_a_key_stands(spark, tmp_path):
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    day = datetime.datetime(2000, 1, 1)
    # The later file is the larger, which Spark reads first.
    for name, quantity, n in (("a", 1.0, 50), ("b", 2.0, 20_000)):
        spark.createDataFrame([(k, 7, 1, 1, quantity, day) for k in range(n)], KINDS).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        part = next(f for f in os.listdir(tmp_path / name) if f.endswith(".parquet"))
        os.rename(tmp_path / name / part, folder / f"{name}.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "256m")  # a task a file
    try:
        got = {r["page_id"]: r["y"] for r in sources._elements(spark, str(tmp_path)).where("page_id < 60").collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: 1.0 if k < 50 else 2.0 for k in range(60)}
