"""Answers to all intents come from transactions that are joined and stored once, a customer's rows together."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans import accounts
from corpusloom.plans import views as v


def test_templates_read_one_stored_table(spark, tiny):
    read = accounts.intent_formatted(spark, tiny).inputFiles()
    assert read and not [f for f in read if f.startswith(f"file://{tiny}/")]
    stored = spark.read.parquet(*read)
    t = v.transactions(spark, tiny)
    assert stored.exceptAll(t).isEmpty() and t.exceptAll(stored).isEmpty()
    files = stored.select(*accounts.a.KEYS, F.col("_metadata.file_path").alias("f")).distinct().groupBy(*accounts.a.KEYS).count()
    assert files.agg(F.max("count")).first()[0] == 1


def test_orders_meet_their_customers_before_line_items(spark, tiny):
    """Of the joins that hold line items none is with customers, nations or regions."""
    plan = v.transactions(spark, tiny)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Join Inner, (o_custkey" in line)
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert below and not [line for line in below if "l_orderkey" in line]
