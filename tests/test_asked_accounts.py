"""Accounts that nobody asks about leave the transactions before they are joined."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans import answers
from corpusloom.plans import views as v


def test_orders_of_others_are_left_out_before_the_joins(spark, tiny):
    want = v.transactions(spark, tiny).where("customer_id % 7 = 3")
    asked = v.table(spark, tiny, "customer").where("c_custkey % 7 = 3").select(F.col("c_custkey").alias("customer_id"))
    got = v.transactions(spark, tiny, asked.unionByName(asked))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_lookup_joins_line_items_to_orders_of_askers_only(spark, tiny):
    for query in (answers.lookup_answers, answers.answer_batch):
        plan = query(spark, tiny)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        at = next(i for i, line in enumerate(plan) if "Join Inner, (l_orderkey" in line)
        below = []
        for line in plan[at + 1 :]:
            if depth(line) <= depth(plan[at]):
                break
            below.append(line)
        assert any("Join LeftSemi, (o_custkey" in line for line in below)
