"""Answers from one row of facts a customer, against the template of each intent run by itself."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from corpusloom.operators import accounts as a
from corpusloom.operators.answering import account_facts, lookup

AS_OF = "2024-06-30"
SCHEMA = "id long, tenant_id string, customer_id long, amount decimal(12,2), merchant string, category string, date date, type string, description string, flagged boolean"
ASKED = {
    "What is my current balance?": "balance", "Any suspicious ones?": "flagged", "breakdown please": "by_category", "How much have I spent this week": "spending_period",
    "spending": "spending_period", "last 3 transactions": "recent", "recent 75 of them": "recent", "": "recent",
}


def _transactions(spark):
    """Customer 1 has most of the rows, flagged ones behind its newest 50, categories beyond the limit, ties, nulls and later days; 2 has one credit."""
    day = dt.date(2024, 7, 3)
    rows = [
        (i % 400, "t", 1, Decimal((i % 37 - 20) * 7) / 4, None if i % 53 == 0 else f"m{i % 9}", None if i % 31 == 0 else f"c{i % 29}", None if i % 47 == 0 else day - dt.timedelta(days=i // 3),
         ("debit", "credit", None)[i % 7 % 3], (None, "", f"d{i}")[i % 3], (None, False, i > 120)[i % 3])
        for i in range(1500)
    ]
    rows += [(1, "t", 2, Decimal("12.30"), "m", "c", day, "credit", None, True), (1, "u", 1, Decimal("-5.00"), "m", None, dt.date(2024, 6, 25), "debit", "x", False), (2, None, 3, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _questions(spark):
    customers = [("t", 1), ("t", 2), ("u", 1), ("t", 99), (None, 3)]
    rows = [(n * 100 + i, t, c, q) for n, (t, c) in enumerate(customers) for i, q in enumerate(ASKED)]
    return spark.createDataFrame(rows, "query_id long, tenant_id string, customer_id long, question string")


def test_each_intent_as_its_template(spark):
    t = _transactions(spark)
    got = {(r["query_id"] // 100, r["query_id"] % 100): (r["intent"], r["account_result"]) for r in lookup(_questions(spark), t, AS_OF).collect()}
    zero = "Spending in the last {} days: $0.00\nNumber of debit transactions: 0\nAverage per transaction: $0.00"
    answers = [
        a.render_balance(a.balance(t)), a.render_flagged(a.flagged(t)), a.render_categories(a.by_category(t)), a.render_spending(a.spending_period(t, AS_OF, 7), 7),
        a.render_spending(a.spending_period(t, AS_OF), 30), a.render_transactions(a.recent(t, 3)), a.render_transactions(a.recent(t, 50)), a.render_transactions(a.recent(t)),
    ]
    for i, (answer, intent) in enumerate(zip(answers, ASKED.values(), strict=True)):
        found = {(r["tenant_id"], r["customer_id"]): r["answer"] for r in answer.collect() if r["tenant_id"] is not None}
        default = {3: zero.format(7), 4: zero.format(30)}.get(i, a.NOTHING_FOUND)
        for n, customer in enumerate([("t", 1), ("t", 2), ("u", 1), ("t", 99), (None, 3)]):
            assert got[n, i] == (intent, found.get(customer, default)), (customer, intent)


def test_facts_have_one_bounded_row_a_customer(spark):
    rows = account_facts(_transactions(spark), AS_OF).select(*a.KEYS, F.size("categories"), F.size("days_spent"), F.size("newest")).collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows}) == 4
    assert all(r[2] <= a.LIST_LIMIT and r[3] <= a.MAX_DAYS + 1 and r[4] <= 2 * a.ROW_LIMIT for r in rows)


def test_no_transactions(spark):
    rows = lookup(_questions(spark), _transactions(spark).limit(0), AS_OF).collect()
    assert len(rows) == 5 * len(ASKED) and all(r["account_result"] for r in rows)
