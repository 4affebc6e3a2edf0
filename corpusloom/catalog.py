"""All registered queries of the engine, with the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import accounts, answers, flow, retrieval, sources, store, text

PLANS = (text, retrieval, accounts, store, sources, answers, flow)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in PLANS for k, s in p.ORACLE_SQL.items()}
ENTRY = "sparse_topk"
