"""Account questions: six parameterised templates over transactions, for all customers at once, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the templates.
ROW_LIMIT, LIST_LIMIT, DEFAULT_LIMIT, DEFAULT_DAYS, MAX_DAYS = 50, 20, 10, 30, 365
INTENTS = ["balance", "recent", "flagged", "spending_period", "by_category", "by_merchant"]
KEYS = ["tenant_id", "customer_id"]
NOTHING_FOUND = "No transactions found matching your query."


def balance(t: DataFrame) -> DataFrame:
    credit, debit = F.col("type") == "credit", F.col("type") == "debit"
    return t.groupBy(*KEYS).agg(
        F.sum("amount").alias("balance"),
        F.count("*").alias("total_transactions"),
        F.sum(F.when(credit, F.col("amount")).otherwise(0)).alias("total_credits"),
        F.sum(F.when(debit, F.abs("amount")).otherwise(0)).alias("total_debits"),
    )


def newest_first() -> list:
    """The order of rows from the newest on; ties go by columns."""
    return [F.desc("date"), "id", "amount", "merchant", "category"]


def _newest(t: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy(*KEYS).orderBy(*newest_first())
    return t.withColumn("n", F.row_number().over(order)).where(F.col("n") <= min(limit, ROW_LIMIT))


def recent(t: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return _newest(t, max(1, limit))


def flagged(t: DataFrame) -> DataFrame:
    return _newest(t.where("flagged"), LIST_LIMIT)


def spending_period(t: DataFrame, as_of: str, days: int = DEFAULT_DAYS) -> DataFrame:
    """Debits of the ``days`` days before ``as_of`` (a date as text), in place of the current date."""
    rows = t.where((F.col("type") == "debit") & (F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return rows.groupBy(*KEYS).agg(F.sum(F.abs("amount")).alias("total_spent"), F.count("*").alias("num_transactions"), F.min("date").alias("from_date"), F.max("date").alias("to_date"))


def by_category(t: DataFrame) -> DataFrame:
    rows = t.where("type = 'debit'").groupBy(*KEYS, "category").agg(F.sum(F.abs("amount")).alias("total"), F.count("*").alias("count"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("total"), F.asc("category"))
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= LIST_LIMIT)


def by_merchant(t: DataFrame, pattern: str | None = None) -> DataFrame:
    return _newest(t.where(F.col("merchant").ilike(pattern or "%")), LIST_LIMIT)


def safe_intent(raw: DataFrame) -> DataFrame:
    """intent, limit, days and merchant (a pattern) from untrusted text columns of the same names."""

    def clamp(c: str, default: int, most: int) -> Column:
        n = F.expr(f"try_cast({c} AS INT)")
        return F.least(F.greatest(F.coalesce(F.nullif(n, F.lit(0)), F.lit(default)), F.lit(1)), F.lit(most))

    merchant = F.trim(F.translate(F.left("merchant", F.lit(100)), "_%", " "))
    return raw.withColumns(
        {
            "intent": F.when(F.col("intent").isin(INTENTS), F.col("intent")).otherwise("recent"),
            "limit": clamp("limit", DEFAULT_LIMIT, ROW_LIMIT),
            "days": clamp("days", DEFAULT_DAYS, MAX_DAYS),
            "merchant": F.when(F.coalesce("merchant", F.lit("")) != "", F.concat(F.lit("%"), merchant, F.lit("%"))),
        }
    )


# Words that give an intent away, in order of precedence.
INTENT_WORDS = [
    ("balance", ["balance", "account total", "how much money"]),
    ("flagged", ["flagged", "suspicious", "unusual", "blocked"]),
    ("by_category", ["category", "breakdown"]),
    ("spending_period", ["spending", "spent", "this month", "this week"]),
]


def any_of(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def fallback_intent(question: Column) -> dict[str, Column]:
    """intent, limit and days of a question by rules."""
    q = F.lower(question)
    intent = F.lit("recent")
    for name, phrases in reversed(INTENT_WORDS):
        intent = F.when(any_of(q, phrases), F.lit(name)).otherwise(intent)
    number = F.regexp_extract(q, r"\b(?:last|recent)\s+(\d{1,2})\b", 1)
    limit = F.when(number != "", F.least(F.greatest(F.expr("1"), F.nullif(number, F.lit("")).cast("int")), F.lit(ROW_LIMIT))).otherwise(DEFAULT_LIMIT)
    days = F.when(F.contains(q, F.lit("week")), 7).when(F.contains(q, F.lit("month")), 30).otherwise(DEFAULT_DAYS)
    return {"intent": intent, "limit": limit, "days": days}


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.coalesce(c.cast("double"), F.lit(0.0)), 2))


def balance_text(balance: Column, credits: Column, debits: Column, n: Column) -> Column:
    signed = F.when(F.coalesce(balance, F.lit(0)) >= 0, F.concat(F.lit("+"), money(balance))).otherwise(F.concat(F.lit("$"), F.format_number(balance.cast("double"), 2)))
    return F.concat(
        F.lit("Current account balance: "), signed, F.lit("\nTotal credits received: "), money(credits), F.lit("\nTotal debits made: "), money(debits),
        F.lit("\nTotal transactions on record: "), n.cast("string"),
    )


def render_balance(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, balance_text(*(F.col(c) for c in ("balance", "total_credits", "total_debits", "total_transactions"))).alias("answer"))


def spending_text(days: Column, spent: Column, n: Column) -> Column:
    mean = F.when(n > 0, spent.cast("double") / n).otherwise(0.0)
    return F.concat(
        F.lit("Spending in the last "), days, F.lit(" days: "), money(spent), F.lit("\nNumber of debit transactions: "), n.cast("string"), F.lit("\nAverage per transaction: "), money(mean)
    )


def render_spending(rows: DataFrame, days: int) -> DataFrame:
    return rows.select(*KEYS, spending_text(F.lit(str(days)), F.col("total_spent"), F.col("num_transactions")).alias("answer"))


def _listed(rows: DataFrame, head: Column, line: Column) -> DataFrame:
    """One text a customer: ``head`` over the count ``_rows``, then ``line`` of each row in the order of n."""
    found = rows.groupBy(*KEYS).agg(F.count("*").alias("_rows"), F.array_sort(F.collect_list(F.struct("n", line.alias("l")))).alias("_lines"))
    return found.select(*KEYS, F.array_join(F.concat(F.array(head), F.transform("_lines", lambda x: x.l)), "\n").alias("answer"))


def category_line(category: Column, total: Column, n: Column) -> Column:
    return F.concat(F.lit("  "), F.coalesce(category, F.lit("Unknown")), F.lit(": "), money(total), F.lit(" ("), n.cast("string"), F.lit(" transactions)"))


def render_categories(rows: DataFrame) -> DataFrame:
    return _listed(rows, F.lit("Spending breakdown by category:"), category_line(F.col("category"), F.col("total"), F.col("count")))


def transaction_line(mark: str, describe: bool) -> Column:
    parts = [F.lit("  "), F.col("date").cast("string"), F.lit(" | "), F.col("merchant"), F.lit(" | "), money(F.abs("amount")), F.lit(" ("), F.col("type"), F.lit(")")]
    if describe:
        parts.append(F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(""))
    return F.concat(*parts, F.when(F.col("flagged"), mark).otherwise(""))


def render_transactions(rows: DataFrame) -> DataFrame:
    return _listed(rows, F.concat(F.lit("Transactions ("), F.col("_rows").cast("string"), F.lit(" results):")), transaction_line(" ⚠️", True))


def render_flagged(rows: DataFrame) -> DataFrame:
    return _listed(rows, F.concat(F.lit("Flagged / suspicious transactions ("), F.col("_rows").cast("string"), F.lit(" found):")), transaction_line(" ⚠️ FLAGGED", False))


def distinct_transactions(t: DataFrame) -> DataFrame:
    """One of the rows that agree in every column but the id; no description counts as an empty one."""
    key = [*KEYS, "amount", "merchant", "category", "date", "type", "flagged"]
    own = t.withColumn("_d", F.coalesce("description", F.lit("")))
    order = Window.partitionBy(*key, "_d").orderBy("id")
    return own.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_d")
