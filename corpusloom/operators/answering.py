"""A batch of questions from routing to evaluated answers.

Stages are projections and joins over a DataFrame of questions; column retry says which rows need a second pass, which ``operators.flow``
makes, with cache and log.  Models are columns: without one, account questions are answered in full, the others by the sentence for no answer
when nothing was found, else by what the caller's ``written`` column says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import accounts, routing

KEYS = accounts.KEYS


def account_facts(transactions: DataFrame, as_of: str) -> DataFrame:
    """One row a customer, of bounded size, from which every template but the merchant's is answered: totals, at most ``LIST_LIMIT`` categories, debits
    of the last ``MAX_DAYS`` days by day (later days count as ``as_of``), and the newest ``ROW_LIMIT`` rows, flagged ones and others.

    One aggregate over three sets of keys and one top-k; a customer with most of the rows is summed and cut before the shuffle."""
    debit = F.col("type") == "debit"
    spent = F.when(debit, F.abs("amount"))
    last = F.lit(as_of).cast("date")
    day = F.when(debit & (F.col("date") >= F.date_sub(last, accounts.MAX_DAYS)), F.least("date", last))
    rows = transactions.withColumns({"_day": day, "_spent": spent, "_group": F.when(debit, F.struct("category"))})
    keys = [F.col(k) for k in KEYS]
    sums = rows.groupingSets([keys, [*keys, F.col("_group")], [*keys, F.col("_day")]], *keys, F.col("_group"), F.col("_day")).agg(
        F.grouping_id().alias("_set"),
        F.sum("amount").alias("balance"),
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("type") == "credit", F.col("amount"))), F.lit(0)).alias("credits"),
        F.sum("_spent").alias("spent"),
        F.count(F.when(debit, 1)).alias("debits"),
    )
    # Bits of _set, the first key highest: 3 for totals, 1 for categories, 2 for days.
    totals, categories, days = F.col("_set") == 3, (F.col("_set") == 1) & F.col("_group").isNotNull(), (F.col("_set") == 2) & F.col("_day").isNotNull()
    largest = Window.partitionBy(*KEYS, "_set").orderBy(F.desc("spent"), F.asc("_group"))
    sums = sums.where(totals | categories | days).withColumn("n", F.row_number().over(largest)).where(F.col("n") <= accounts.MAX_DAYS + 1)
    sums = sums.where((F.col("_set") != 1) | (F.col("n") <= accounts.LIST_LIMIT)).select(
        *KEYS,
        F.when(totals, F.struct("balance", F.col("rows").alias("total_transactions"), F.col("credits").alias("total_credits"), F.coalesce("spent", F.lit(0)).alias("total_debits"))).alias("totals"),
        F.when(categories, F.struct("n", accounts.category_line(F.col("_group.category"), F.col("spent"), F.col("debits")).alias("line"))).alias("category"),
        F.when(days, F.struct(F.col("_day").alias("day"), "spent", "debits")).alias("day"),
    )
    newest = Window.partitionBy(*KEYS, "_marked").orderBy(*accounts.newest_first())
    top = rows.withColumn("_marked", F.coalesce("flagged", F.lit(False))).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= accounts.ROW_LIMIT)
    top = top.select(
        *KEYS,
        F.struct(
            F.coalesce(-F.unix_date("date"), F.lit(2**31 - 1)).alias("age"), "id", "amount", "merchant", "category",
            accounts.transaction_line(" ⚠️", True).alias("line"), F.when(F.col("_marked"), accounts.transaction_line(" ⚠️ FLAGGED", False)).alias("flagged_line"), F.col("_marked").alias("marked"),
        ).alias("newest"),
    )
    both = sums.unionByName(top, allowMissingColumns=True)
    return both.groupBy(*KEYS).agg(
        F.max("totals").alias("totals"), F.array_sort(F.collect_list("category")).alias("categories"), F.collect_list("day").alias("days_spent"), F.array_sort(F.collect_list("newest")).alias("newest")
    )


def _account_result(as_of: str) -> Column:
    """The answer from the columns of ``account_facts`` and a question's intent, limit and days."""
    lines = lambda head, rows, of: F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(head(F.size(rows).cast("string"))), F.transform(rows, of)), "\n"))
    totals = F.col("totals")
    recent = F.slice("newest", F.lit(1), F.col("limit"))
    flagged = F.slice(F.filter("newest", lambda x: x.marked), 1, accounts.LIST_LIMIT)
    since = F.date_sub(F.lit(as_of).cast("date"), F.col("days"))
    met = F.filter("days_spent", lambda x: x.day >= since)
    spent = F.aggregate(met, F.lit(0).cast("decimal(38,2)"), lambda s, x: (s + x.spent).cast("decimal(38,2)"))
    count = F.aggregate(met, F.lit(0).cast("bigint"), lambda s, x: s + x.debits)
    known = {
        "balance": F.when(totals.isNotNull(), accounts.balance_text(*(totals[c] for c in ("balance", "total_credits", "total_debits", "total_transactions")))),
        "flagged": lines(lambda n: F.concat(F.lit("Flagged / suspicious transactions ("), n, F.lit(" found):")), flagged, lambda x: x.flagged_line),
        "by_category": lines(lambda n: F.lit("Spending breakdown by category:"), F.col("categories"), lambda x: x.line),
        "spending_period": accounts.spending_text(F.col("days").cast("string"), F.coalesce(spent, F.lit(0)), F.coalesce(count, F.lit(0))),
    }
    out = lines(lambda n: F.concat(F.lit("Transactions ("), n, F.lit(" results):")), recent, lambda x: x.line)
    for intent, text in known.items():
        out = F.when(F.col("intent") == intent, text).otherwise(out)
    return F.coalesce(out, F.lit(accounts.NOTHING_FOUND))


def with_account_results(questions: DataFrame, transactions: DataFrame, as_of: str, needed: Column | None = None) -> DataFrame:
    """``questions`` with intent (by the rules) and account_result, the latter null where ``needed`` is not true.

    The facts of all customers that ask are made in one go and joined once; limits and days are the question's own."""
    needed = F.lit(True) if needed is None else F.coalesce(needed, F.lit(False))
    q = questions.withColumn("_needed", needed).withColumns(accounts.fallback_intent(F.col("question")))
    asked = transactions.join(q.where("_needed").select(*KEYS).distinct(), KEYS, "left_semi")
    rows = q.join(account_facts(asked, as_of), KEYS, "left")
    return rows.select(*(questions[c] for c in questions.columns if c not in KEYS), *KEYS, "intent", F.when(F.col("_needed"), _account_result(as_of)).alias("account_result"))


def lookup(questions: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    """(query_id, intent, account_result) of questions (query_id, tenant_id, customer_id, question) by the rules for intents."""
    return with_account_results(questions, transactions, as_of).select("query_id", "intent", "account_result")


def answer(questions: DataFrame, transactions: DataFrame, hits: DataFrame, as_of: str, written: str | None = None) -> DataFrame:
    """questions (query_id, tenant_id, customer_id, question, ...) and their retrieved hits (query_id, text) to query_id, data_source,
    answer, sources, faithfulness, relevance, retry."""
    guard = routing.guard_question(F.col("question"))
    rows = questions.withColumns({"question": guard["clean"], "_reason": guard["reason"]}).where(F.col("_reason").isNull()).drop("_reason")
    rows = routing.analyze(rows)
    rows = with_account_results(rows, transactions, as_of, F.col("data_source").isin("sql", "hybrid"))
    usable = hits.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    rows = rows.join(usable, "query_id", "left").withColumn("n_chunks", F.when(F.col("data_source") == "sql", 0).otherwise(F.coalesce("n_chunks", F.lit(0))))
    rows = routing.evaluate(routing.synthesize(rows, written))
    retry = routing.step_after_evaluate(F.col("faithfulness"), F.col("relevance"), F.lit(0)) == "retry"
    return rows.select("query_id", "data_source", "answer", "sources", "faithfulness", "relevance", retry.alias("retry"))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
