"""Deterministic routing, guards and checks of questions, analyses, answers and registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.accounts import any_of

# Phrases of the router.
HYBRID_PHRASES = [
    "why was i charged", "why am i charged", "charged a fee", "foreign transaction fee", "fee policy",
    "complies with policy", "compare my transaction", "why was this charge",
]
SQL_PHRASES = [
    "balance", "account total", "how much money", "last transaction", "recent transaction", "transactions",
    "transaction history", "flagged", "suspicious", "unusual", "blocked", "spending", "spent", "category", "merchant",
]
# Question types and answers.
QUESTION_TYPES = ["numerical", "conceptual", "comparative", "temporal", "regulatory", "multi_company", "general", "sql", "hybrid"]
CANNOT_ANSWER = "I cannot find this information in the available documents."
CANNOT_ANSWER_ACCOUNT = "I cannot find this information in your transaction records."
ACCOUNT_SOURCE = "Live transaction database"
# Patterns of injected instructions.
INJECTION = (
    r"(?i)ignore\s+(all\s+)?previous\s+instructions|you\s+are\s+now\s+(a\s+)?|disregard\s+(all\s+)?prior|"
    r"new\s+instructions?\s*:|system\s*prompt\s*:|<\s*system\s*>"
)
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MAX_QUESTION, MAX_SUB_QUESTIONS, MIN_HYPOTHESIS = 2000, 4, 20
PASS_FAITHFULNESS, PASS_RELEVANCE, MAX_RETRIES, MIN_CHUNKS, DEFAULT_SCORE = 0.85, 0.80, 1, 3, 0.7


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def guard_question(question: Column) -> dict[str, Column]:
    """clean (text without control characters) and reason (null if accepted)."""
    text = strip(F.coalesce(question, F.lit("")))
    clean = F.regexp_replace(text, CONTROL_CHARACTERS, "")
    reason = F.when(text == "", "empty").when(F.length(text) > MAX_QUESTION, "too long").when(clean.rlike(INJECTION), "invalid content")
    return {"clean": clean, "reason": reason}


def route(question: Column) -> Column:
    """hybrid, sql or general."""
    q = F.lower(question)
    return F.when(any_of(q, HYBRID_PHRASES), "hybrid").when(any_of(q, SQL_PHRASES), "sql").otherwise("general")


def data_source(query_type: Column) -> Column:
    return F.when(query_type.isin("sql", "hybrid"), query_type).otherwise("rag")


def next_step(source: Column) -> Column:
    """The first stage of a question."""
    return F.when(source.isin("sql", "hybrid"), "lookup").otherwise("retrieve")


def step_after_lookup(source: Column) -> Column:
    return F.when(source == "hybrid", "retrieve").otherwise("synthesize")


def strip_fence(reply: Column) -> Column:
    """A model's JSON reply without its code fence."""
    text = strip(reply)
    inner = F.get(F.split(text, "```"), F.lit(1))
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return strip(F.when(F.startswith(text, F.lit("```")), inner).otherwise(text))


ANALYSIS = "query_type string, needs_decomposition boolean, sub_questions array<string>, hyde_applicable boolean, hyde_query string"


def guard_analysis(rows: DataFrame) -> DataFrame:
    """Clean values for the columns of ``ANALYSIS``, with the question in ``question``."""
    kind = F.when(F.col("query_type").isin(QUESTION_TYPES), F.col("query_type")).otherwise("general")
    subs = F.slice(F.filter(F.coalesce("sub_questions", F.array().cast("array<string>")), lambda s: s.isNotNull() & (strip(s) != "")), 1, MAX_SUB_QUESTIONS)
    needs = F.coalesce("needs_decomposition", F.lit(False))
    alone = needs & (F.size(subs) == 0)
    several = kind.isin("comparative", "multi_company")
    none = F.array().cast("array<string>")
    text = F.when(F.coalesce("hyde_applicable", F.lit(False)) & kind.isin("conceptual", "temporal"), strip(F.coalesce("hyde_query", F.lit("")))).otherwise("")
    text = F.when(F.length(text) >= MIN_HYPOTHESIS, text).otherwise("")
    return rows.withColumns(
        {
            "query_type": kind,
            "needs_decomposition": F.when(several & ~alone, needs).otherwise(False),
            "sub_questions": F.when(~several, none).when(alone, F.array("question")).otherwise(subs),
            "hyde_applicable": text != "",
            "hyde_query": text,
        }
    )


def analyze(questions: DataFrame, reply: str | None = None) -> DataFrame:
    """Adds the ``ANALYSIS`` columns and data_source; from a model's JSON in column ``reply`` where it can be read, else by rules."""
    raw = F.from_json(strip_fence(F.col(reply)), ANALYSIS) if reply else F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in ANALYSIS.split(', '))}>")
    rows = questions.withColumn("_raw", raw).withColumn("query_type", F.coalesce("_raw.query_type", route(F.col("question"))))
    rest = {c: F.col(f"_raw.{c}") for c in ("needs_decomposition", "sub_questions", "hyde_applicable", "hyde_query")}
    return guard_analysis(rows.withColumns(rest)).withColumn("data_source", data_source(F.col("query_type"))).drop("_raw")


def extract_sources(answer: Column) -> Column:
    """Distinct citations of an answer, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[Source:\s*([^\]]+)\]"), F.lit(1)), lambda s: strip(s)))


def cited_files(sources: Column) -> Column:
    """Distinct file names of citations."""
    return F.array_distinct(F.filter(F.transform(sources, lambda s: strip(F.split_part(s, F.lit(","), F.lit(1)))), lambda s: s != ""))


def answer_flags(answer: Column) -> dict[str, Column]:
    """Warnings about an answer: uncited, too_short."""
    told = F.lower(strip(answer)) != CANNOT_ANSWER.lower()
    return {"uncited": told & (F.size(extract_sources(answer)) == 0), "too_short": told & (F.length(strip(answer)) < 50)}


def safe_score(c: Column) -> Column:
    """A score from untrusted text: within 0 and 1, the default if it is no number."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), DEFAULT_SCORE).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def quick_scores(answer: Column, n_chunks: Column) -> Column:
    """struct<faithfulness, relevance> where no judge is needed, else null.  Both sentences for no answer count."""
    text = F.lower(strip(F.coalesce(answer, F.lit(""))))
    pair = lambda f, r: F.struct(F.lit(f).alias("faithfulness"), F.lit(r).alias("relevance"))
    idk = text.isin(CANNOT_ANSWER.lower(), CANNOT_ANSWER_ACCOUNT.lower())
    return F.when(text == "", pair(0.0, 0.0)).when(idk, pair(1.0, 0.0)).when(n_chunks == 0, pair(0.0, 0.0))


def evaluate(rows: DataFrame, judge: str | None = None) -> DataFrame:
    """Adds faithfulness and relevance: quick scores, else the judge's struct column of texts, else the default; account answers pass."""
    scores = quick_scores(F.col("answer"), F.col("n_chunks"))
    f = safe_score(F.col(f"{judge}.faithfulness")) if judge else F.lit(DEFAULT_SCORE)
    r = safe_score(F.col(f"{judge}.relevance")) if judge else F.lit(DEFAULT_SCORE)
    account = (F.col("data_source") == "sql") & ~F.lower(strip("answer")).isin(CANNOT_ANSWER.lower(), CANNOT_ANSWER_ACCOUNT.lower())
    return rows.withColumns({"faithfulness": F.when(account, 1.0).otherwise(F.coalesce(scores.faithfulness, f)), "relevance": F.when(account, 1.0).otherwise(F.coalesce(scores.relevance, r))})


def step_after_evaluate(faithfulness: Column, relevance: Column, retries: Column) -> Column:
    good = (faithfulness >= PASS_FAITHFULNESS) & (relevance >= PASS_RELEVANCE)
    return F.when(good | (retries >= MAX_RETRIES), "end").otherwise("retry")


def synthesize(rows: DataFrame, written: str | None = None) -> DataFrame:
    """Adds answer and sources from data_source, account_result and n_chunks (usable ones); ``written``: a model's answer column."""
    account, nothing = F.coalesce("account_result", F.lit("")), F.col("n_chunks") == 0
    text = F.coalesce(F.col(written), F.lit("")) if written else F.lit("")
    cited = extract_sources(text)
    live, none = F.array(F.lit(ACCOUNT_SOURCE)), F.array().cast("array<string>")
    source = F.col("data_source")
    from_account = ((source == "sql") & (account != "")) | ((source == "hybrid") & nothing & (account != ""))
    answer = F.when(from_account, account).when(source == "sql", CANNOT_ANSWER_ACCOUNT).when(nothing, CANNOT_ANSWER).otherwise(text)
    sources = F.when(from_account, live).when((source == "sql") | nothing, none).when(source == "hybrid", F.array_distinct(F.concat(live, cited))).otherwise(cited)
    return rows.withColumns({"answer": answer, "sources": sources})


def valid_registration(rows: DataFrame) -> DataFrame:
    """Adds valid boolean: username, password, tenant, e-mail and customer id have the forms that accounts need."""
    email = F.lower(strip("email"))
    ok = (
        F.col("username").rlike(r"^[A-Za-z0-9_-]{3,50}$")
        & F.length("password").between(8, 128)
        & F.col("tenant_id").rlike(r"^[a-z0-9_-]{1,50}$")
        & F.contains(email, F.lit("@"))
        & (F.length(email) <= 254)
        & F.length("customer_id").between(1, 100)
    )
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def tenant_of_email(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds tenant_id by the domain of ``email``; null where it is not registered.  The registry joins as a plain table: Spark
    broadcasts it only while it is small."""
    domain = F.lower(F.trim(F.element_at(F.split("email", "@"), -1)))
    return rows.withColumn("email_domain", domain).join(registry.select("email_domain", "tenant_id"), "email_domain", "left")


def not_revoked(tokens: DataFrame, revoked: DataFrame) -> DataFrame:
    return tokens.join(revoked, "jti", "left_anti")
