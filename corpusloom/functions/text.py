"""Text expressions: words, sentences, token windows, truncation, key words.  All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "vs", "Corp", "Inc", "Ltd", "Co", "Dept", "U.S", "e.g", "i.e", "etc"]

# Terms of the financial classifier, and its currency and percentage patterns.
FINANCIAL_TERMS = [
    "revenue", "net income", "ebitda", "gross margin", "earnings per share",
    "cash flow", "balance sheet", "liabilities", "equity", "fiscal year",
    "quarterly results", "annual report", "10-k", "10-q", "operating income",
    "diluted shares", "free cash flow", "guidance", "basis points",
    "net profit", "operating margin", "return on equity", "interest income",
    "loan portfolio", "credit loss", "provision", "tier 1 capital",
    "dividend", "market capitalization", "working capital", "debt ratio",
]
CURRENCY_PATTERN = r"[$€£¥]\s*[\d,.]+\s*[BMKbmk]?"
PERCENT_PATTERN = r"\d+\.?\d*\s*%"

#: What ``\s`` stands for.
SPACE = " \t\n\x0b\f\r"
#: Stands for a full stop that must not end a sentence.
SHIELD = "\u0001"
SENTENCE_TOKENS = 512


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """The tokens that budgets count: maximal runs without white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    """As many as ``words`` has, and -1 for null like its size."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(-1))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut after ``.!?`` before a capital, quote or bracket; abbreviations do not end one."""
    text = strip(c)
    for a in (a for a in ABBREVIATIONS if "." in a):
        first, last = a.split(".")
        text = F.regexp_replace(text, rf"(?i)(?<!\S)({first})\.({last})(?=\.)", f"$1{SHIELD}$2")
    stems = "|".join(a.replace(".", SHIELD) for a in ABBREVIATIONS)
    text = F.regexp_replace(text, rf"(?i)(?<!\S)({stems})\.", f"$1{SHIELD}")
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"'(])")
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(SHIELD), F.lit(".")))), lambda s: s != "")


def token_windows(c: Column, limit: int) -> Column:
    """Consecutive windows of ``limit`` words, without overlap."""
    w = words(c)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(limit))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(limit)), " "))


def sentence_pieces(c: Column, limit: int = SENTENCE_TOKENS) -> Column:
    """Sentences; one of more than ``limit`` words in windows of that size.  Only long ones are counted: more words need more characters."""
    long = lambda s: (F.length(s) > 2 * limit) & (count_words(s) > limit)
    return F.flatten(F.transform(sentences(c), lambda s: F.when(long(s), token_windows(s, limit)).otherwise(F.array(s))))


def truncate_words(c: Column, n: int) -> Column:
    """The first ``n`` words, the text itself if it has no more."""
    return F.when(count_words(c) <= n, c).otherwise(F.array_join(F.slice(words(c), 1, n), " "))


def truncate_chars(c: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def keyword_signals(c: Column, terms: list[str] | None = None) -> Column:
    """Number of financial signals: terms contained, and one each for at least three amounts and three percentages."""
    low = F.lower(c)
    hits = F.size(F.filter(F.array(*map(F.lit, terms or FINANCIAL_TERMS)), lambda t: F.contains(low, t)))
    many = lambda p: F.when(F.regexp_count(c, F.lit(p)) >= 3, 1).otherwise(0)
    return hits + many(CURRENCY_PATTERN) + many(PERCENT_PATTERN)


def is_financial(c: Column, terms: list[str] | None = None) -> Column:
    return keyword_signals(c, terms) >= 3
