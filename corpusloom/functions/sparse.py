"""Sparse vector expressions: tokens, hashed term indices, term weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make no term.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "was", "are", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "this", "that",
    "these", "those", "it", "its", "he", "she", "they", "we", "you", "i",
    "me", "him", "her", "us", "them", "my", "your", "his", "our", "their",
    "what", "which", "who", "how", "when", "where", "why", "all", "any",
    "each", "both", "few", "more", "most", "other", "such", "than", "too",
    "very", "not", "no", "as", "if", "so", "up", "out", "about", "also",
    "into", "through", "during", "before", "after", "above", "below",
    "between", "same", "then", "once", "there", "here",
]
TERM_SLOTS = 65_536


def terms(c: Column) -> Column:
    """Terms of a text in order: lower case, punctuation to blanks, no single characters, no stop words."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def term_index(term: Column) -> Column:
    """Slot of a term: h = 33 h + byte over its UTF-8 bytes from 5381, in 32 bits, modulo the slots."""
    places = F.sequence(F.lit(1), F.octet_length(term))

    def fold(byte):
        h = F.aggregate(places, F.lit(5381).cast("long"), lambda a, i: (a * 33 + byte(i)).bitwiseAND(F.lit(4294967295)))
        return (h % TERM_SLOTS).cast("int")

    # A plain term's characters are its bytes; others go by way of their digits.
    digits = F.hex(F.encode(term, "utf-8"))
    plain = fold(lambda i: F.ascii(F.substring(term, i, F.lit(1))).cast("long"))
    other = fold(lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.octet_length(term) == F.length(term), plain).otherwise(other)


def term_weight(tf: Column) -> Column:
    return 1.0 + F.log(tf.cast("double"))
