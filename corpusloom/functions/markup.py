"""Markup as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that plain pages use.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
SKIPPED = ["script", "style", "nav", "footer", "header"]
BLOCKS = "p|div|h1|h2|h3|h4|h5|h6|li|tr|br|section|article"


def html_text(html: Column) -> Column:
    """Text of a page by patterns alone, without a parser: for well-formed pages, all in the JVM."""
    text = html
    for tag in SKIPPED:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def markdown_line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_table(head: list[str], lines: Column) -> Column:
    """``lines``: array of markdown lines in order; "" for none."""
    top = [markdown_line([F.lit(h) for h in head]), markdown_line([F.lit("---")] * len(head))]
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(*top), lines), "\n")).otherwise("")


def media_type(extension: Column) -> Column:
    e = F.lower(extension)
    return F.when(e.isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), e))
