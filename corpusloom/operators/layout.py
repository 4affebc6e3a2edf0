"""Page layout: which text lies in a table's box, and in which order columns are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of the page width.
GAP_SHARE, GAP_MEDIANS, FEW_GAPS_SHARE, FULL_SHARE = 0.03, 2.5, 0.08, 0.6


def overlaps(a: str, b: str) -> Column:
    """Whether the boxes of two aliases (x0, y0, x1, y1) overlap; touching edges do not."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x1") > c(b, "x0")) & (c(a, "x0") < c(b, "x1")) & (c(a, "y1") > c(b, "y0")) & (c(a, "y0") < c(b, "y1"))


def outside_tables(text: DataFrame, tables: DataFrame, page: str = "page_id") -> DataFrame:
    """Text blocks that overlap no table of their page."""
    return text.alias("t").join(tables.alias("b"), (F.col(f"t.{page}") == F.col(f"b.{page}")) & overlaps("t", "b"), "left_anti")


def reading_order(elements: DataFrame, width: Column, page: str = "page_id") -> DataFrame:
    """Adds place int from 0 to (page, seq, etype, y, x0, x1): columns are found by gaps between the centres of text blocks,
    elements across the page divide it into bands, and bands are read column by column.  A page's elements are one small array."""
    centre = lambda e: (e.x0 + e.x1) / 2
    packed = F.array_sort(F.collect_list(F.struct("y", "seq", "etype", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))))
    rows = elements.groupBy(page).agg(packed.alias("e"), F.first(width.cast("double")).alias("w"))
    rows = rows.withColumn("c", F.array_sort(F.transform(F.filter("e", lambda e: e.etype == "text"), centre)))
    n = F.size("c")
    between = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct((F.get("c", i) - F.get("c", i - 1)).alias("gap"), ((F.get("c", i) + F.get("c", i - 1)) / 2).alias("mid"))))
    rows = rows.withColumn("g", F.coalesce(between, F.array().cast("array<struct<gap:double,mid:double>>")))
    median = F.get(F.array_sort(F.transform("g", lambda g: g.gap)), F.floor(F.size("g") / 2).cast("int"))
    least = F.when(F.size("g") >= 2, F.greatest(F.col("w") * GAP_SHARE, median * GAP_MEDIANS)).otherwise(F.col("w") * FEW_GAPS_SHARE)
    rows = rows.withColumn("least", least).withColumn("b", F.transform(F.filter("g", lambda g: g.gap > F.col("least")), lambda g: g.mid))
    columns = F.size("b") + 1
    rows = rows.withColumn("plain", (columns == 1) | (n < columns * 2))
    full = lambda e: e.x1 - e.x0 >= F.col("w") * FULL_SHARE
    # A centre outside the page, left of 0 or right of its edge, belongs to the last column.
    column = lambda e: F.when((centre(e) < 0) | (centre(e) >= F.col("w")), columns - 1).otherwise(F.size(F.filter("b", lambda m: m <= centre(e))))
    rows = rows.withColumn("f", F.filter("e", full))

    def key(e: Column) -> Column:
        before = F.when(full(e), F.size(F.filter("f", lambda f: (f.y < e.y) | ((f.y == e.y) & (f.seq < e.seq))))).otherwise(F.size(F.filter("f", lambda f: f.y <= e.y)))
        plain = F.col("plain")
        part = lambda x: F.when(plain, 0).otherwise(x)
        return F.struct(part(before).alias("band"), part(full(e).cast("int")).alias("full"), part(F.when(full(e), 0).otherwise(column(e))).alias("col"), e.y.alias("y"), e.seq.alias("seq"))

    ordered = F.array_sort(F.transform("e", key))
    return rows.select(page, F.posexplode(ordered).alias("place", "k")).select(page, F.col("k.seq").alias("seq"), "place")
