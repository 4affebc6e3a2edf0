"""Connected components by contraction, on written tables: nothing about the graph comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import has_rows, materialize


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) for every node that has an edge; None without edges.  ``edges`` has columns a and b of one type.

    Each round sends a node to its smallest neighbour's smallest neighbour, itself included, and contracts; a round at least
    halves what is left of each component, stars vanish at once."""
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    edges = materialize(edges, "edges")
    labels: DataFrame | None = None
    while has_rows(edges):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up"))
        least = materialize(least, "parents")
        up = least.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = materialize(least.join(up, "up").select("node", "root"), "roots")
        labels = step if labels is None else extend(labels, step)
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        edges = edges.join(a, "a").join(b, "b").where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = materialize(edges, "edges")
    return labels


def extend(labels: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
    """Labels whose roots are sent on by ``more``; nodes that only ``more`` has are added."""
    if labels is None or more is None:
        return labels if more is None else more
    on = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = labels.join(on, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new), "labels")
