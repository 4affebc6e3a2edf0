"""Sparse vectors as postings rows, and top-k by their dot product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.sparse import term_index, term_weight, terms
from corpusloom.operators import pairs


def sparse_vectors(rows: DataFrame, key: str, *carry: str, text: str = "text") -> DataFrame:
    """(``key``, *carry, idx int, weight double): one row a term slot; terms that share a slot add up before weighting."""
    runs = _runs(rows, key, *carry, text=text).select(key, *carry, F.explode_outer("_runs").alias("_s")).where(F.col("_s").isNotNull())
    return runs.select(key, *carry, F.col("_s.idx").alias("idx"), term_weight(F.col("_s.tf")).alias("weight"))


def packed_vectors(rows: DataFrame, key: str, *carry: str, text: str = "text") -> DataFrame:
    """(``key``, *carry, slots array<int>, weights array<double>): ``sparse_vectors`` with one row an item, empty arrays where it has no
    terms.  No filter here: Spark would take it below and make the runs once more in it, quadratically."""
    runs = _runs(rows, key, *carry, text=text)
    return runs.select(key, *carry, F.col("_runs.idx").alias("slots"), F.transform("_runs", lambda s: term_weight(s.tf)).alias("weights"))


def _runs(rows: DataFrame, key: str, *carry: str, text: str) -> DataFrame:
    """(``key``, *carry, _runs array of structs idx, tf).

    Slots are sorted and counted within their item, so a task holds the terms of one item at a time, however many items it has.  The outer
    explode spares the filter that Spark would add for the inner one, which makes the slots twice."""
    texts = rows.groupBy(key, *carry).agg(F.collect_list(text).alias("_texts"))  # one text, unless a key comes again
    slots = texts.select(key, *carry, F.array_sort(F.flatten(F.transform("_texts", lambda t: F.transform(terms(t), term_index)))).alias("_slots"))
    n = F.size("_slots")
    last = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("_slots", i - 1) != F.get("_slots", i)))
    ends = slots.withColumn("_ends", F.when(n > 0, last).otherwise(F.array().cast("array<int>")))
    runs = F.transform("_ends", lambda e, j: F.struct(F.get("_slots", e - 1).alias("idx"), (e - F.coalesce(F.get("_ends", j - 1), F.lit(0))).alias("tf")))
    return ends.select(key, *carry, runs.alias("_runs"))


def top_k(scored: DataFrame, query: str, item: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best items of each query with rank int from 1; ties go to the smaller item."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_search(queries: DataFrame, points: DataFrame, k: int, query: str = "query_id", item: str = "doc_id", tenant: str = "tenant_id") -> DataFrame:
    """Dot products of postings within a tenant; both sides (id, tenant, idx, weight).  Rows with an empty tenant find nothing."""
    q = queries.where(F.coalesce(F.col(tenant), F.lit("")) != "").withColumnRenamed("weight", "q_weight")
    met = q.join(points, [tenant, "idx"])
    scored = met.groupBy(query, item).agg(F.round(F.sum(F.col("q_weight") * F.col("weight")), 6).alias("score"))
    return top_k(scored, query, item, k)


def sparse_search_packed(queries: DataFrame, points: DataFrame, k: int, query: str = "query_id", item: str = "doc_id", tenant: str = "tenant_id") -> DataFrame:
    """``sparse_search`` with one row an item on either side (id, tenant, slots, weights): the same rows, without a row a common slot.

    An item is of one tenant.  Items are counted first, so ``points`` had better be a stored table."""
    q = queries.where(F.coalesce(F.col(tenant), F.lit("")) != "").select(query, tenant, "slots", "weights")
    scored = pairs.best(q, points.select(item, tenant, "slots", "weights"), query, item, (tenant,), k, pairs.by_slots)
    return top_k(scored.withColumn("score", F.round("score", pairs.DIGITS)), query, item, k)


#: Items of a block of postings; a term's list is split by blocks, however common it is.
BLOCK_ITEMS = 4096
#: Blocks of each query that are scored before the rest is pruned.
FIRST_BLOCKS = 2


def block_postings(points: DataFrame, item: str = "doc_id", tenant: str = "tenant_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Postings with their block: adds size int and part int.  A block holds items of one tenant whose numbers of slots have the same
    power of two, about ``block_items`` of them, so its longest item says how many terms of a query its items can hold."""
    sized = points.groupBy(item, tenant).agg(F.count("*").alias("_n")).withColumn("size", F.floor(F.log2("_n")).cast("int"))
    parts = sized.groupBy(tenant, "size").agg(F.ceil(F.count("*") / F.lit(block_items)).alias("_parts"))  # some twenty rows a tenant
    dealt = sized.join(parts, [tenant, "size"]).select(item, tenant, "size", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int").alias("part"))
    return points.join(dealt, [item, tenant])


def block_maxima(postings: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """The greatest weight of each slot in each block: tenant, size, part, idx, top double."""
    return postings.groupBy(tenant, "size", "part", "idx").agg(F.max("weight").alias("top"))


def block_bounds(queries: DataFrame, maxima: DataFrame, query: str = "query_id", tenant: str = "tenant_id") -> DataFrame:
    """The most that any item of a block can score for a query: query, tenant, size, part, bound.

    An item of fewer than 2**(size + 1) slots meets at most so many slots of the query, so the greatest of them count."""
    met = queries.join(maxima, [tenant, "idx"]).withColumn("_share", F.col("q_weight") * F.col("top"))
    shares = met.groupBy(query, tenant, "size", "part").agg(F.sort_array(F.collect_list("_share"), False).alias("_s"))  # of one query's slots
    most = F.pow(F.lit(2.0), F.col("size") + 1)
    best = F.slice("_s", F.lit(1), F.greatest(F.lit(1), (most - 1).cast("int")))
    return shares.select(query, tenant, "size", "part", F.aggregate(best, F.lit(0.0), lambda a, x: a + x).alias("bound"))


def sparse_search_blocks(queries: DataFrame, postings: DataFrame, maxima: DataFrame, k: int, query: str = "query_id", item: str = "doc_id", tenant: str = "tenant_id", first: int = FIRST_BLOCKS) -> DataFrame:
    """``sparse_search`` over blocks: the same rows, without reading blocks that cannot hold one of the best ``k``.

    Each query's ``first`` most promising blocks are scored; their k-th score is a threshold that the bounds of the others are held
    against.  ``postings`` and ``maxima`` are stored tables, as ``block_postings`` and ``block_maxima`` make them."""
    q = queries.where(F.coalesce(F.col(tenant), F.lit("")) != "").withColumnRenamed("weight", "q_weight")
    bounds = block_bounds(q, maxima, query, tenant)
    turn = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "size", "part"))
    bounds = bounds.withColumn("_turn", turn)
    block = [tenant, "size", "part"]

    def score(chosen: DataFrame) -> DataFrame:
        asked = q.join(chosen.select(query, *block), [query, tenant])
        met = asked.join(postings, [*block, "idx"])
        return met.groupBy(query, item).agg(F.round(F.sum(F.col("q_weight") * F.col("weight")), 6).alias("score"))

    leaders = score(bounds.where(F.col("_turn") <= first))
    least = top_k(leaders, query, item, k).where(F.col("rank") == k).select(query, F.col("score").alias("_least"))
    # Scores are rounded, bounds are not; a tie can still win by its item's number.
    rest = bounds.where(F.col("_turn") > first).join(least, query, "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 1e-6))
    return top_k(leaders.unionByName(score(rest)), query, item, k)
