"""Dense search, rank fusion, diversification, parent expansion, context assembly and the answer cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import pairs
from corpusloom.operators.sparse import top_k

# Defaults of retrieval.
TOP_K, RERANK_TOP_N, MMR_K, MMR_LAMBDA = 20, 8, 6, 0.6
CACHE_SIMILARITY, CACHE_TTL = 0.92, 3600
#: Constant of reciprocal rank fusion; ranks count from 0.
RRF_K = 2
DIGITS = pairs.DIGITS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors and vectors of length 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1, empty stays empty, zero stays zero; as doubles."""
    d = F.transform(a, lambda x: x.cast("double"))
    # The length is the element of an array, since an expression would be evaluated anew for each element of the vector.
    scaled = F.transform(F.array(norm(d)), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d))
    return F.get(scaled, F.lit(0))


def dense_search(queries: DataFrame, points: DataFrame, k: int = TOP_K, query: str = "query_id", item: str = "doc_id", on: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Exact nearest neighbours by cosine among points with equal ``on`` columns (the tenant, or the tenant and file).

    Vectors are brought to length 1 once on either side.  Blocks of queries meet blocks of points (``operators.pairs``), and each block
    returns its nearest only, so there is no row a pair."""
    vector = lambda rows, key: rows.select(key, *on, unit(F.col("embedding")).alias("_v"))
    q = vector(queries.where(F.coalesce(F.col(on[0]).cast("string"), F.lit("")) != ""), query)
    scored = pairs.best(q, vector(points, item), query, item, on, k, pairs.by_dot)
    return top_k(scored.withColumn("score", F.round("score", DIGITS)), query, item, k)


def similar_chunks(queries: DataFrame, points: DataFrame, texts: DataFrame, parents: DataFrame, files: DataFrame | None = None, k: int = 5, query: str = "query_id", item: str = "point_id", tenant: str = "tenant_id", within: str | None = None) -> DataFrame:
    """The nearest chunks of each query with their texts and their parents': query, item, rank, score, text, parent_text.

    ``queries``: query, tenant, embedding; ``points``: item, tenant, file_name, parent_id, embedding, without texts; ``texts``: item, text;
    ``parents``: parent_id, text; ``files``: (query, file_name) pairs, of queries that want these files only.  Such a query meets the points
    of its files before anything is ranked; texts join after ranking, to at most ``k`` rows a query.  A chunk without a stored parent has a
    null parent_text.

    ``within``: where the files that queries want are whole sets, the set's column in ``queries`` and ``points``, in place of a row a query
    and file; a query with null there wants all files."""
    bare = points.select(item, tenant, *([within] if within else []), "file_name", "embedding")
    if within:
        free = dense_search(queries.where(F.col(within).isNull()), bare, k, query, item, (tenant,))
        own = dense_search(queries.where(F.col(within).isNotNull()), bare, k, query, item, (tenant, within))
        hits = free.select(query, item, "score", "rank").unionByName(own.select(query, item, "score", "rank"))
    elif files is None:
        hits = dense_search(queries, bare, k, query, item, (tenant,))
    else:
        wanted = files.select(query, "file_name").distinct()
        free = dense_search(queries.join(wanted.select(query).distinct(), query, "left_anti"), bare, k, query, item, (tenant,))
        q = queries.where(F.coalesce(F.col(tenant), F.lit("")) != "").select(query, tenant, unit(F.col("embedding")).alias("_q")).join(wanted, query)
        p = bare.select(item, tenant, "file_name", unit(F.col("embedding")).alias("_p"))
        scored = q.join(p, [tenant, "file_name"]).select(query, item, F.round(dot(F.col("_q"), F.col("_p")), DIGITS).alias("score"))
        hits = free.select(query, item, "score", "rank").unionByName(top_k(scored, query, item, k).select(query, item, "score", "rank"))
    own = hits.join(points.select(item, "parent_id"), item).join(texts.select(item, "text"), item)
    return own.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left").select(query, item, "rank", "score", "text", "parent_text")


def fuse(lists: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of rows (query, list_id, item, rank from 1)."""
    share = 1.0 / (F.lit(rrf_k) + F.col("rank") - 1)
    fused = lists.groupBy(query, item).agg(F.round(F.sum(share), 9).alias("score"))
    return top_k(fused, query, item, k)


def mmr(candidates: DataFrame, k: int = MMR_K, weight: float = MMR_LAMBDA, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Maximal marginal relevance over each query's candidates (query, item, score, rank, embedding): query, item, score, pos from 0.

    At most RERANK_TOP_N candidates of a query come in, so the fold works on one small array a query."""
    packed = F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("id"), "score", unit(F.coalesce("embedding", F.array().cast("array<float>"))).alias("v"))))
    rows = candidates.groupBy(query).agg(packed.alias("c"))
    same = lambda x, y: F.when((F.size(x.v) > 0) & (F.size(y.v) > 0), F.round(dot(x.v, y.v), 9)).otherwise(0.0)
    rows = rows.withColumn("sim", F.transform("c", lambda x: F.transform("c", lambda y: same(x, y))))
    n, c, sim = F.size("c"), F.col("c"), F.col("sim")

    def pick(chosen: Column, _: Column) -> Column:
        value = lambda i: F.round(weight * F.get(c, i).score - (1 - weight) * F.array_max(F.transform(chosen, lambda j: F.get(F.get(sim, i), j))), 9)
        left = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(chosen, i))
        best = F.array_max(F.transform(left, lambda i: F.struct(value(i).alias("v"), (-i).alias("i"))))
        return F.concat(chosen, F.array(-best.i))

    chosen = F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(F.aggregate(F.sequence(F.lit(2), F.lit(k)), F.array(F.lit(0)), pick))
    out = rows.select(query, "c", F.posexplode(chosen).alias("pos", "i"))
    return out.select(query, F.get(c, F.col("i")).id.alias(item), F.get(c, F.col("i")).score.alias("score"), "pos")


def rerank(fused: DataFrame, n: int = RERANK_TOP_N, rerank_score: str | None = None, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The first ``n`` candidates; by the column ``rerank_score`` of an external model if there is one."""
    if rerank_score is None:
        return fused.where(F.col("rank") <= n)
    return top_k(fused.drop("score", "rank").withColumnRenamed(rerank_score, "score"), query, item, n)


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """text becomes the parent's where there is one; score rounds to 4 digits; source and page get defaults.

    ``hits``: text, parent_id, score, source, page ...; ``parents``: parent_id, text."""
    p = parents.select("parent_id", F.col("text").alias("_parent"))
    joined = hits.join(p, "parent_id", "left").withColumns({"text": F.coalesce("_parent", "text"), "score": F.round("score", 4)})
    return joined.withColumns({"source": F.coalesce("source", F.lit("unknown")), "page": F.coalesce("page", F.lit(0))}).drop("_parent")


def reorder(pos: Column, n: Column) -> Column:
    """Place from 0 of the item at ``pos`` (from 0): the best first, the second best last, the others between."""
    return F.when(n <= 2, pos).when(pos == 0, 0).when(pos == 1, n - 1).otherwise(pos - 1)


def prompt(chunks: DataFrame, query: str = "query_id", most_chars: int = 3000, label: str = "Chunk") -> DataFrame:
    """``query`` and context: the numbered chunks (query, pos, text, source, page) in the order of attention."""
    n = F.count("*").over(Window.partitionBy(query))
    rows = chunks.withColumn("_n", n).withColumn("_at", reorder(F.col("pos"), F.col("_n")))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    text = F.when(F.length(text) > most_chars, F.concat(F.left(text, F.lit(most_chars)), F.lit("... [truncated]"))).otherwise(text)
    block = F.concat(F.lit(f"[{label} #"), (F.col("_at") + 1).cast("string"), F.lit("] Source: "), "source", F.lit(", page "), F.col("page").cast("string"), F.lit("\n"), text)
    parts = F.array_sort(F.collect_list(F.struct("_at", block.alias("b"))))
    return rows.groupBy(query).agg(F.array_join(F.transform(parts, lambda p: p.b), "\n\n").alias("context"))


def user_message(context: Column, question: Column, account: Column | None = None) -> Column:
    """The message for an answering model; with ``account`` the one that puts account data first."""
    tail = "[Source: filename, page N, Chunk #K]):"
    if account is None:
        return F.concat(F.lit("CONTEXT CHUNKS:\n"), context, F.lit("\n\nQUESTION: "), question, F.lit(f"\n\nANSWER (cite every claim inline using {tail}"))
    return F.concat(
        F.lit("LIVE TRANSACTION DATA (from account database):\n"), account, F.lit("\n\nPOLICY / DOCUMENT CONTEXT:\n"), context,
        F.lit("\n\nQUESTION: "), question, F.lit(f"\n\nANSWER (cite document chunks inline using {tail}"),
    )


def cache_candidates(queries: DataFrame, cache: DataFrame, similarity: float = CACHE_SIMILARITY, ttl: int = CACHE_TTL, axis: int = 0) -> DataFrame:
    """The pairs that ``cache_hits`` scores: query_id, asked_at, _q, cache_id, created_at, _c.

    A stored row lives ``ttl``, so it can serve its own interval of that length and the next.  Vectors of length 1 with this similarity
    are at most ``reach`` apart, on every axis; so along one of them they lie in the same cell of that width or in neighbouring ones.
    Both are parts of the join's key: pairs grow with the rows of a tenant and interval, not with its history."""
    known = (F.coalesce(F.col("tenant_id"), F.lit("")) != "") & (F.size("_v") > 0)
    life = lambda c: F.floor(F.col(c) / F.lit(ttl)).cast("long")
    reach = (2.0 - 2.0 * (similarity - 1e-6)) ** 0.5
    # A vector of length 0 has similarity 0 to all.
    cell = F.floor(F.get("_v", F.lit(axis)) / F.lit(reach)).cast("int") if similarity > 1e-6 else F.lit(0)
    near = F.sequence(cell - 1, cell + 1) if similarity > 1e-6 else F.array(cell)
    q = queries.select("query_id", "tenant_id", "asked_at", unit(F.col("embedding")).alias("_v")).where(known)
    q = q.withColumn("_life", F.explode(F.sequence(life("asked_at") - 1, life("asked_at")))).withColumn("_cell", F.explode(near)).withColumnRenamed("_v", "_q")
    c = cache.select("cache_id", "tenant_id", "created_at", unit(F.col("embedding")).alias("_v")).where(known)
    c = c.withColumns({"_life": life("created_at"), "_cell": cell}).withColumnRenamed("_v", "_c")
    met = q.join(c, ["tenant_id", "_life", "_cell"])
    return met.where((F.col("created_at") <= F.col("asked_at")) & (F.col("created_at") >= F.col("asked_at") - ttl)).drop("_life", "_cell")


def cache_hits(queries: DataFrame, cache: DataFrame, similarity: float = CACHE_SIMILARITY, ttl: int = CACHE_TTL, axis: int = 0) -> DataFrame:
    """The most similar live answer of the same tenant: query_id, cache_id, score.  Rows without a tenant or a vector find nothing.

    ``queries``: query_id, tenant_id, data_source, asked_at, embedding; ``cache``: cache_id, tenant_id, created_at, embedding."""
    met = cache_candidates(queries.where(~F.col("data_source").isin("sql", "hybrid")), cache, similarity, ttl, axis)
    scored = met.select("query_id", "cache_id", F.round(dot(F.col("_q"), F.col("_c")), DIGITS).alias("score")).where(F.col("score") >= similarity)
    return top_k(scored, "query_id", "cache_id", 1).drop("rank")


def cache_admits(data_source: Column, faithfulness: Column, relevance: Column, error: Column) -> Column:
    """Whether an answer may be cached."""
    return ~data_source.isin("sql", "hybrid") & (faithfulness >= 0.8) & (relevance >= 0.75) & error.isNull()


def retrieval_frequency(hits: DataFrame, share: float = 0.9, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Items and the share of queries that retrieved them; ``suspicious`` from ``share`` on."""
    total = hits.groupBy(F.lit(1).alias("_one")).agg(F.countDistinct(query).alias("_q"))
    counts = hits.groupBy(item).agg(F.countDistinct(query).alias("n_queries"))
    rate = F.round(F.col("n_queries") / F.col("_q"), 6)
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(item, "n_queries", rate.alias("rate"), (rate >= share).alias("suspicious"))  # one row is broadcast


def hybrid_lists(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Dense and sparse result lists as one frame of (query_id, list_id, doc_id, rank)."""
    cols = ["query_id", "doc_id", "rank"]
    return dense.select(*cols, F.lit("dense").alias("list_id")).unionByName(sparse.select(*cols, F.lit("sparse").alias("list_id")))
