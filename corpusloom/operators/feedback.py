"""Feedback: triggers, helpful rate, parameter tuning step by step, lookup; training-set exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tuning.
EVERY, WINDOW, TOP_K, TOP_K_MIN, TOP_K_MAX = 10, 50, 20, 10, 50
RERANK_MIN, RERANK_MAX, MMR_MIN, MMR_MAX = 4, 20, 3, 10
DEFAULTS = {"top_k": 20, "rerank_top_n": 8, "mmr_final_k": 6}
# What answers must reach to be exported, and how many examples make a set ready.
MIN_FAITHFULNESS, MIN_RELEVANCE, MIN_FEEDBACK = 0.85, 0.80, 10
READY = {"sft": 100, "dpo": 50, "reranker": 200}
#: Tuning steps that are folded together in one row before rows are folded.
RUN = 1000


def triggers(votes: DataFrame) -> DataFrame:
    """Every tenth vote of a tenant, with n (votes so far) and rate (helpful share of the last fifty)."""
    order = Window.partitionBy("tenant_id").orderBy("created_at", "fid")
    helpful = F.when(F.col("helpful"), 1).otherwise(0)
    last = order.rowsBetween(-(WINDOW - 1), 0)
    rows = votes.withColumns({"n": F.row_number().over(order), "_h": F.sum(helpful).over(last), "_t": F.count("*").over(last)})
    return rows.where(F.col("n") % EVERY == 0).select("tenant_id", "fid", "n", (F.col("_h") / F.col("_t")).alias("rate"))


def helpful_rate(votes: DataFrame) -> DataFrame:
    """Of each tenant's last fifty votes: helpful_count, total."""
    order = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("fid"))
    last = votes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= WINDOW)
    return last.groupBy("tenant_id").agg(F.count_if("helpful").alias("helpful_count"), F.count("*").alias("total"))


def step(rate: Column) -> tuple[Column, Column, Column]:
    """(add, least, most) of the step that a rate causes: k becomes min(max(k + add, least), most)."""
    low, high = rate < 0.5, rate > 0.8
    far = 1 << 20
    return F.when(low, 5).when(high, -2).otherwise(0), F.when(high, TOP_K_MIN).otherwise(-far), F.when(low, TOP_K_MAX).otherwise(far)


def apply_step(k: Column, s: tuple[Column, Column, Column]) -> Column:
    return F.least(F.greatest(k + s[0], s[1]), s[2])


def with_dependents(rows: DataFrame) -> DataFrame:
    """rerank_top_n and mmr_final_k from top_k; halves round to even."""
    part = lambda x, lo, hi: F.least(F.greatest(F.bround(F.col("top_k") * F.lit(x).cast("decimal(2,1)"), 0).cast("int"), F.lit(lo)), F.lit(hi))
    return rows.withColumns({"rerank_top_n": part(0.4, RERANK_MIN, RERANK_MAX), "mmr_final_k": part(0.3, MMR_MIN, MMR_MAX)})


def tune(rates: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """One tuning of each tenant from (tenant_id, helpful_count, total): tenant_id, top_k, rerank_top_n, mmr_final_k."""
    rows = rates.withColumn("top_k", F.lit(TOP_K)) if params is None else rates.join(params.select("tenant_id", "top_k"), "tenant_id", "left").withColumn("top_k", F.coalesce("top_k", F.lit(TOP_K)))
    rows = rows.withColumn("top_k", apply_step(F.col("top_k"), step(F.col("helpful_count") / F.col("total"))).cast("int"))
    return with_dependents(rows).select("tenant_id", "top_k", "rerank_top_n", "mmr_final_k")


def tune_all(votes: DataFrame) -> DataFrame:
    """The parameters after all of a tenant's triggers, one after the other from the default.

    A step only adds and limits, and so does any run of steps.  Runs of ``RUN`` steps are folded to one such step first, then the
    runs of a tenant, so no row has to hold a tenant's whole history."""
    s = step(F.col("rate"))
    rows = triggers(votes).select("tenant_id", F.col("n"), F.floor(F.col("n") / (EVERY * RUN)).alias("run"), F.struct(s[0].alias("add"), s[1].alias("lo"), s[2].alias("hi")).alias("s"))
    runs = rows.groupBy("tenant_id", "run").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("steps"))
    runs = runs.select("tenant_id", "run", _folded("steps").alias("s"))
    all_runs = runs.groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct(F.col("run").alias("n"), "s"))).alias("steps"))
    rows = all_runs.select("tenant_id", _folded("steps").alias("s"))
    k = apply_step(F.lit(TOP_K), (F.col("s.add"), F.col("s.lo"), F.col("s.hi"))).cast("int")
    return with_dependents(rows.withColumn("top_k", k)).select("tenant_id", "top_k", "rerank_top_n", "mmr_final_k")


def _folded(steps: str) -> Column:
    """One step that does what the ordered steps do: after (a, l, h) comes (b, m, i): (a + b, lim(l + b), lim(h + b))."""
    far = 1 << 20
    none = F.struct(F.lit(0).alias("add"), F.lit(-far).alias("lo"), F.lit(far).alias("hi"))
    limit = lambda x, s: F.least(F.greatest(x, s.lo), s.hi)

    def then(a: Column, e: Column) -> Column:
        s = e.s
        return F.struct((a.add + s.add).alias("add"), limit(a.lo + s.add, s).alias("lo"), limit(a.hi + s.add, s).alias("hi"))

    return F.aggregate(steps, none, then)


def lookup_params(tenants: DataFrame, params: DataFrame) -> DataFrame:
    """The tenants with their parameters, defaults where there are none."""
    joined = tenants.join(params.select("tenant_id", *DEFAULTS), "tenant_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in DEFAULTS.items()})


def _judged(votes: DataFrame, audit: DataFrame, tenant: str | None, min_feedback: int) -> DataFrame:
    """Votes with their logged query; with ``min_feedback`` only of tenants with so many votes."""
    v = votes.where(F.col("tenant_id") == tenant) if tenant else votes
    if min_feedback:
        v = v.join(v.groupBy("tenant_id").count().where(F.col("count") >= min_feedback).select("tenant_id"), "tenant_id", "left_semi")
    return v.select(F.col("query_id").alias("id"), "helpful").join(audit.drop("tenant_id"), "id").where("data_source = 'rag' AND answer IS NOT NULL")


def export_sft(votes: DataFrame, audit: DataFrame, tenant: str | None = None, min_feedback: int = 0) -> DataFrame:
    """id, created_at and messages (user, assistant) of helpful answers good enough to learn from."""
    rows = _judged(votes, audit, tenant, min_feedback).where(F.col("helpful") & (F.col("faithfulness") >= MIN_FAITHFULNESS) & (F.col("relevance") >= MIN_RELEVANCE) & (F.col("answer") != ""))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.select("id", "created_at", F.array(message("user", "question"), message("assistant", "answer")).alias("messages"))


def export_dpo(votes: DataFrame, audit: DataFrame, tenant: str | None = None, min_feedback: int = 0) -> DataFrame:
    """prompt, chosen and rejected of questions with helpful and unhelpful answers."""
    rows = _judged(votes, audit, tenant, min_feedback)
    pairs = rows.groupBy(F.col("question").alias("prompt")).agg(F.max(F.when(F.col("helpful"), F.col("answer"))).alias("chosen"), F.max(F.when(~F.col("helpful"), F.col("answer"))).alias("rejected"))
    return pairs.where("chosen <> '' AND rejected <> '' AND chosen <> rejected")


def export_reranker(votes: DataFrame, audit: DataFrame, chunks: DataFrame, tenant: str | None = None, min_feedback: int = 0) -> DataFrame:
    """query, pos and neg: cited and uncited chunks of helpful answers, sorted."""
    rows = _judged(votes, audit, tenant, min_feedback).where("helpful").select("id", "question")
    rows = rows.join(chunks.select(F.col("query_id").alias("id"), "chunk_text", "cited"), "id").where("chunk_text <> ''")
    found = rows.groupBy(F.col("question").alias("query")).agg(
        F.array_sort(F.collect_list(F.when(F.col("cited"), F.col("chunk_text")))).alias("pos"), F.array_sort(F.collect_list(F.when(~F.col("cited"), F.col("chunk_text")))).alias("neg")
    )
    return found.where((F.size("pos") > 0) & (F.size("neg") > 0))


def export_summary(sets: dict[str, DataFrame]) -> DataFrame:
    """One row a set: name, n, ready."""
    out = None
    for name, rows in sets.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") >= READY[name]).alias("ready"))
        out = row if out is None else out.unionByName(row)
    return out
