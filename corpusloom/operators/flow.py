"""A batch of questions through cache, retrieval, one retry, cache and chunk log.

``run_batch`` is a batch: questions that a stored answer serves leave the flow at once; the others are analysed, looked up or searched,
answered and judged.  The one retry is a second search, of the rows that failed only.  What may be stored goes to the cache, what was
found goes to the log of chunks, marked where the answer cites it.

Both are ``Ledger`` tables.  A batch reads the cache of the batches before it and appends under its own number, so a batch that runs again
gives the same answers and adds nothing.  Each stage that two others read is written, so no plan holds a search twice, and none holds the
making of the questions: what a batch asks is a stored table, and so are its rows and what its searches hit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, routing
from corpusloom.operators.store import mark_cited
from corpusloom.storage import Ledger

# What an empty question gets.
EMPTY_ANSWER, EMPTY_ERROR = "Please provide a question.", "empty question"

ANSWER = "query_id bigint, tenant_id string, answer string, sources array<string>, query_type string, data_source string, faithfulness double, relevance double, retry_count int, cached boolean, cache_id bigint, error string"
CACHE = "cache_id bigint, tenant_id string, created_at bigint, embedding array<float>, answer string, sources array<string>, query_type string, data_source string, faithfulness double, relevance double"
CHUNK = "query_id bigint, tenant_id string, attempt int, rank int, chunk_text string, source string, score double, cited boolean"

#: (questions to search for) -> rows query_id, rank, text, source, score; what ``show`` needs in place of text and source, where there is one.
Search = Callable[[DataFrame], DataFrame]


class Flow:
    """The stored tables of a flow, and what is called in it.

    ``searches``: the first search and that of the retry; ``write``: the answer of a row with its ``chunks`` (array of structs rank, text,
    source, score); ``judge``: a struct of faithfulness and relevance for such a row, as an outside model's texts or numbers; ``show``: gives
    stored hits their text and source, so that searches need not carry texts."""

    def __init__(self, spark: SparkSession, path: str, searches: Sequence[Search], write: Column, judge: Column, similarity: float = retrieval.CACHE_SIMILARITY, ttl: int = retrieval.CACHE_TTL, show: Search | None = None):
        self.searches, self.write, self.judge, self.similarity, self.ttl, self.show = searches, write, judge, similarity, ttl, show
        self.answers, self.cache, self.chunks = (Ledger(spark, f"{path}/{n}", s) for n, s in (("answers", ANSWER), ("cache", CACHE), ("chunks", CHUNK)))
        self._steps = {n: f"{path}/steps/{n}" for n in ("asked", "hits", "rows", "first", "second", "hits-0", "hits-1", "found-0", "found-1")}
        self.spark = spark

    def _written(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self._steps[name]}-{batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def run_batch(self, questions: DataFrame, batch: int, account: DataFrame | None = None) -> DataFrame:
        """Rows of ``ANSWER``, one a question (query_id, tenant_id, question, asked_at, embedding); ``account``: query_id, account_result."""
        q = self._written(questions.withColumn("question", routing.strip(F.coalesce("question", F.lit("")))), "asked", batch)
        empty, asked = q.where("question = ''"), q.where("question <> ''")
        stored = self.cache.read(before=batch)
        hits = retrieval.cache_hits(asked.withColumn("data_source", F.lit("rag")), stored.select("cache_id", "tenant_id", "created_at", "embedding"), self.similarity, self.ttl)
        hits = self._written(hits.select("query_id", "cache_id"), "hits", batch)
        misses = asked.join(hits, "query_id", "left_anti")
        rows = routing.analyze(misses.drop("embedding", "asked_at"))
        if account is None:
            rows = rows.withColumn("account_result", F.lit(None).cast("string"))
        else:
            rows = rows.join(account.select("query_id", "account_result"), "query_id", "left")
        rows = self._written(rows, "rows", batch)
        found = self._search(rows.where(F.col("data_source") != "sql").select("query_id"), asked, 0, batch)
        first = self._written(self._answered(rows, found, 0), "first", batch)
        failed = first.where("step = 'retry'").select("query_id")
        again = self._search(failed, asked, 1, batch)
        second = self._written(self._answered(rows.join(failed, "query_id", "left_semi"), again, 1), "second", batch)
        done = first.where("step = 'end'").unionByName(second)
        from_cache = hits.join(stored.drop("tenant_id", "created_at", "embedding"), "cache_id").join(asked.select("query_id", "tenant_id"), "query_id")
        none = lambda kind: F.lit(None).cast(kind)
        answers = (
            done.select(*(c for c in done.columns if c != "step")).withColumns({"cached": F.lit(False), "cache_id": none("bigint"), "error": none("string")})
            .unionByName(from_cache.withColumns({"retry_count": F.lit(0), "cached": F.lit(True), "error": none("string")}))
            .unionByName(empty.select(
                "query_id", "tenant_id", F.lit(EMPTY_ANSWER).alias("answer"), F.array().cast("array<string>").alias("sources"), F.lit("general").alias("query_type"), F.lit("rag").alias("data_source"),
                F.lit(0.0).alias("faithfulness"), F.lit(0.0).alias("relevance"), F.lit(0).alias("retry_count"), F.lit(False).alias("cached"), none("bigint").alias("cache_id"), F.lit(EMPTY_ERROR).alias("error"),
            ))
        )
        answers = self.answers.append(answers, batch)
        admitted = answers.where(~F.col("cached") & retrieval.cache_admits(F.col("data_source"), F.col("faithfulness"), F.col("relevance"), F.col("error")))
        kept = admitted.join(asked.select("query_id", F.col("asked_at").alias("created_at"), F.col("embedding").cast("array<float>").alias("embedding")), "query_id")
        self.cache.append(kept.withColumn("cache_id", F.col("query_id")), batch)
        self.chunks.append(log_chunks(found.unionByName(again), answers), batch)
        return answers

    def _search(self, ids: DataFrame, asked: DataFrame, attempt: int, batch: int) -> DataFrame:
        """What this attempt's search finds for the questions of these ids: query_id, tenant_id, attempt, rank, text, source, score."""
        those = asked.join(ids, "query_id", "left_semi")
        found = self.searches[attempt](those)
        if self.show:
            found = self.show(self._written(found, f"hits-{attempt}", batch))
        own = found.join(those.select("query_id", "tenant_id"), "query_id")
        own = own.select("query_id", "tenant_id", F.lit(attempt).alias("attempt"), F.col("rank").cast("int").alias("rank"), "text", "source", F.col("score").cast("double").alias("score"))
        return self._written(own, f"found-{attempt}", batch)

    def _answered(self, rows: DataFrame, found: DataFrame, attempt: int) -> DataFrame:
        """``rows`` with answer, sources, faithfulness, relevance, retry_count and step (end or retry)."""
        usable = found.where(F.trim(F.coalesce("text", F.lit(""))) != "")
        packed = usable.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "source", "score"))).alias("chunks"))  # of one search's results
        met = rows.join(packed, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(packed.schema["chunks"].dataType)))
        met = met.withColumn("n_chunks", F.when(F.col("data_source") == "sql", 0).otherwise(F.size("chunks")))
        met = met.withColumns({"_written": self.write, "_judged": self.judge})
        met = routing.evaluate(routing.synthesize(met, "_written"), "_judged")
        step = routing.step_after_evaluate(F.col("faithfulness"), F.col("relevance"), F.lit(attempt))
        return met.select("query_id", "tenant_id", "answer", "sources", "query_type", "data_source", "faithfulness", "relevance", F.lit(attempt).alias("retry_count"), step.alias("step"))


def log_chunks(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of ``CHUNK``: all that was found, marked where the question's answer cites its file."""
    rows = found.select("query_id", "tenant_id", "attempt", "rank", F.col("text").alias("chunk_text"), "source", "score", F.lit(False).alias("cited"))
    files = answers.where(~F.col("cached")).select("query_id", "tenant_id", F.explode(routing.cited_files(F.col("sources"))).alias("source"))
    return mark_cited(rows, files)
