"""Questions asked again and again: the flow through cache, retrieval, retry and chunk log, in three batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as r
from corpusloom.operators import routing as g
from corpusloom.operators.flow import Flow
from corpusloom.operators.sparse import packed_vectors, sparse_search_packed
from corpusloom.plans import accounts as ap
from corpusloom.plans import text as tp
from corpusloom.plans import views as v
from corpusloom.plans.retrieval import _TOP, _sql_dense
from corpusloom.plans.views import with_views
from corpusloom.storage import new_folder

#: Seconds after its first asking at which a question comes in each batch: within a stored answer's life, and past it.
LATER = [0, 1800, 7200]
K, SIMILARITY, TTL, GOOD = 4, 0.3, 3600, 0.35


def _questions(points):
    """Every fiftieth point asks, its text behind a phrase that routing rules look for."""
    phrase = F.element_at(F.array(*map(F.lit, v.PHRASES)), (F.pmod(F.col("doc_id") / 50, F.lit(len(v.PHRASES))) + 1).cast("int"))
    asks = points.where(F.pmod("doc_id", F.lit(50)) == 0)
    return asks.select("doc_id", "tenant_id", "embedding", "text", F.concat(phrase, F.coalesce("text", F.lit(""))).alias("question"))


def _stored(rows, path):
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _flow(spark, d):
    """The flow after its batches."""
    folder = new_folder(spark, "question-flow")
    # Points and index are stored tables: every batch searches them, none makes them.
    points = _stored(v.points(spark, d), f"{folder}/points")
    vectors = tp.stored_vectors(spark, points.drop("embedding"))
    named = points.select("doc_id", "text", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"))

    def shown(hits):
        return hits.join(named, "doc_id").select("query_id", "rank", "text", "source", "score")

    def dense(rows):
        return r.dense_search(rows, points, K).select("query_id", "doc_id", "rank", "score")

    def sparse(rows):
        return sparse_search_packed(packed_vectors(rows, "query_id", "tenant_id"), vectors, K).select("query_id", "doc_id", "rank", "score")

    chunks = F.col("chunks")
    write = F.concat(F.lit("It is in the passages [Source: "), F.get(chunks, F.lit(0)).source, F.lit(", page 1, Chunk #1]"))
    score = F.when(F.get(chunks, F.lit(1)).score >= GOOD, 0.9).otherwise(0.6)
    flow = Flow(spark, folder, (dense, sparse), write, F.struct(score.alias("faithfulness"), score.alias("relevance")), SIMILARITY, TTL, shown)
    asks = _stored(_questions(points), f"{folder}/asks")
    for batch, later in enumerate(LATER):
        rows = asks.select((F.col("doc_id") * 10 + batch).alias("query_id"), "tenant_id", "question", (F.col("doc_id") * 60 + later).alias("asked_at"), "embedding", "text")
        flow.run_batch(rows, batch)
    return flow


def question_flow(spark, d):
    """What every question got, in each batch."""
    rows = _flow(spark, d).answers.read()
    return rows.select("query_id", "tenant_id", "answer", F.array_join("sources", "|").alias("sources"), "query_type", "data_source", "faithfulness", "relevance", F.col("retry_count").cast("long").alias("retry_count"), "cached", "cache_id", "error")


def log_chunks(spark, d):
    """The log of all that was found for them."""
    rows = _flow(spark, d).chunks.read()
    return rows.select("query_id", "tenant_id", F.col("attempt").cast("long").alias("attempt"), F.col("rank").cast("long").alias("rank"), F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), "source", "score", "cited")


# SQL ---------------------------------------------------------------------------------------------------------------------

_IDK, _IDK_ACCOUNT = v._quoted(g.CANNOT_ANSWER), v._quoted(g.CANNOT_ANSWER_ACCOUNT)


def _sql_attempt(n: int, lists: str, asked: str) -> str:
    """``p{n}`` (packed chunks) and ``a{n}`` (answers) of an attempt over the rows of ``asked``."""
    return f"""p{n} AS (SELECT query_id AS id, list(doc_id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores FROM {lists} JOIN (SELECT doc_id, text FROM v_points) USING (doc_id) WHERE trim(coalesce(text, '')) <> '' GROUP BY query_id),
      a{n} AS (SELECT *, CASE WHEN idk THEN 1 WHEN scores[2] >= {GOOD} THEN 0.9 ELSE 0.6 END::DOUBLE AS f, CASE WHEN idk THEN 0 WHEN scores[2] >= {GOOD} THEN 0.9 ELSE 0.6 END::DOUBLE AS rel FROM (
        SELECT id, tenant_id, kind, src, scores, {n} AS tries, src = 'sql' OR ids IS NULL AS idk,
          CASE WHEN src = 'sql' THEN {_IDK_ACCOUNT} WHEN ids IS NULL THEN {_IDK} ELSE 'It is in the passages [Source: doc_' || ids[1] || '.txt, page 1, Chunk #1]' END AS answer,
          CASE WHEN src = 'sql' OR ids IS NULL THEN '' ELSE CASE WHEN src = 'hybrid' THEN '{g.ACCOUNT_SOURCE}|' ELSE '' END || 'doc_' || ids[1] || '.txt, page 1, Chunk #1' END AS sources,
          CASE WHEN src <> 'sql' THEN ids[1] END AS best FROM {asked} LEFT JOIN p{n} USING (id)))"""


def _sql_hits(n: int, later: int, caches: list[str]) -> str:
    cached = " UNION ALL ".join(f"SELECT id * 10 + {i} AS cache_id, id AS c, id * 60 + {LATER[i]} AS created FROM {c}" for i, c in enumerate(caches))
    return f"""h{n} AS (SELECT id, cache_id, c FROM (SELECT s.*, row_number() OVER (PARTITION BY id ORDER BY score DESC, cache_id) AS k FROM (
        SELECT q.id, cache_id, c, round(list_cosine_similarity(q.embedding, p.embedding), 6) AS score FROM asked q JOIN ({cached}) x ON created <= q.id * 60 + {later} AND created >= q.id * 60 + {later - TTL}
        JOIN v_points p ON p.doc_id = c AND p.tenant_id = q.tenant_id WHERE q.tenant_id <> '') s WHERE score >= {SIMILARITY}) WHERE k = 1),
      c{n} AS (SELECT id FROM good ANTI JOIN h{n} USING (id))"""


_FLOW = f"""{with_views('v_points')}, asks AS (SELECT doc_id AS query_id, tenant_id, embedding, text FROM v_points WHERE doc_id % 50 = 0),
      worded AS (SELECT query_id AS id, tenant_id, embedding, regexp_replace(([{', '.join(map(v._quoted, v.PHRASES))}])[CAST((query_id // 50) % {len(v.PHRASES)} + 1 AS INTEGER)] || coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS question FROM asks),
      asked AS (SELECT *, CASE WHEN kind IN ('sql', 'hybrid') THEN kind ELSE 'rag' END AS src FROM (SELECT *, {ap._ROUTE} AS kind FROM worded WHERE question <> '')),
      dl AS ({_sql_dense(K)}),
      sq AS ({tp.sql_sparse('asks', 'query_id', 'tenant_id')}), spp AS ({tp.sql_sparse('v_points', 'doc_id', 'tenant_id')}),
      sl AS ({_TOP.format(q="SELECT query_id, doc_id, round(sum(q.weight * p.weight), 6) AS score FROM sq q JOIN spp p USING (tenant_id, idx) WHERE tenant_id <> '' GROUP BY ALL", k=K)}),
      {_sql_attempt(0, "(SELECT * FROM dl WHERE query_id IN (SELECT id FROM asked WHERE src <> 'sql'))", 'asked')},
      failed AS (SELECT asked.* FROM asked JOIN a0 USING (id) WHERE NOT (f >= {g.PASS_FAITHFULNESS} AND rel >= {g.PASS_RELEVANCE})),
      {_sql_attempt(1, '(SELECT * FROM sl WHERE query_id IN (SELECT id FROM failed))', 'failed')},
      fresh AS (SELECT * FROM a0 WHERE id NOT IN (SELECT id FROM failed) UNION ALL SELECT * FROM a1),
      good AS (SELECT id FROM fresh WHERE src = 'rag' AND f >= 0.8 AND rel >= 0.75),
      {_sql_hits(1, LATER[1], ['good'])}, {_sql_hits(2, LATER[2], ['good', 'c1'])},
      hits AS (SELECT 1 AS batch, * FROM h1 UNION ALL SELECT 2, * FROM h2),
      batches AS (SELECT unnest([0, 1, 2]) AS batch),
      missed AS (SELECT batch, fresh.* FROM fresh, batches WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.batch = batches.batch AND h.id = fresh.id))"""

QUERIES = {"question_flow": question_flow, "log_chunks": log_chunks}

ORACLE_SQL = {
    "question_flow": f"""{_FLOW}
      SELECT id * 10 + batch AS query_id, tenant_id, answer, sources, kind AS query_type, src AS data_source, f AS faithfulness, rel AS relevance, tries::BIGINT AS retry_count, false AS cached, NULL::BIGINT AS cache_id, NULL AS error FROM missed
      UNION ALL SELECT h.id * 10 + batch, tenant_id, answer, sources, kind, src, f, rel, 0, true, cache_id, NULL FROM hits h JOIN fresh ON fresh.id = h.c
      UNION ALL SELECT id * 10 + batch, tenant_id, 'Please provide a question.', '', 'general', 'rag', 0, 0, 0, false, NULL, 'empty question' FROM worded, batches WHERE question = ''""",
    "log_chunks": f"""{_FLOW}, lists AS (SELECT 0 AS attempt, dl.* FROM dl JOIN asked ON id = query_id WHERE src <> 'sql' UNION ALL SELECT 1, sl.* FROM sl JOIN failed ON id = query_id)
      SELECT m.id * 10 + batch AS query_id, m.tenant_id, attempt::BIGINT AS attempt, rank, md5(text) AS text_md5, 'doc_' || l.doc_id || '.txt' AS source, score, coalesce(l.doc_id = best, false) AS cited
      FROM missed m JOIN lists l ON l.query_id = m.id JOIN v_points p ON p.doc_id = l.doc_id""",
}
