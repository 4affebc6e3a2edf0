"""Queries over ingestion state, feedback, tuning, admission and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import admission
from corpusloom.operators import chunking as ch
from corpusloom.operators import feedback as fb
from corpusloom.operators import store as st
from corpusloom.plans import text as tp
from corpusloom.plans import views as v
from corpusloom.plans.views import with_views
from corpusloom.storage import Buckets, new_folder

LONG = "long"
WINDOW_HOURS, PER_WINDOW = 12, 2


def _status(pages):
    """Some files are complete, some were left in progress."""
    rows = pages.where("doc_id % 3 <> 0").select("file_hash", F.when(F.col("doc_id") % 3 == 1, st.COMPLETE).otherwise(st.PROCESSING).alias("status"))
    return rows.groupBy("file_hash").agg(F.min("status").alias("status"))


def hash_gate(spark, d):
    p = v.pages(spark, d)
    return st.hash_gate(p, _status(p)).select("file_name", "file_hash", "tenant_id")


def hash_dedup_docs(spark, d):
    return st.first_of_each_hash(v.pages(spark, d).select("file_hash", "doc_id", "tenant_id"), "doc_id")


def ingestion_state_machine(spark, d):
    p = v.pages(spark, d)
    return st.upload_actions(p, _status(p)).select("file_name", "action")


def status_upsert(spark, d):
    """Statuses of all files, then later statuses of every third."""
    p = v.pages(spark, d)
    row = lambda rows, status, seq: rows.select("file_name", F.lit(status).alias("status"), (F.col("doc_id") % 7).alias("chunk_count"), F.lit(seq).alias("seq"))
    old, new = row(p, st.PROCESSING, 1), row(p.where("doc_id % 3 = 0"), st.COMPLETE, 2)
    return st.upsert(old, new, "file_name", "seq").select("file_name", "status", "chunk_count")


def status_upsert_buckets(spark, d):
    """The same two batches through a stored table, of which the second rewrites the buckets of its keys."""
    p = v.pages(spark, d)
    row = lambda rows, status, seq: rows.select("file_name", F.lit(status).alias("status"), (F.col("doc_id") % 7).alias("chunk_count"), F.lit(seq).alias("seq"))
    table = Buckets(spark, new_folder(spark, "statuses"), "file_name string, status string, chunk_count bigint, seq int", "file_name", "seq")
    table.upsert(row(p, st.PROCESSING, 1), 0)
    table.upsert(row(p.where("doc_id % 3 = 0"), st.COMPLETE, 2), 1)
    return table.read().select("file_name", "status", "chunk_count")


def parents_insert_new(spark, d):
    files = ch.pieces_of_files(v.pages(spark, d))
    new = ch.parents_of(files).select("parent_id", "file_name", F.col("parent_index").cast(LONG).alias("parent_index"))
    return st.insert_new(new.where("parent_index = 0"), new, "parent_id").groupBy("parent_index").agg(F.count("*").alias("n"))


def point_payloads(spark, d):
    """Chunks as points, without vectors, in batches."""
    chunks = ch.chunk_fixed(ch.pieces_of_files(v.pages(spark, d))).join(v.pages(spark, d).select("file_name", "file_hash", "tenant_id"), "file_name")
    chunks = chunks.withColumns({"dense": F.lit(None).cast("array<float>"), "sparse": F.lit(None).cast("map<int,double>")})
    rows = st.points(chunks).select("point_id", F.col("payload.tenant_id").alias("tenant_id"), F.col("payload.page").cast(LONG).alias("page"), (F.size("dense") + F.size("indices")).cast(LONG).alias("n_vector"))
    return rows


def point_batches(spark, d):
    p = v.pages(spark, d)
    rows = st.batches(p, "tenant_id", "doc_id", 16)
    return rows.groupBy("tenant_id", "batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).select("tenant_id", F.col("batch").cast(LONG).alias("batch"), "n", "first_id")


def delete_by_hash(spark, d):
    p = v.pages(spark, d)
    return st.delete_files(p, p.where("doc_id % 10 = 3").select("file_hash")).groupBy("tenant_id").agg(F.count("*").alias("n"))


def tenant_reingest(spark, d):
    p = v.pages(spark, d)
    mapping = p.where("doc_id % 4 = 0").select("file_name", F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"))
    return st.tenant_counts(st.assign_tenants(p, mapping)).select(F.coalesce("tenant_id", F.lit("(all)")).alias("tenant_id"), "n")


def tenant_counts(spark, d):
    return st.tenant_counts(v.pages(spark, d)).select(F.coalesce("tenant_id", F.lit("(all)")).alias("tenant_id"), "n")


def mark_cited(spark, d):
    chunks = v.query_chunks(spark, d)
    cited = v.audit(spark, d).select(F.col("id").alias("query_id"), "tenant_id", F.concat(F.lit("file"), (F.col("id") % 9).cast("string"), F.lit(".pdf")).alias("source"))
    return st.mark_cited(chunks, cited).select("query_id", "chunk_text", "source", "cited")


def audit_log(spark, d):
    a = v.audit(spark, d)
    rows = a.select(F.col("id").alias("query_id"), "tenant_id", F.lit("c1").alias("customer_id"), "question", F.lit("general").alias("query_type"), "data_source", F.when(F.col("id") % 4 > 0, F.col("answer")).alias("answer"),
        F.lit(None).cast("array<string>").alias("sources"), "faithfulness", "relevance", (F.col("id") % 1000 / 7.0).alias("latency_ms"), F.when(F.col("id") % 4 == 0, "failed").alias("error"), "created_at")
    log = st.audit_rows(rows)
    return log.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count("error").alias("n_failed"), F.sum("latency_ms").cast("double").alias("latency_ms"), F.sum(F.size("sources")).alias("n_sources"))


def feedback_triggers(spark, d):
    return fb.triggers(v.feedback(spark, d)).select("tenant_id", "fid", F.col("n").cast(LONG).alias("n"), F.round("rate", 6).alias("rate"))


def helpful_rate_window(spark, d):
    return fb.helpful_rate(v.feedback(spark, d))


def _longs(rows):
    return rows.select("tenant_id", *(F.col(c).cast(LONG).alias(c) for c in fb.DEFAULTS))


def tune_params(spark, d):
    return _longs(fb.tune(fb.helpful_rate(v.feedback(spark, d))))


def tune_params_iterated(spark, d):
    """On events as votes, which have many triggers a tenant."""
    return _longs(fb.tune_all(_event_votes(spark, d)))


def _event_votes(spark, d):
    e = v.table(spark, d, "events")
    return e.select(F.col("event_id").alias("fid"), F.concat(F.lit("t"), (F.col("user_id") % 12).cast("string")).alias("tenant_id"), (F.pmod(F.col("event_id") * 7919, F.lit(97)) < F.pmod("event_id", F.lit(97))).alias("helpful"), F.col("event_id").alias("created_at"))


def params_lookup(spark, d):
    votes = v.feedback(spark, d)
    tuned = fb.tune(fb.helpful_rate(votes)).where("tenant_id <> 'tenant0'")
    return _longs(fb.lookup_params(votes.select("tenant_id").distinct(), tuned))


def admission_limiter(spark, d):
    e = v.table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = admission.admit(e.withColumn("at", F.col("us") / 1e6), "user_id", "at", "event_id", PER_WINDOW, WINDOW_HOURS * 3600.0)
    return rows.select("event_id", "user_id", "accepted")


def admission_ranges(spark, d):
    """All clicks, of hot clients and of none; a click without a time is not judged."""
    rows = v.table(spark, d, "clicks").select("click_id", "client_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = admission.admit_in_ranges(rows, "client_id", "us", "click_id", PER_WINDOW, WINDOW_HOURS * 3600 * 1_000_000)
    return rows.select("click_id", "client_id", "accepted")


def export_sft(spark, d):
    rows = fb.export_sft(v.feedback(spark, d), v.audit(spark, d))
    return rows.select("id", F.md5(F.to_json(F.struct("messages")).cast("binary")).alias("json_md5"))


def export_dpo(spark, d):
    rows = fb.export_dpo(v.feedback(spark, d), v.audit(spark, d))
    return rows.select("prompt", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("chosen", "rejected")))


def export_reranker(spark, d):
    rows = fb.export_reranker(v.feedback(spark, d), v.audit(spark, d), v.query_chunks(spark, d))
    return rows.select("query", F.array_join("pos", "|").alias("pos"), F.array_join("neg", "|").alias("neg"))


def export_summary(spark, d):
    f, a, c = v.feedback(spark, d), v.audit(spark, d), v.query_chunks(spark, d)
    return fb.export_summary({"sft": fb.export_sft(f, a), "dpo": fb.export_dpo(f, a), "reranker": fb.export_reranker(f, a, c)})


# SQL ---------------------------------------------------------------------------------------------------------------------

_P = with_views("v_pages")
_STATUS = f"{_P}, status AS (SELECT file_hash, min(CASE WHEN doc_id % 3 = 1 THEN 'complete' ELSE 'processing' END) AS status FROM v_pages WHERE doc_id % 3 <> 0 GROUP BY file_hash)"
_F = with_views("v_audit", "v_feedback")
_J = "j AS (SELECT f.helpful, a.* FROM v_feedback f JOIN v_audit a ON a.id = f.query_id WHERE a.data_source = 'rag' AND a.answer IS NOT NULL)"
_EVENT_VOTES = "votes AS (SELECT event_id AS fid, 't' || (user_id % 12) AS tenant_id, (event_id * 7919) % 97 < event_id % 97 AS helpful, event_id AS created_at FROM events)"


def _sql_triggers(votes: str) -> str:
    return f"""SELECT tenant_id, fid, n, h / CAST(t AS DOUBLE) AS rate FROM (SELECT tenant_id, fid, row_number() OVER o AS n, sum(CASE WHEN helpful THEN 1 ELSE 0 END) OVER l AS h, count(*) OVER l AS t FROM {votes}
      WINDOW o AS (PARTITION BY tenant_id ORDER BY created_at, fid), l AS (PARTITION BY tenant_id ORDER BY created_at, fid ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE n % 10 = 0"""


_RATE = "rate AS (SELECT tenant_id, count(*) FILTER (WHERE helpful) AS helpful_count, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, fid DESC) AS n FROM v_feedback) WHERE n <= 50 GROUP BY tenant_id)"
_NEXT = "CASE WHEN {r} < 0.5 THEN least({k} + 5, 50) WHEN {r} > 0.8 THEN greatest({k} - 2, 10) ELSE {k} END"
_REST = "CAST(top_k AS BIGINT) AS top_k, CAST(least(greatest(round_even(CAST(top_k * 0.4 AS DECIMAL(6,1)), 0), 4), 20) AS BIGINT) AS rerank_top_n, CAST(least(greatest(round_even(CAST(top_k * 0.3 AS DECIMAL(6,1)), 0), 3), 10) AS BIGINT) AS mmr_final_k"
_TUNED = f"tuned AS (SELECT tenant_id, {_REST} FROM (SELECT tenant_id, {_NEXT.format(r='(helpful_count / CAST(total AS DOUBLE))', k='20')} AS top_k FROM rate))"
_SFT = "SELECT id, question, answer FROM j WHERE helpful AND faithfulness >= 0.85 AND relevance >= 0.8 AND answer <> ''"
_DPO = "SELECT question AS prompt, max(answer) FILTER (WHERE helpful) AS chosen, max(answer) FILTER (WHERE NOT helpful) AS rejected FROM j GROUP BY question HAVING chosen <> '' AND rejected <> '' AND chosen <> rejected"
_RERANK = "SELECT question AS query, string_agg(chunk_text, '|' ORDER BY chunk_text) FILTER (WHERE cited) AS pos, string_agg(chunk_text, '|' ORDER BY chunk_text) FILTER (WHERE NOT cited) AS neg FROM j JOIN v_query_chunks c ON c.query_id = j.id WHERE helpful GROUP BY question HAVING pos IS NOT NULL AND neg IS NOT NULL"
_X = with_views("v_audit", "v_feedback", "v_query_chunks")

QUERIES = {
    "hash_gate": hash_gate,
    "hash_dedup_docs": hash_dedup_docs,
    "ingestion_state_machine": ingestion_state_machine,
    "status_upsert": status_upsert,
    "status_upsert_buckets": status_upsert_buckets,
    "parents_insert_new": parents_insert_new,
    "point_payloads": point_payloads,
    "point_batches": point_batches,
    "delete_by_hash": delete_by_hash,
    "tenant_reingest": tenant_reingest,
    "tenant_counts": tenant_counts,
    "mark_cited": mark_cited,
    "audit_log": audit_log,
    "feedback_triggers": feedback_triggers,
    "helpful_rate_window": helpful_rate_window,
    "tune_params": tune_params,
    "tune_params_iterated": tune_params_iterated,
    "params_lookup": params_lookup,
    "admission_limiter": admission_limiter,
    "admission_ranges": admission_ranges,
    "export_sft": export_sft,
    "export_dpo": export_dpo,
    "export_reranker": export_reranker,
    "export_summary": export_summary,
}

ORACLE_SQL = {
    "hash_gate": f"{_STATUS} SELECT file_name, file_hash, tenant_id FROM v_pages p WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.file_hash = p.file_hash AND s.status = 'complete')",
    "hash_dedup_docs": f"{_P} SELECT file_hash, min(doc_id) AS doc_id, arg_min(tenant_id, doc_id) AS tenant_id FROM v_pages GROUP BY file_hash",
    "ingestion_state_machine": f"{_STATUS} SELECT file_name, CASE WHEN status = 'complete' THEN 'skip' WHEN status = 'processing' THEN 'restart' ELSE 'ingest' END AS action FROM v_pages LEFT JOIN status USING (file_hash)",
    "status_upsert": f"{_P} SELECT file_name, CASE WHEN doc_id % 3 = 0 THEN 'complete' ELSE 'processing' END AS status, doc_id % 7 AS chunk_count FROM v_pages",
    "parents_insert_new": f"{tp._PARENTS}, u AS (SELECT DISTINCT parent_id, parent_index FROM parents) SELECT CAST(parent_index AS BIGINT) AS parent_index, count(*) AS n FROM u WHERE parent_index > 0 GROUP BY parent_index",
    "point_payloads": f"SELECT sha256(file_hash || '|' || chunk_index) AS point_id, tenant_id, c.page, CAST(0 AS BIGINT) AS n_vector FROM ({tp.ORACLE_SQL['chunk_fixed']}) c JOIN ({v.SQL['v_pages']}) p USING (file_name)",
    "point_batches": f"{_P} SELECT tenant_id, batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT *, (row_number() OVER (PARTITION BY tenant_id ORDER BY doc_id) - 1) // 16 AS batch FROM v_pages) GROUP BY ALL",
    "delete_by_hash": f"{_P} SELECT tenant_id, count(*) AS n FROM v_pages WHERE file_hash NOT IN (SELECT file_hash FROM v_pages WHERE doc_id % 10 = 3) GROUP BY tenant_id",
    "tenant_reingest": f"{_P}, t AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 't' || (doc_id % 3) ELSE tenant_id END AS tenant_id FROM v_pages) SELECT tenant_id, count(*) AS n FROM t GROUP BY tenant_id UNION ALL SELECT '(all)', count(*) FROM t",
    "tenant_counts": f"{_P} SELECT tenant_id, count(*) AS n FROM v_pages GROUP BY tenant_id UNION ALL SELECT '(all)', count(*) FROM v_pages",
    "mark_cited": f"{with_views('v_audit', 'v_query_chunks')} SELECT query_id, chunk_text, source, cited OR source = 'file' || (query_id % 9) || '.pdf' AS cited FROM v_query_chunks",
    "audit_log": f"{with_views('v_audit')} SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE id % 4 = 0) AS n_failed, CAST(sum(CAST(id % 1000 / 7.0::DOUBLE AS DECIMAL(10,2))) AS DOUBLE) AS latency_ms, CAST(0 AS BIGINT) AS n_sources FROM v_audit GROUP BY tenant_id",
    "feedback_triggers": f"{_F} SELECT tenant_id, fid, n, round(rate, 6) AS rate FROM ({_sql_triggers('v_feedback')})",
    "helpful_rate_window": f"{_F}, {_RATE} SELECT * FROM rate",
    "tune_params": f"{_F}, {_RATE}, {_TUNED} SELECT * FROM tuned",
    "tune_params_iterated": f"""WITH RECURSIVE {_EVENT_VOTES}, t AS ({_sql_triggers('votes')}),
      w AS (SELECT tenant_id, CAST(0 AS BIGINT) AS n, CAST(20 AS BIGINT) AS top_k FROM (SELECT DISTINCT tenant_id FROM t)
        UNION ALL SELECT w.tenant_id, t.n, CAST({_NEXT.format(r='t.rate', k='top_k')} AS BIGINT) FROM w JOIN t ON t.tenant_id = w.tenant_id AND t.n = w.n + 10)
      SELECT tenant_id, {_REST} FROM (SELECT tenant_id, arg_max(top_k, n) AS top_k FROM w GROUP BY tenant_id)""",
    "params_lookup": f"{_F}, {_RATE}, {_TUNED} SELECT tenant_id, coalesce(t.top_k, 20) AS top_k, coalesce(t.rerank_top_n, 8) AS rerank_top_n, coalesce(t.mmr_final_k, 6) AS mmr_final_k FROM (SELECT DISTINCT tenant_id FROM v_feedback) LEFT JOIN (SELECT * FROM tuned WHERE tenant_id <> 'tenant0') t USING (tenant_id)",
    "admission_limiter": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      w AS (SELECT user_id, event_id, n, true AS accepted, [us] AS taken FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_id, e.n, ok, CASE WHEN ok THEN list_append(taken, e.us) ELSE taken END FROM (
          SELECT w.taken, e.*, len(w.taken) < {PER_WINDOW} OR w.taken[-{PER_WINDOW}] < e.us - {WINDOW_HOURS * 3600 * 1_000_000} AS ok FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) e)
      SELECT event_id, user_id, accepted FROM w""",
    "admission_ranges": f"""WITH RECURSIVE e AS (SELECT click_id, coalesce(client_id, -1) AS k, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS n FROM clicks WHERE ts IS NOT NULL),
      w AS (SELECT k, click_id, n, true AS accepted, [us] AS taken FROM e WHERE n = 1
        UNION ALL SELECT e.k, e.click_id, e.n, ok, CASE WHEN ok THEN list_append(taken, e.us)[-{PER_WINDOW}:] ELSE taken END FROM (
          SELECT w.taken, e.*, len(w.taken) < {PER_WINDOW} OR w.taken[-{PER_WINDOW}] < e.us - {WINDOW_HOURS * 3600 * 1_000_000} AS ok FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1) e)
      SELECT click_id, nullif(k, -1) AS client_id, accepted FROM w UNION ALL SELECT click_id, client_id, NULL FROM clicks WHERE ts IS NULL""",
    "export_sft": f"{_F}, {_J} SELECT id, md5(CAST(to_json({{'messages': [{{'role': 'user', 'content': question}}, {{'role': 'assistant', 'content': answer}}]}}) AS VARCHAR)) AS json_md5 FROM ({_SFT})",
    "export_dpo": f"{_F}, {_J} SELECT prompt, md5(chosen) AS chosen, md5(rejected) AS rejected FROM ({_DPO})",
    "export_reranker": f"{_X}, {_J} {_RERANK}",
    "export_summary": f"{_X}, {_J} SELECT name, n, n >= least AS ready FROM (SELECT 'sft' AS name, count(*) AS n, 100 AS least FROM ({_SFT}) UNION ALL SELECT 'dpo', count(*), 50 FROM ({_DPO}) UNION ALL SELECT 'reranker', count(*), 200 FROM ({_RERANK}))",
}
ORACLE_SQL["status_upsert_buckets"] = ORACLE_SQL["status_upsert"]
