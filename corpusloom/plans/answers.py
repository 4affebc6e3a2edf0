"""Batches of questions answered, and chunks routed by content."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import accounts as a
from corpusloom.operators import chunking as ch
from corpusloom.operators import routing as g
from corpusloom.operators.answering import answer, lookup
from corpusloom.plans import accounts as ap
from corpusloom.plans import text as tp
from corpusloom.plans import views as v
from corpusloom.plans.views import with_views

AS_OF = ap.AS_OF


def _questions(spark, d):
    """Each asked question of a customer of some region."""
    q = v.asked(spark, d)
    c = v.table(spark, d, "customer").join(v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select(F.col("c_custkey").alias("customer_id"), F.col("r_name").alias("tenant_id"))
    return q.withColumn("customer_id", F.pmod("query_id", F.lit(100)) + 1).join(c, "customer_id")


def lookup_answers(spark, d):
    q = _questions(spark, d)
    rows = lookup(q, v.transactions(spark, d, q.select("customer_id")), AS_OF)
    return rows.select("query_id", "intent", F.md5(F.col("account_result").cast("binary")).alias("answer_md5"))


def answer_batch(spark, d):
    q = _questions(spark, d)
    hits = q.where("query_id % 3 = 0").select("query_id", F.lit("passage").alias("text"))
    rows = answer(q, v.transactions(spark, d, q.select("customer_id")), hits, AS_OF)
    return rows.select("query_id", "data_source", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.array_join("sources", "|").alias("sources"), "faithfulness", "relevance", "retry")


def chunk_routed(spark, d):
    """Files with enough of the corpus's terms are chunked as parents and children, others in fixed windows."""
    rows = ch.chunk_documents(v.pages(spark, d), terms=tp.CORPUS_TERMS)
    return tp._chunks(rows)


_Q = f"""{with_views('v_asked', 'v_transactions')}, q AS (SELECT query_id, question, r_name AS tenant_id, c_custkey AS customer_id, lower(question) AS lq, regexp_extract(lower(question), '\\b(?:last|recent)\\s+(\\d{{1,2}})\\b', 1) AS num
    FROM v_asked JOIN customer ON c_custkey = query_id % 100 + 1 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    i AS (SELECT *, CASE {' '.join(f"WHEN {ap._any('lq', p)} THEN '{n}'" for n, p in a.INTENT_WORDS)} ELSE 'recent' END AS intent,
      CASE WHEN num <> '' THEN least(greatest(TRY_CAST(num AS INTEGER), 1), 50) ELSE 10 END AS lim, CASE WHEN contains(lq, 'week') THEN 7 ELSE 30 END AS days FROM q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {ap._K} ORDER BY {ap.D} DESC, id, amount, merchant, category) AS n FROM v_transactions),
    rec AS (SELECT query_id, 'Transactions (' || count(*) || ' results):' || chr(10) || string_agg('  ' || CAST({ap.D} AS VARCHAR) || ' | ' || merchant || ' | ' || {ap._m('abs(amount)')} || ' (' || "type" || ')'
      || CASE WHEN coalesce(description, '') <> '' THEN ' — ' || description ELSE '' END || CASE WHEN flagged THEN ' ⚠️' ELSE '' END, chr(10) ORDER BY n) AS answer FROM i JOIN ranked USING ({ap._K}) WHERE intent = 'recent' AND n <= lim GROUP BY query_id),
    bal AS (SELECT {ap._K}, 'Current account balance: ' || CASE WHEN balance >= 0 THEN '+' ELSE '' END || {ap._m('balance')} || chr(10) || 'Total credits received: ' || {ap._m('total_credits')}
      || chr(10) || 'Total debits made: ' || {ap._m('total_debits')} || chr(10) || 'Total transactions on record: ' || total_transactions AS answer FROM ({ap._BALANCE})),
    fl AS ({ap._sql_list('flagged', a.LIST_LIMIT, 'Flagged / suspicious transactions', 'found', ' ⚠️ FLAGGED', False)}),
    cat AS (SELECT {ap._K}, 'Spending breakdown by category:' || chr(10) || string_agg('  ' || category || ': ' || {ap._m('total')} || ' (' || n_transactions || ' transactions)', chr(10) ORDER BY n) AS answer FROM ({ap._CATEGORY}) GROUP BY {ap._K}),
    sp AS (SELECT query_id, days, coalesce(sum(abs(amount)), 0) AS total, count(amount) AS c FROM i LEFT JOIN v_transactions t ON t.tenant_id = i.tenant_id AND t.customer_id = i.customer_id AND "type" = 'debit' AND {ap.D} >= DATE '{AS_OF}' - days WHERE intent = 'spending_period' GROUP BY query_id, days),
    ans AS (SELECT i.query_id, intent, coalesce(CASE intent WHEN 'balance' THEN bal.answer WHEN 'flagged' THEN fl.answer WHEN 'by_category' THEN cat.answer WHEN 'recent' THEN rec.answer
      ELSE 'Spending in the last ' || sp.days || ' days: ' || {ap._m('sp.total')} || chr(10) || 'Number of debit transactions: ' || sp.c || chr(10) || 'Average per transaction: ' || {ap._m('CASE WHEN sp.c = 0 THEN 0 ELSE CAST(sp.total AS DOUBLE) / sp.c END')} END, '{a.NOTHING_FOUND}') AS answer
      FROM i LEFT JOIN bal USING ({ap._K}) LEFT JOIN fl USING ({ap._K}) LEFT JOIN cat USING ({ap._K}) LEFT JOIN rec USING (query_id) LEFT JOIN sp USING (query_id))"""

_GUARDED = f"""g AS (SELECT query_id, tenant_id, customer_id, length(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) AS n_chars, regexp_replace(regexp_replace(question, '^\\s+|\\s+$', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS question FROM q),
    ok AS (SELECT query_id, {ap._ROUTE} AS kind, query_id % 3 = 0 AS hit FROM g WHERE question <> '' AND n_chars <= {g.MAX_QUESTION} AND NOT regexp_matches(question, '{g.INJECTION}')),
    s AS (SELECT query_id, CASE WHEN kind IN ('sql', 'hybrid') THEN kind ELSE 'rag' END AS src, hit, answer AS acc FROM ok JOIN ans USING (query_id)),
    w AS (SELECT query_id, src AS data_source, CASE WHEN src = 'sql' OR src = 'hybrid' AND NOT hit THEN acc WHEN NOT hit THEN {v._quoted(g.CANNOT_ANSWER)} ELSE '' END AS answer,
      CASE WHEN src = 'sql' OR src = 'hybrid' THEN '{g.ACCOUNT_SOURCE}' ELSE '' END AS sources, hit FROM s),
    x AS (SELECT *, CAST(CASE WHEN data_source = 'sql' THEN 1 WHEN answer = '' THEN 0 WHEN answer = {v._quoted(g.CANNOT_ANSWER)} THEN 1 WHEN NOT hit THEN 0 ELSE 0.7 END AS DOUBLE) AS faithfulness,
      CAST(CASE WHEN data_source = 'sql' THEN 1 WHEN answer = '' THEN 0 WHEN answer = {v._quoted(g.CANNOT_ANSWER)} THEN 0 WHEN NOT hit THEN 0 ELSE 0.7 END AS DOUBLE) AS relevance FROM w)"""

QUERIES = {"lookup_answers": lookup_answers, "answer_batch": answer_batch, "chunk_routed": chunk_routed}

ORACLE_SQL = {
    "lookup_answers": f"{_Q} SELECT query_id, intent, md5(answer) AS answer_md5 FROM ans",
    "answer_batch": f"{_Q}, {_GUARDED} SELECT query_id, data_source, md5(answer) AS answer_md5, sources, faithfulness, relevance, NOT (faithfulness >= 0.85 AND relevance >= 0.8) AS retry FROM x",
    "chunk_routed": f"""WITH k AS (SELECT 'doc_' || doc_id || '.txt' AS file_name, financial FROM ({tp.ORACLE_SQL['keyword_classifier']}))
      SELECT c.* FROM ({tp.ORACLE_SQL['chunk_fixed']}) c JOIN k USING (file_name) WHERE NOT financial UNION ALL SELECT c.* FROM ({tp.ORACLE_SQL['chunk_children']}) c JOIN k USING (file_name) WHERE financial""",
}
