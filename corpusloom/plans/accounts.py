"""Queries over account questions, routing rules and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import accounts as a
from corpusloom.operators import routing as g
from corpusloom.plans import views as v
from corpusloom.plans.views import with_views
from corpusloom.storage import new_folder

AS_OF, DAYS = "1998-12-01", 90
LONG, DOUBLE = "long", "double"
D = '"date"'


def _doubles(rows, *cols):
    return rows.withColumns({c: F.col(c).cast(DOUBLE) for c in cols})


def _line(rows):
    return _doubles(rows, "amount").select("tenant_id", "customer_id", F.col("n").cast(LONG).alias("n"), "id", "amount", "merchant", "category", F.col("date").cast("string").alias("day"), "type")


def intent_balance(spark, d):
    return _doubles(a.balance(v.transactions(spark, d)), "balance", "total_credits", "total_debits")


def intent_recent(spark, d):
    return _line(a.recent(v.transactions(spark, d)))


def intent_flagged(spark, d):
    return _line(a.flagged(v.transactions(spark, d)))


def intent_spending_period(spark, d):
    rows = _doubles(a.spending_period(v.transactions(spark, d), AS_OF, DAYS), "total_spent")
    return rows.select("tenant_id", "customer_id", "total_spent", "num_transactions", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"))


def intent_by_category(spark, d):
    rows = _doubles(a.by_category(v.transactions(spark, d)), "total")
    return rows.select("tenant_id", "customer_id", "category", "total", F.col("count").alias("n_transactions"), F.col("n").cast(LONG).alias("n"))


def intent_by_merchant(spark, d):
    return _line(a.by_merchant(v.transactions(spark, d), "%supplier#%5%"))


def intent_formatted(spark, d):
    """Every customer's answer to each intent, by digest.  The five templates read one stored table, in which a customer's rows lie together,
    so that each of them adds up and cuts most of its rows before it shuffles; a customer with very many lies in several files."""
    path = f"{new_folder(spark, 'transactions')}/rows"
    t = v.transactions(spark, d)
    t.hint("rebalance", *a.KEYS).write.parquet(path)
    t = spark.read.schema(t.schema).parquet(path)
    answers = {
        "balance": a.render_balance(a.balance(t)),
        "recent": a.render_transactions(a.recent(t)),
        "flagged": a.render_flagged(a.flagged(t)),
        "spending_period": a.render_spending(a.spending_period(t, AS_OF, DAYS), DAYS),
        "by_category": a.render_categories(a.by_category(t)),
    }
    out = None
    for intent, rows in answers.items():
        rows = rows.select("tenant_id", "customer_id", F.lit(intent).alias("intent"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.length("answer").cast(LONG).alias("n_chars"))
        out = rows if out is None else out.unionByName(rows)
    return out


def seed_dedup(spark, d):
    """Each transaction twice under two ids; one of each stays."""
    t = v.transactions(spark, d)
    twice = t.unionByName(t.withColumn("id", F.col("id") + 10_000_000_000))
    rows = a.distinct_transactions(twice)
    return rows.groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("amount").cast(DOUBLE).alias("total"))


def intent_guard(spark, d):
    q = v.asked(spark, d)
    k = F.pmod("query_id", F.lit(7))
    raw = q.select(
        "query_id",
        F.element_at(F.array(*map(F.lit, ["balance", "drop table", "recent", "flagged", "by_merchant", "x", "by_category"])), (k + 1).cast("int")).alias("intent"),
        F.element_at(F.array(*map(F.lit, ["9999", "0", "-3", "abc", "12", "50", "7"])), (k + 1).cast("int")).alias("limit"),
        F.element_at(F.array(*map(F.lit, ["-10", "365", "366", "", "30", "0", "1"])), (k + 1).cast("int")).alias("days"),
        F.element_at(F.array(*map(F.lit, ["Starbucks", "", "50%_off", " A_b ", "x", "", "y%"])), (k + 1).cast("int")).alias("merchant"),
    )
    return a.safe_intent(raw).select("query_id", "intent", F.col("limit").cast(LONG).alias("limit"), F.col("days").cast(LONG).alias("days"), "merchant")


def intent_fallback(spark, d):
    rows = v.asked(spark, d)
    return rows.select("query_id", *(c.cast(LONG).alias(n) if n != "intent" else c.alias(n) for n, c in a.fallback_intent(F.col("question")).items()))


def question_guard(spark, d):
    rows = v.asked(spark, d).select("query_id", F.when(F.pmod("query_id", F.lit(9)) == 0, F.repeat("question", F.lit(40))).otherwise(F.col("question")).alias("question"))
    got = g.guard_question(F.col("question"))
    return rows.select("query_id", F.md5(got["clean"].cast("binary")).alias("clean_md5"), got["reason"].alias("reason"))


def control_strip(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", F.concat(F.lit("\x00\x07"), F.col("text"), F.lit("\x1f\x7f\n")).alias("question"))
    return rows.select("doc_id", F.md5(g.guard_question(F.col("question"))["clean"].cast("binary")).alias("clean_md5"))


def route_questions(spark, d):
    kind = g.route(F.col("question"))
    source = g.data_source(kind)
    return v.asked(spark, d).select("query_id", kind.alias("query_type"), source.alias("data_source"), g.next_step(source).alias("next_step"), g.step_after_lookup(source).alias("after_lookup"))


def _replies(spark, d):
    """Model replies as JSON, some fenced, some broken."""
    q = v.asked(spark, d)
    k = F.pmod("query_id", F.lit(6))
    bodies = [
        '{"query_type": "comparative", "needs_decomposition": true, "sub_questions": ["a?", " ", "b?", "c?", "d?", "e?"]}',
        '```json\n{"query_type": "conceptual", "hyde_applicable": true, "hyde_query": "A long enough hypothetical answer."}\n```',
        '{"query_type": "temporal", "hyde_applicable": true, "hyde_query": "Short."}',
        '```\n{"query_type": "nonsense", "sub_questions": ["x?"]}\n```',
        '{"query_type": "multi_company", "needs_decomposition": true, "sub_questions": []}',
        '{"query_type": "numerical", "hyde_applicable": true, "hyde_query": "A long enough hypothetical answer."}',
    ]
    return q.select("query_id", "question", F.element_at(F.array(*map(F.lit, bodies)), (k + 1).cast("int")).alias("reply")), bodies


def analysis_guard(spark, d):
    rows = g.analyze(_replies(spark, d)[0], "reply")
    return rows.select("query_id", "query_type", "needs_decomposition", F.array_join("sub_questions", "|").alias("subs"), "hyde_applicable", "hyde_query", "data_source")


def _answers(spark, d):
    """Answers that cite, and some that do not."""
    k = F.pmod("id", F.lit(5))
    cited = F.concat(F.lit("See [Source: file"), k.cast("string"), F.lit(".pdf, page 2, Chunk #1] and [Source:  b.pdf , page 1] and [Source: file"), k.cast("string"), F.lit(".pdf, page 2, Chunk #1] "), F.col("answer"))
    text = F.when(k == 0, F.lit("  I cannot find this information in the available documents. ")).when(k == 1, F.lit("")).when(k == 2, F.lit("short")).otherwise(cited)
    return v.audit(spark, d).select("id", text.alias("answer"), F.pmod("id", F.lit(4)).cast("int").alias("n_chunks"), "data_source", "faithfulness", "relevance")


def extract_sources(spark, d):
    rows = _answers(spark, d)
    return rows.select("id", F.array_join(g.extract_sources(F.col("answer")), "|").alias("sources"))


def cited_files(spark, d):
    rows = _answers(spark, d)
    flags = g.answer_flags(F.col("answer"))
    return rows.select("id", F.array_join(g.cited_files(g.extract_sources(F.col("answer"))), "|").alias("files"), flags["uncited"].alias("uncited"), flags["too_short"].alias("too_short"))


_SCORES = ["1.5", "-0.1", "0.42", "bad", "", "1e-3", "NaN"]


def score_guard(spark, d):
    rows = v.audit(spark, d)
    x = F.element_at(F.array(*map(F.lit, _SCORES)), (F.pmod("id", F.lit(7)) + 1).cast("int"))
    return rows.select("id", g.safe_score(x).alias("score"))


def evaluate_route(spark, d):
    rows = _answers(spark, d)
    scores = g.quick_scores(F.col("answer"), F.col("n_chunks"))
    rows = rows.select("id", F.coalesce(scores.faithfulness, "faithfulness").alias("f"), F.coalesce(scores.relevance, "relevance").alias("r"), F.pmod("id", F.lit(2)).alias("retries"))
    return rows.select("id", F.round("f", 6).alias("faithfulness"), F.round("r", 6).alias("relevance"), g.step_after_evaluate(F.col("f"), F.col("r"), F.col("retries")).alias("step"))


def synthesize_answers(spark, d):
    rows = _answers(spark, d).withColumns({"account_result": F.when(F.pmod("id", F.lit(3)) == 0, F.lit("Balance $5")), "written": F.col("answer"), "data_source": F.when(F.pmod("id", F.lit(7)) == 0, "hybrid").otherwise(F.col("data_source"))})
    out = g.evaluate(g.synthesize(rows.drop("answer", "faithfulness", "relevance"), "written"))
    return out.select("id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.array_join("sources", "|").alias("sources"), "faithfulness", "relevance")


def registration_guard(spark, d):
    c = v.table(spark, d, "customer")
    k = F.pmod("c_custkey", F.lit(6))
    rows = c.select(
        "c_custkey",
        F.when(k == 0, "a b").when(k == 1, "xy").otherwise(F.concat(F.lit("user_"), F.col("c_custkey").cast("string"))).alias("username"),
        F.when(k == 2, "short").otherwise("long enough").alias("password"),
        F.when(k == 3, "Tenant!").otherwise("tenant-1").alias("tenant_id"),
        F.concat(F.lit(" U"), F.col("c_custkey").cast("string"), F.when(k == 4, F.lit("_at_")).otherwise(F.lit("@")), F.lit("X.com ")).alias("email"),
        F.col("c_custkey").cast("string").alias("customer_id"),
    )
    return g.valid_registration(rows).select("c_custkey", "valid")


def tenant_by_email_domain(spark, d):
    n = v.table(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit(".com")).alias("email_domain"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("tenant_id"))
    c = v.table(spark, d, "customer").join(v.table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    host = F.when(F.pmod("c_custkey", F.lit(10)) == 0, F.lit("nowhere.org")).otherwise(F.concat(F.col("n_name"), F.lit(".COM ")))
    rows = c.select("c_custkey", F.concat(F.lit("a@b@"), host).alias("email"))
    return g.tenant_of_email(rows, n).select("c_custkey", "email_domain", "tenant_id")


def token_revocation(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("jti"), "user_id")
    return g.not_revoked(e, e.where("jti % 7 = 0").select("jti")).groupBy("user_id").agg(F.count("*").alias("n"))


# SQL ---------------------------------------------------------------------------------------------------------------------

_T = with_views("v_transactions")
_K = "tenant_id, customer_id"


def _sql_newest(where: str, limit: int) -> str:
    return f"SELECT {_K}, n, id, CAST(amount AS DOUBLE) AS amount, merchant, category, CAST({D} AS VARCHAR) AS day, \"type\" FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY {D} DESC, id, amount, merchant, category) AS n FROM v_transactions WHERE {where}) WHERE n <= {limit}"


_BALANCE = f"""SELECT {_K}, sum(amount) AS balance, count(*) AS total_transactions, sum(CASE WHEN "type" = 'credit' THEN amount ELSE 0 END) AS total_credits,
    sum(CASE WHEN "type" = 'debit' THEN abs(amount) ELSE 0 END) AS total_debits FROM v_transactions GROUP BY ALL"""
_SPENT = f"""SELECT {_K}, sum(abs(amount)) AS total_spent, count(*) AS num_transactions, min({D}) AS from_date, max({D}) AS to_date FROM v_transactions
    WHERE "type" = 'debit' AND {D} >= DATE '{AS_OF}' - {DAYS} GROUP BY {_K}"""
_CATEGORY = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY total DESC, category) AS n FROM
    (SELECT {_K}, category, sum(abs(amount)) AS total, count(*) AS n_transactions FROM v_transactions WHERE "type" = 'debit' GROUP BY ALL)) WHERE n <= {a.LIST_LIMIT}"""


def _m(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _sql_list(where: str, limit: int, head: str, tail: str, mark: str, describe: bool) -> str:
    desc = "|| CASE WHEN coalesce(description, '') <> '' THEN ' — ' || description ELSE '' END" if describe else ""
    line = f"'  ' || CAST({D} AS VARCHAR) || ' | ' || merchant || ' | ' || {_m('abs(amount)')} || ' (' || \"type\" || ')' {desc} || CASE WHEN flagged THEN '{mark}' ELSE '' END"
    return f"SELECT {_K}, '{head} (' || count(*) || ' {tail}):' || chr(10) || string_agg({line}, chr(10) ORDER BY n) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY {D} DESC, id, amount, merchant, category) AS n FROM v_transactions WHERE {where}) WHERE n <= {limit} GROUP BY {_K}"


def _any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {v._quoted(p)})" for p in phrases) + ")"


def _pick(values, k: str) -> str:
    return f"([{', '.join(map(v._quoted, values))}])[CAST({k} + 1 AS INTEGER)]"


def _clamp(x: str, default: int, most: int) -> str:
    return f"CAST(least(greatest(coalesce(nullif(TRY_CAST({x} AS INTEGER), 0), {default}), 1), {most}) AS BIGINT)"


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_S = lambda x: _STRIP.format(x=x)
_ROUTE = f"CASE WHEN {_any('lower(question)', g.HYBRID_PHRASES)} THEN 'hybrid' WHEN {_any('lower(question)', g.SQL_PHRASES)} THEN 'sql' ELSE 'general' END"
_IDK = v._quoted("  " + g.CANNOT_ANSWER + " ")
_ANSWERS = f"""{with_views('v_audit')}, v_answers AS (SELECT id, CASE id % 5 WHEN 0 THEN {_IDK} WHEN 1 THEN '' WHEN 2 THEN 'short'
    ELSE 'See [Source: file' || (id % 5) || '.pdf, page 2, Chunk #1] and [Source:  b.pdf , page 1] and [Source: file' || (id % 5) || '.pdf, page 2, Chunk #1] ' || answer END AS answer,
    id % 4 AS n_chunks, data_source, faithfulness, relevance FROM v_audit)"""
_FOUND = f"list_transform(regexp_extract_all(answer, '\\[Source:\\s*([^\\]]+)\\]', 1), lambda s: {_S('s')})"


def _first(x: str) -> str:
    """Distinct elements in the order of their first places."""
    return f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({x}, lambda e: [e])), lambda p, q: CASE WHEN list_contains(p, q[1]) THEN p ELSE list_concat(p, q) END)"


_SOURCES = _first(_FOUND)
_TOLD = f"lower({_S('answer')}) <> {v._quoted(g.CANNOT_ANSWER.lower())}"
_QUICK = f"CASE WHEN {_S('answer')} = '' THEN 0 WHEN lower({_S('answer')}) = {v._quoted(g.CANNOT_ANSWER.lower())} THEN {{one}} WHEN n_chunks = 0 THEN 0 ELSE {{x}} END"

QUERIES = {
    "intent_balance": intent_balance,
    "intent_recent": intent_recent,
    "intent_flagged": intent_flagged,
    "intent_spending_period": intent_spending_period,
    "intent_by_category": intent_by_category,
    "intent_by_merchant": intent_by_merchant,
    "intent_formatted": intent_formatted,
    "intent_guard": intent_guard,
    "intent_fallback": intent_fallback,
    "seed_dedup": seed_dedup,
    "question_guard": question_guard,
    "control_strip": control_strip,
    "route_questions": route_questions,
    "analysis_guard": analysis_guard,
    "extract_sources": extract_sources,
    "cited_files": cited_files,
    "score_guard": score_guard,
    "evaluate_route": evaluate_route,
    "synthesize_answers": synthesize_answers,
    "registration_guard": registration_guard,
    "tenant_by_email_domain": tenant_by_email_domain,
    "token_revocation": token_revocation,
}

ORACLE_SQL = {
    "intent_balance": f"{_T} SELECT {_K}, CAST(balance AS DOUBLE) AS balance, total_transactions, CAST(total_credits AS DOUBLE) AS total_credits, CAST(total_debits AS DOUBLE) AS total_debits FROM ({_BALANCE})",
    "intent_recent": f"{_T} {_sql_newest('true', a.DEFAULT_LIMIT)}",
    "intent_flagged": f"{_T} {_sql_newest('flagged', a.LIST_LIMIT)}",
    "intent_spending_period": f"{_T} SELECT {_K}, CAST(total_spent AS DOUBLE) AS total_spent, num_transactions, CAST(from_date AS VARCHAR) AS from_date, CAST(to_date AS VARCHAR) AS to_date FROM ({_SPENT})",
    "intent_by_category": f"{_T} SELECT {_K}, category, CAST(total AS DOUBLE) AS total, n_transactions, n FROM ({_CATEGORY})",
    "intent_by_merchant": _T + " " + _sql_newest("merchant ILIKE '%supplier#%5%'", a.LIST_LIMIT),
    "intent_formatted": f"""{_T}, answers AS (
      SELECT {_K}, 'balance' AS intent, 'Current account balance: ' || CASE WHEN balance >= 0 THEN '+' ELSE '' END || {_m('balance')} || chr(10) || 'Total credits received: ' || {_m('total_credits')}
        || chr(10) || 'Total debits made: ' || {_m('total_debits')} || chr(10) || 'Total transactions on record: ' || total_transactions AS answer FROM ({_BALANCE})
      UNION ALL SELECT {_K}, 'spending_period', 'Spending in the last {DAYS} days: ' || {_m('total_spent')} || chr(10) || 'Number of debit transactions: ' || num_transactions || chr(10) || 'Average per transaction: '
        || {_m('CAST(total_spent AS DOUBLE) / num_transactions')} FROM ({_SPENT})
      UNION ALL SELECT {_K}, 'by_category', 'Spending breakdown by category:' || chr(10) || string_agg('  ' || category || ': ' || {_m('total')} || ' (' || n_transactions || ' transactions)', chr(10) ORDER BY n) FROM ({_CATEGORY}) GROUP BY {_K}
      UNION ALL SELECT {_K}, 'recent', answer FROM ({_sql_list('true', a.DEFAULT_LIMIT, 'Transactions', 'results', ' ⚠️', True)})
      UNION ALL SELECT {_K}, 'flagged', answer FROM ({_sql_list('flagged', a.LIST_LIMIT, 'Flagged / suspicious transactions', 'found', ' ⚠️ FLAGGED', False)}))
      SELECT {_K}, intent, md5(answer) AS answer_md5, CAST(length(answer) AS BIGINT) AS n_chars FROM answers""",
    "seed_dedup": f"{_T} SELECT tenant_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM (SELECT DISTINCT * EXCLUDE (id) FROM v_transactions) GROUP BY tenant_id",
    "intent_guard": f"""{with_views('v_asked')}, raw AS (SELECT query_id, {_pick(["balance", "drop table", "recent", "flagged", "by_merchant", "x", "by_category"], 'query_id % 7')} AS i, {_pick(["9999", "0", "-3", "abc", "12", "50", "7"], 'query_id % 7')} AS l,
      {_pick(["-10", "365", "366", "", "30", "0", "1"], 'query_id % 7')} AS d, {_pick(["Starbucks", "", "50%_off", " A_b ", "x", "", "y%"], 'query_id % 7')} AS m FROM v_asked)
      SELECT query_id, CASE WHEN i IN ({', '.join(map(v._quoted, a.INTENTS))}) THEN i ELSE 'recent' END AS intent, {_clamp('l', 10, 50)} AS "limit", {_clamp('d', 30, 365)} AS days,
        CASE WHEN m <> '' THEN '%' || trim(replace(replace(left(m, 100), '%', ''), '_', ' ')) || '%' END AS merchant FROM raw""",
    "intent_fallback": f"""{with_views('v_asked')}, x AS (SELECT query_id, lower(question) AS q, regexp_extract(lower(question), '\\b(?:last|recent)\\s+(\\d{{1,2}})\\b', 1) AS n FROM v_asked)
      SELECT query_id, CASE {' '.join(f"WHEN {_any('q', p)} THEN '{i}'" for i, p in a.INTENT_WORDS)} ELSE 'recent' END AS intent,
        CAST(CASE WHEN n <> '' THEN least(greatest(TRY_CAST(n AS INTEGER), 1), 50) ELSE 10 END AS BIGINT) AS "limit", CAST(CASE WHEN contains(q, 'week') THEN 7 WHEN contains(q, 'month') THEN 30 ELSE 30 END AS BIGINT) AS days FROM x""",
    "question_guard": f"""{with_views('v_asked')}, x AS (SELECT query_id, {_S("CASE WHEN query_id % 9 = 0 THEN repeat(question, 40) ELSE question END")} AS t FROM v_asked),
      y AS (SELECT query_id, t, regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS clean FROM x)
      SELECT query_id, md5(clean) AS clean_md5, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 2000 THEN 'too long' WHEN regexp_matches(clean, '{g.INJECTION}') THEN 'invalid content' END AS reason FROM y""",
    "control_strip": f"""SELECT doc_id, md5(regexp_replace({_S("chr(1) || chr(7) || text || chr(31) || chr(127) || chr(10)")}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS clean_md5 FROM documents""",
    "route_questions": f"""{with_views('v_asked')}, x AS (SELECT query_id, {_ROUTE} AS query_type FROM v_asked), y AS (SELECT *, CASE WHEN query_type IN ('sql', 'hybrid') THEN query_type ELSE 'rag' END AS data_source FROM x)
      SELECT *, CASE WHEN data_source IN ('sql', 'hybrid') THEN 'lookup' ELSE 'retrieve' END AS next_step, CASE WHEN data_source = 'hybrid' THEN 'retrieve' ELSE 'synthesize' END AS after_lookup FROM y""",
    "analysis_guard": f"""{with_views('v_asked')}, k AS (SELECT query_id, question, query_id % 6 AS k FROM v_asked)
      SELECT query_id, {_pick(["comparative", "conceptual", "temporal", "general", "multi_company", "numerical"], 'k')} AS query_type, k = 0 AS needs_decomposition,
        CASE k WHEN 0 THEN 'a?|b?|c?|d?' WHEN 4 THEN question ELSE '' END AS subs, k = 1 AS hyde_applicable, CASE k WHEN 1 THEN 'A long enough hypothetical answer.' ELSE '' END AS hyde_query, 'rag' AS data_source FROM k""",
    "extract_sources": f"{_ANSWERS} SELECT id, array_to_string({_SOURCES}, '|') AS sources FROM v_answers",
    "cited_files": f"""{_ANSWERS} SELECT id, array_to_string({_first(f"list_filter(list_transform({_SOURCES}, lambda s: {_S('split_part(s, chr(44), 1)')}), lambda s: s <> '')")}, '|') AS files,
      {_TOLD} AND len({_FOUND}) = 0 AS uncited, {_TOLD} AND length({_S('answer')}) < 50 AS too_short FROM v_answers""",
    "score_guard": f"""{with_views('v_audit')}, x AS (SELECT id, TRY_CAST({_pick(_SCORES, 'id % 7')} AS DOUBLE) AS x FROM v_audit)
      SELECT id, CASE WHEN x IS NULL OR isnan(x) THEN 0.7 ELSE greatest(0.0, least(1.0, x)) END AS score FROM x""",
    "evaluate_route": f"""{_ANSWERS}, x AS (SELECT id, CAST({_QUICK.format(one=1, x='faithfulness')} AS DOUBLE) AS f, CAST({_QUICK.format(one=0, x='relevance')} AS DOUBLE) AS r, id % 2 AS retries FROM v_answers)
      SELECT id, round(f, 6) AS faithfulness, round(r, 6) AS relevance, CASE WHEN f >= 0.85 AND r >= 0.8 OR retries >= 1 THEN 'end' ELSE 'retry' END AS step FROM x""",
    "synthesize_answers": f"""{_ANSWERS}, x AS (SELECT id, answer AS written, n_chunks, CASE WHEN id % 7 = 0 THEN 'hybrid' ELSE data_source END AS src, CASE WHEN id % 3 = 0 THEN 'Balance $5' ELSE '' END AS acc, {_SOURCES} AS cited FROM v_answers),
      y AS (SELECT *, (src = 'sql' AND acc <> '') OR (src = 'hybrid' AND n_chunks = 0 AND acc <> '') AS fa FROM x),
      z AS (SELECT *, CASE WHEN fa THEN acc WHEN src = 'sql' THEN {v._quoted(g.CANNOT_ANSWER_ACCOUNT)} WHEN n_chunks = 0 THEN {v._quoted(g.CANNOT_ANSWER)} ELSE written END AS answer FROM y),
      w AS (SELECT *, lower({_S('answer')}) IN ({v._quoted(g.CANNOT_ANSWER.lower())}, {v._quoted(g.CANNOT_ANSWER_ACCOUNT.lower())}) AS idk FROM z)
      SELECT id, md5(answer) AS answer_md5, array_to_string(CASE WHEN fa THEN ['{g.ACCOUNT_SOURCE}'] WHEN src = 'sql' OR n_chunks = 0 THEN [] WHEN src = 'hybrid' THEN list_concat(['{g.ACCOUNT_SOURCE}'], cited) ELSE cited END, '|') AS sources,
        CAST(CASE WHEN src = 'sql' AND NOT idk THEN 1 WHEN {_S('answer')} = '' THEN 0 WHEN idk THEN 1 WHEN n_chunks = 0 THEN 0 ELSE 0.7 END AS DOUBLE) AS faithfulness,
        CAST(CASE WHEN src = 'sql' AND NOT idk THEN 1 WHEN {_S('answer')} = '' THEN 0 WHEN idk THEN 0 WHEN n_chunks = 0 THEN 0 ELSE 0.7 END AS DOUBLE) AS relevance FROM w""",
    "registration_guard": "SELECT c_custkey, c_custkey % 6 = 5 AS valid FROM customer",
    "tenant_by_email_domain": """WITH e AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'nowhere.org' ELSE lower(n_name) || '.com' END AS email_domain FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT c_custkey, email_domain, 't' || n_regionkey AS tenant_id FROM e LEFT JOIN nation ON email_domain = lower(n_name) || '.com'""",
    "token_revocation": "SELECT user_id, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY user_id",
}
