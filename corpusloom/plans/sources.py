"""Queries over parsers, markup, layout and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import adapters, markup
from corpusloom.operators import layout
from corpusloom.plans import text as tp
from corpusloom.plans import views as v
from corpusloom.sources import parsers, pdf
from corpusloom.storage import new_folder
from corpusloom.streaming import failures

WIDTH = 600


def html_text(spark, d):
    """Every page through the parser, as a file with a name."""
    p = v.table(spark, d, "pages")
    files = p.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"), "page_id")
    rows = parsers.parse_files(files, keep=("page_id",))
    return rows.select("page_id", "page", "error", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars"))


def html_text_patterns(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.md5(markup.html_text(F.col("html")).cast("binary")).alias("text_md5"))


def html_tables_markdown(spark, d):
    """Nations of each region as a markdown table."""
    n, r = v.table(spark, d, "nation"), v.table(spark, d, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    line = markup.markdown_line([F.col("n_nationkey").cast("string"), F.col("n_name")])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x.l)
    return rows.groupBy("r_name").agg(lines.alias("lines")).select("r_name", markup.markdown_table(["key", "name"], F.col("lines")).alias("markdown"))


def csv_pages(spark, d):
    """Each nation's customers as a semicolon file, parsed to a markdown page."""
    c = v.table(spark, d, "customer")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x.l), "\n")
    files = c.groupBy("c_nationkey").agg(F.concat(F.lit("key;name;segment\n"), body).cast("binary").alias("content"))
    rows = parsers.parse_files(files.select(F.lit("x.csv").alias("path"), "content", "c_nationkey"), keep=("c_nationkey",))
    return rows.select("c_nationkey", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def email_pages(spark, d):
    """Each conversation turn as a message with a text body and an attachment."""
    c = v.table(spark, d, "conversations")
    raw = F.concat(
        F.lit("From: a@b.com\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nSubject: s"), F.col("conv_id").cast("string"),
        F.lit('\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="XX"\n\n--XX\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n'),
        F.base64(F.coalesce("text", F.lit("")).cast("binary")),
        F.lit('\n--XX\nContent-Type: text/csv\nContent-Disposition: attachment; filename="t.csv"\n\na,b\n1,2\n--XX--\n'),
    )
    files = c.select(F.lit("m.eml").alias("path"), raw.cast("binary").alias("content"), "conv_id", "turn")
    rows = parsers.parse_files(files, keep=("conv_id", "turn"))
    body = F.when(F.col("source_attachment").isNull(), F.regexp_replace(F.col("text"), "\r\n", "\n")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "source_attachment", F.md5(body.cast("binary")).alias("text_md5"))


def pdf_columns(spark, d):
    """Forty customers to a PDF page, names in the left column and segments in the right, read back column by column."""
    c = v.table(spark, d, "customer").withColumn("n", F.col("c_custkey") % 40)
    show = lambda x, c: F.concat(F.lit(f"BT /F1 8 Tf {x} "), (F.lit(900) - F.col("n") * 20).cast("string"), F.lit(" Td ("), F.col(c), F.lit(") Tj ET\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(show(50, "c_name"), show(350, "c_mktsegment")).alias("l")))), lambda x: x.l), "")
    drawn = c.groupBy(F.floor(F.col("c_custkey") / 40).alias("file_no")).agg(lines.alias("l"))
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /MediaBox [0 0 600 920] >> endobj\n3 0 obj << /Type /Page /Contents 5 0 R >> endobj\n5 0 obj << /Length "
    body = F.concat(F.lit(head), F.octet_length("l").cast("string"), F.lit(" >>\nstream\n"), "l", F.lit("\nendstream endobj\n"))
    files = drawn.select(F.concat(F.col("file_no").cast("string"), F.lit(".pdf")).alias("path"), body.cast("binary").alias("content"), "file_no")
    return pdf.pdf_pages(files, keep=("file_no",), folder=new_folder(spark, "pdf-elements")).select("file_no", F.col("page").cast("long").alias("page"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


def parser_failures(spark, d):
    """Files of a kind nobody parses, and empty ones, each with its error."""
    p = v.table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, ".xyz").when(F.col("page_id") % 3 == 1, ".txt").otherwise(".html")
    content = F.when(F.col("page_id") % 6 == 1, F.lit("")).otherwise(F.lit("<p>x</p>"))
    files = p.select(F.concat(F.col("page_id").cast("string"), kind).alias("path"), content.cast("binary").alias("content"), "page_id")
    rows = parsers.parse_files(files, keep=("page_id",))
    state = F.when(F.col("error").isNull(), "ok").when(F.col("error") == "no pages", "no pages").otherwise("unsupported")
    return rows.select("page_id", state.alias("state"))


def ingest_attempts(spark, d):
    """Every page as a file.  Some are of a kind nobody parses; some stores time out up to four times before they answer."""
    p = v.table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 7 == 0, ".xyz").otherwise(".txt")
    files = p.select(F.col("page_id").cast("string").alias("file_hash"), F.concat(F.col("page_id").cast("string"), kind).alias("path"), F.concat(F.lit("page "), "html").cast("binary").alias("content"), F.lit(0).cast("long").alias("arrived_at"))

    def parse(rows):
        out = (F.col("file_hash").cast("long") % 5 >= F.col("attempt")) & ~F.endswith("path", F.lit(".xyz"))
        none = F.lit(None).cast("string")
        slow = rows.where(out).select("file_hash", F.lit(None).cast("int").alias("page"), none.alias("text"), F.lit("TimeoutError: the store does not answer").alias("error"))
        return slow.unionByName(parsers.parse_files(rows.where(~out), keep=("file_hash",)).select("file_hash", "page", "text", "error"))

    step = failures.Ingestion(spark, new_folder(spark, "ingestion"), parse, "page int, text string")
    for batch in range(failures.RETRIES + 1):
        step.step(files if batch == 0 else files.where("false"), batch, 1000 * batch)
    pages = step.results.read().groupBy("file_hash").agg(F.count("page").alias("n_pages"))
    rows = step.states().join(pages, "file_hash", "left")
    return rows.select(F.col("file_hash").cast("long").alias("page_id"), "state", "kind", F.col("attempt").cast("long").alias("attempts"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def media_types(spark, d):
    e = F.element_at(F.array(*map(F.lit, ["jpg", "JPEG", "PNG", "gif"])), (F.col("page_id") % 4 + 1).cast("int"))
    return v.table(spark, d, "pages").select("page_id", markup.media_type(e).alias("media_type"))


def _elements(spark, d):
    """Line items as blocks of two-column pages; some lie across the page.  Of rows with equal keys that which is stored first stands."""
    stored = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    li = v.table(spark, d, "lineitem").withColumn("stored", stored)
    x0 = ((F.col("l_partkey") % 2) * 300 + F.col("l_suppkey") % 20).cast("double")
    wide = F.when(F.col("l_suppkey") % 7 == 0, 450).otherwise(200)
    rows = li.select(
        F.col("l_orderkey").alias("page_id"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"),
        F.when(F.col("l_linenumber") % 5 == 0, "table").otherwise("text").alias("etype"),
        F.col("l_quantity").alias("y"),
        x0.alias("x0"),
        (x0 + wide).alias("x1"),
        "stored",
    )
    first = rows.groupBy("page_id", "seq").agg(F.min_by(F.struct("etype", "y", "x0", "x1"), "stored").alias("e"))
    return first.select("page_id", "seq", "e.*")


def reading_order(spark, d):
    return layout.reading_order(_elements(spark, d), F.lit(WIDTH)).select("page_id", "seq", F.col("place").cast("long").alias("place"))


def bbox_exclusion(spark, d):
    e = _elements(spark, d).select("page_id", "seq", "etype", "x0", F.col("y").alias("y0"), "x1", (F.col("y") + 5).alias("y1"))
    kept = layout.outside_tables(e.where("etype = 'text'"), e.where("etype = 'table'"))
    return kept.select("page_id", "seq")


def enrich_chunks(spark, d):
    p = v.pages(spark, d)
    context = F.when(F.col("doc_id") % 3 == 0, F.lit("short")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" From file "), F.col("file_name"), F.lit(". ")))
    return p.select("doc_id", F.md5(adapters.enriched(F.col("text"), context).cast("binary")).alias("text_md5"))


# SQL ---------------------------------------------------------------------------------------------------------------------


def _sql_html(x: str) -> str:
    for tag in markup.SKIPPED:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{markup.BLOCKS})\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, plain in markup.ENTITIES:
        x = f"replace({x}, {v._quoted(entity)}, {v._quoted(plain)})"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10))"


_ELEMENTS = """e AS (SELECT DISTINCT ON (l_orderkey, l_linenumber * 1000000 + l_partkey) l_orderkey AS page_id, l_linenumber * 1000000 + l_partkey AS seq, CASE WHEN l_linenumber % 5 = 0 THEN 'table' ELSE 'text' END AS etype,
    l_quantity AS y, CAST((l_partkey % 2) * 300 + l_suppkey % 20 AS DOUBLE) AS x0, CAST((l_partkey % 2) * 300 + l_suppkey % 20 + CASE WHEN l_suppkey % 7 = 0 THEN 450 ELSE 200 END AS DOUBLE) AS x1 FROM lineitem)"""

QUERIES = {
    "html_text": html_text,
    "html_text_patterns": html_text_patterns,
    "html_tables_markdown": html_tables_markdown,
    "csv_pages": csv_pages,
    "email_pages": email_pages,
    "pdf_columns": pdf_columns,
    "parser_failures": parser_failures,
    "ingest_attempts": ingest_attempts,
    "media_types": media_types,
    "reading_order": reading_order,
    "bbox_exclusion": bbox_exclusion,
    "enrich_chunks": enrich_chunks,
}

ORACLE_SQL = {
    "html_text_patterns": f"SELECT page_id, md5({_sql_html('html')}) AS text_md5 FROM pages",
    "html_tables_markdown": "SELECT r_name, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "csv_pages": "SELECT c_nationkey, md5('| key | name | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey)) AS text_md5 FROM customer GROUP BY c_nationkey",
    "email_pages": """SELECT conv_id, turn, NULL AS source_attachment, md5('From: a@b.com' || chr(10) || 'Date: Mon, 01 Jan 2024 00:00:00 +0000' || chr(10) || 'Subject: s' || conv_id || chr(10) || chr(10) || coalesce(text, '')) AS text_md5 FROM conversations
      UNION ALL SELECT conv_id, turn, 't.csv', md5('| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |') FROM conversations""",
    "pdf_columns": """SELECT c_custkey // 40 AS file_no, 1::BIGINT AS page, md5(string_agg(c_name, chr(10) || chr(10) ORDER BY c_custkey) || chr(10) || chr(10) || string_agg(c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey)) AS text_md5, NULL AS error
      FROM customer GROUP BY ALL""",
    "parser_failures": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'unsupported' WHEN page_id % 6 = 1 THEN 'no pages' ELSE 'ok' END AS state FROM pages",
    "ingest_attempts": """SELECT page_id, CASE WHEN page_id % 7 = 0 OR page_id % 5 = 4 THEN 'dead' ELSE 'done' END AS state, CASE WHEN page_id % 7 = 0 THEN 'permanent' WHEN page_id % 5 = 4 THEN 'transient' ELSE 'done' END AS kind,
      CASE WHEN page_id % 7 = 0 THEN 1 ELSE least(page_id % 5 + 1, 4) END AS attempts, CASE WHEN page_id % 7 = 0 OR page_id % 5 = 4 THEN 0 ELSE 1 END AS n_pages FROM (SELECT DISTINCT page_id FROM pages)""",
    "media_types": "SELECT page_id, (['image/jpeg', 'image/jpeg', 'image/png', 'image/gif'])[CAST(page_id % 4 + 1 AS INTEGER)] AS media_type FROM pages",
    "reading_order": f"""WITH {_ELEMENTS}, c AS (SELECT page_id, (x0 + x1) / 2 AS c, row_number() OVER (PARTITION BY page_id ORDER BY (x0 + x1) / 2) AS k FROM e WHERE etype = 'text'),
      g AS (SELECT a.page_id, b.c - a.c AS gap, (a.c + b.c) / 2 AS mid FROM c a JOIN c b ON a.page_id = b.page_id AND b.k = a.k + 1),
      t AS (SELECT page_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN greatest({WIDTH} * 0.03::DOUBLE, 2.5::DOUBLE * list_sort(list(gap))[count(*) // 2 + 1]) ELSE {WIDTH} * 0.08::DOUBLE END AS least FROM g GROUP BY page_id),
      b AS (SELECT g.page_id, mid FROM g JOIN t USING (page_id) WHERE gap > least),
      p AS (SELECT page_id, 1 + (SELECT count(*) FROM b WHERE b.page_id = q.page_id) AS cols, (SELECT count(*) FROM c WHERE c.page_id = q.page_id) AS texts FROM (SELECT DISTINCT page_id FROM e) q),
      k AS (SELECT e.*, cols = 1 OR texts < cols * 2 AS plain, x1 - x0 >= {WIDTH} * 0.6::DOUBLE AS f, (x0 + x1) / 2 AS c, cols FROM e JOIN p USING (page_id)),
      z AS (SELECT page_id, seq, y, CASE WHEN plain THEN 0 ELSE 1 END AS z,
        CASE WHEN f THEN (SELECT count(*) FROM k o WHERE o.page_id = k.page_id AND o.f AND (o.y < k.y OR o.y = k.y AND o.seq < k.seq)) ELSE (SELECT count(*) FROM k o WHERE o.page_id = k.page_id AND o.f AND o.y <= k.y) END AS band,
        CAST(f AS INTEGER) AS f, CASE WHEN f THEN 0 WHEN c < 0 OR c >= {WIDTH} THEN cols - 1 ELSE (SELECT count(*) FROM b WHERE b.page_id = k.page_id AND b.mid <= k.c) END AS col FROM k)
      SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY z * band, z * f, z * col, y, seq) - 1 AS place FROM z""",
    "bbox_exclusion": f"WITH {_ELEMENTS} SELECT page_id, seq FROM e t WHERE etype = 'text' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.page_id = t.page_id AND b.etype = 'table' AND t.x1 > b.x0 AND t.x0 < b.x1 AND t.y + 5 > b.y AND t.y < b.y + 5)",
    "enrich_chunks": f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'From file doc_' || doc_id || '.txt.' || chr(10) || chr(10) || text ELSE text END AS t FROM documents)
      SELECT doc_id, md5(CASE WHEN len({tp.sql_words('t')}) <= 512 THEN t ELSE array_to_string(list_slice({tp.sql_words('t')}, 1, 512), ' ') END) AS text_md5 FROM x""",
}
