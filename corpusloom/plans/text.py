"""Queries over pages, sentences, chunks, classifiers and sparse vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.deploy import ship
from corpusloom.functions import sparse as sp
from corpusloom.functions import text as tx
from corpusloom.functions.tokens import bpe_pieces
from corpusloom.operators import chunking as ch
from corpusloom.operators.sparse import packed_vectors, sparse_search, sparse_vectors
from corpusloom.plans import views as v
from corpusloom.plans.views import with_views
from corpusloom.storage import new_folder

#: No stored document holds a term of the financial classifier; these words of the corpus take their place in queries.
CORPUS_TERMS = ["theand", "tionthe", "ingthe", "ouer", "heon", "enst", "auer", "lich"]
SECTIONS = 4


def pages_from_documents(spark, d):
    return v.pages(spark, d).select("file_name", "file_hash", "tenant_id", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def sentence_split(spark, d):
    rows = v.pages(spark, d).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("s").cast("binary")).alias("sentence_md5"))


def sentence_page_map(spark, d):
    rows = v.multipage(spark, d).where(F.col("text").isNotNull())
    rows = rows.select("file_name", "page", F.posexplode(tx.sentence_pieces(F.col("text"))).alias("pos", "s"))
    return rows.select("file_name", F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), F.md5(F.col("s").cast("binary")).alias("sentence_md5"), tx.count_words(F.col("s")).cast("long").alias("n_words"))


def token_window_split(spark, d):
    rows = v.pages(spark, d).select("doc_id", F.posexplode(tx.token_windows(F.col("text"), 100)).alias("pos", "w"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("w").cast("binary")).alias("window_md5"))


def _chunks(rows, key="file_name"):
    return rows.select(
        key,
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("total_chunks").cast("long").alias("total_chunks"),
        F.col("page").cast("long").alias("page"),
        F.col("n_words").cast("long").alias("n_words"),
        "strategy",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def chunk_fixed(spark, d):
    return _chunks(ch.chunk_fixed(ch.pieces_of_files(v.pages(spark, d))))


def chunk_fixed_multipage(spark, d):
    return _chunks(ch.chunk_fixed(ch.pieces_of_files(v.multipage(spark, d)), size=128, overlap=20))


def _by_tokens(spark, d):
    """Pieces of the documents' files, counted in tokens of a public vocabulary that lies beside the tables' engine."""
    import public_tokenizers

    return ch.pieces_of_files(v.pages(spark, d), measure=bpe_pieces(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))))


def chunk_fixed_tokens(spark, d):
    ship(spark)
    return _chunks(ch.chunk_fixed(_by_tokens(spark, d))).withColumnRenamed("n_words", "n_tokens")


def chunk_children_tokens(spark, d):
    ship(spark)
    return _chunks(ch.chunk_children(ch.parents_of(_by_tokens(spark, d)))).withColumnRenamed("n_words", "n_tokens")


def chunk_parents(spark, d):
    rows = ch.parents_of(ch.pieces_of_files(v.pages(spark, d)))
    return rows.select("file_name", F.col("parent_index").cast("long").alias("parent_index"), "parent_id", F.col("n_words").cast("long").alias("n_words"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def chunk_children(spark, d):
    rows = ch.chunk_children(ch.parents_of(ch.pieces_of_files(v.pages(spark, d))))
    return _chunks(rows)


def document_text(spark, d):
    return ch.file_texts(v.multipage(spark, d)).select("file_name", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def section_assign(spark, d):
    chunks = ch.chunk_fixed(ch.pieces_of_files(v.pages(spark, d)))
    rows = ch.assign_sections(chunks, F.lit(SECTIONS))
    return rows.groupBy("file_name", "section").agg(F.count("*").alias("n")).select("file_name", F.col("section").cast("long").alias("section"), "n")


def header_truncate(spark, d):
    rows = v.pages(spark, d)
    return rows.select(
        "doc_id",
        F.md5(tx.truncate_words(F.col("text"), 50).cast("binary")).alias("head_md5"),
        F.md5(tx.truncate_chars(F.col("text"), 2048).cast("binary")).alias("embed_md5"),
        F.md5(tx.truncate_chars(F.col("text"), 300, "... [truncated]").cast("binary")).alias("prompt_md5"),
    )


def keyword_classifier(spark, d):
    rows = v.pages(spark, d).select("doc_id", tx.keyword_signals(F.col("text"), CORPUS_TERMS).cast("long").alias("signals"))
    return rows.withColumn("financial", F.col("signals") >= 3)


def sparse_vector_rows(spark, d):
    rows = sparse_vectors(v.pages(spark, d), "doc_id")
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("weight", 6).alias("weight"))


def sparse_term_stats(spark, d):
    rows = v.pages(spark, d).select("doc_id", F.explode(sp.terms(F.col("text"))).alias("term"))
    per_term = rows.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df"))
    return per_term.select(F.lower("term").alias("term"), sp.term_index(F.col("term")).cast("long").alias("idx"), "tf", "df")


def stored_vectors(spark, rows):
    """Sparse vectors of (doc_id, tenant_id, text), one row an item, as a stored table: made once, counted and read from there."""
    path = f"{new_folder(spark, 'sparse-vectors')}/items"
    packed_vectors(rows, "doc_id", "tenant_id").write.parquet(path)
    return spark.read.parquet(path)


def sparse_topk(spark, d):
    q = sparse_vectors(v.questions(spark, d), "query_id", "tenant_id")
    # Dealt by document alone, so that its terms and then its scores need no other shuffle.
    p = sparse_vectors(v.pages(spark, d).repartition("doc_id"), "doc_id", "tenant_id")
    return sparse_search(q, p, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# SQL ---------------------------------------------------------------------------------------------------------------------

_DOTTED = [a for a in tx.ABBREVIATIONS if "." in a]
_STEMS = "|".join(a.replace(".", "\\x01") for a in tx.ABBREVIATIONS)


def sql_sentences(t: str) -> str:
    """Sentences of SQL expression ``t`` as a list: the same cuts without look-around."""
    x = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    for a in _DOTTED:
        first, last = a.split(".")
        x = f"regexp_replace({x}, '(?i)(^|\\s)({first})\\.({last})\\.', '\\1\\2' || chr(1) || '\\3.', 'g')"
    x = f"regexp_replace({x}, '(?i)(^|\\s)({_STEMS})\\.', '\\1\\2' || chr(1), 'g')"
    x = f"regexp_replace({x}, '([.!?])\\s+([A-Z\"''(])', '\\1' || chr(2) || '\\2', 'g')"
    cut = f"list_transform(string_split({x}, chr(2)), lambda s: regexp_replace(replace(s, chr(1), '.'), '^\\s+|\\s+$', '', 'g'))"
    return f"list_filter({cut}, lambda s: s <> '')"


def sql_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"


def sql_windows(t: str, limit: int) -> str:
    w = sql_words(t)
    return f"list_transform(range(0, len({w}), {limit}), lambda i: array_to_string(list_slice({w}, i + 1, i + {limit}), ' '))"


_PIECES = f"flatten(list_transform({sql_sentences('text')}, lambda s: CASE WHEN len({sql_words('s')}) > {tx.SENTENCE_TOKENS} THEN {sql_windows('s', tx.SENTENCE_TOKENS)} ELSE [s] END))"


def _sql_groups(source: str, size: int, overlap: int, keys: str = "file_name") -> str:
    """Chunk numbers, first and last pieces by recursion over prefix sums.  ``source`` has ``keys`` and ``pre``, the list of sums of
    the words of the first 0, 1, ... pieces."""
    end = f"greatest(f, len(list_filter(pre, lambda x: x <= {size} + pre[a])) - 1)"
    return f"""g AS (
      SELECT {keys}, pre, 0 AS c, CAST(1 AS BIGINT) AS a, CAST(1 AS BIGINT) AS f, CAST(greatest(1, len(list_filter(pre, lambda x: x <= {size})) - 1) AS BIGINT) AS e FROM {source} WHERE len(pre) > 1
      UNION ALL
      SELECT {keys}, pre, c + 1, a, f, CAST({end} AS BIGINT) FROM (
        SELECT {keys}, pre, c, CAST(greatest(a, len(list_filter(pre, lambda x: x < pre[e + 1] - {overlap})) + 1) AS BIGINT) AS a, e + 1 AS f FROM g WHERE e < len(pre) - 1))"""


def _sql_chunks(view: str, size: int, overlap: int) -> str:
    return f"""{with_views(view, recursive=True)},
    cut AS (SELECT file_name, page, text, {_PIECES} AS p FROM {view} WHERE text IS NOT NULL),
    flat AS (SELECT file_name, page, generate_subscripts(p, 1) AS pos, unnest(p) AS s FROM cut),
    files AS (SELECT file_name, list(s ORDER BY page, pos) AS s, list(page ORDER BY page, pos) AS pg, list(len({sql_words('s')}) ORDER BY page, pos) AS n FROM flat GROUP BY file_name),
    base AS (SELECT *, list_prepend(0, list_transform(range(1, len(n) + 1), lambda i: list_sum(list_slice(n, 1, i)))) AS pre FROM files),
    {_sql_groups('base', size, overlap)}
    SELECT file_name, CAST(c AS BIGINT) AS chunk_index, count(*) OVER (PARTITION BY file_name) AS total_chunks, CAST(pg[a] AS BIGINT) AS page,
      CAST(g.pre[e + 1] - g.pre[a] AS BIGINT) AS n_words, 'fixed' AS strategy, md5(array_to_string(list_slice(s, a, e), ' ')) AS text_md5
    FROM g JOIN base USING (file_name)"""


_PARENTS = f"""{with_views('v_pages', recursive=True)},
    base AS (SELECT file_name, file_hash, s, list_transform(s, lambda x: len({sql_words('x')})) AS n FROM (SELECT file_name, file_hash, {_PIECES} AS s FROM v_pages WHERE text IS NOT NULL)),
    pre1 AS (SELECT *, list_prepend(0, list_transform(range(1, len(n) + 1), lambda i: list_sum(list_slice(n, 1, i)))) AS pre FROM base),
    {_sql_groups('pre1', *ch.PARENT)},
    parents AS (SELECT file_name, c AS parent_index, sha256(file_hash || '|' || c) AS parent_id, list_slice(s, a, e) AS s, list_slice(n, a, e) AS n FROM g JOIN base USING (file_name))"""

_TERMS = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 AND NOT list_contains([{', '.join(repr(s) for s in sp.STOPWORDS)}], t))"
_INDEX = "CAST(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(range(0, octet_length(encode(term))), lambda i: CAST(('0x' || substr(hex(encode(term)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))), lambda h, b: (h * 33 + b) & 4294967295) % 65536 AS BIGINT)"


def sql_sparse(source: str, key: str, carry: str = "") -> str:
    c = f", {carry}" if carry else ""
    return f"""SELECT {key}{c}, idx, 1 + ln(CAST(sum(tf) AS DOUBLE)) AS weight FROM (
      SELECT {key}{c}, tf, {_INDEX} AS idx FROM (SELECT {key}{c}, term, count(*) AS tf FROM (SELECT {key}{c}, unnest({_TERMS}) AS term FROM {source}) GROUP BY ALL))
      GROUP BY {key}{c}, idx"""


QUERIES = {
    "pages_from_documents": pages_from_documents,
    "sentence_split": sentence_split,
    "sentence_page_map": sentence_page_map,
    "token_window_split": token_window_split,
    "chunk_fixed": chunk_fixed,
    "chunk_fixed_tokens": chunk_fixed_tokens,
    "chunk_children_tokens": chunk_children_tokens,
    "chunk_fixed_multipage": chunk_fixed_multipage,
    "chunk_parents": chunk_parents,
    "chunk_children": chunk_children,
    "document_text": document_text,
    "section_assign": section_assign,
    "header_truncate": header_truncate,
    "keyword_classifier": keyword_classifier,
    "sparse_vectors": sparse_vector_rows,
    "sparse_term_stats": sparse_term_stats,
    "sparse_topk": sparse_topk,
}

ORACLE_SQL = {
    "pages_from_documents": f"{with_views('v_pages')} SELECT file_name, file_hash, tenant_id, page, md5(text) AS text_md5 FROM v_pages",
    "sentence_split": f"""{with_views('v_pages')}, cut AS (SELECT doc_id, {sql_sentences('text')} AS p FROM v_pages)
      SELECT doc_id, pos - 1 AS pos, md5(s) AS sentence_md5 FROM (SELECT doc_id, CAST(generate_subscripts(p, 1) AS BIGINT) AS pos, unnest(p) AS s FROM cut)""",
    "sentence_page_map": f"""{with_views('v_multipage')}, cut AS (SELECT file_name, page, {_PIECES} AS p FROM v_multipage WHERE text IS NOT NULL)
      SELECT file_name, CAST(page AS BIGINT) AS page, pos - 1 AS pos, md5(s) AS sentence_md5, CAST(len({sql_words('s')}) AS BIGINT) AS n_words
      FROM (SELECT file_name, page, CAST(generate_subscripts(p, 1) AS BIGINT) AS pos, unnest(p) AS s FROM cut)""",
    "token_window_split": f"""{with_views('v_pages')}, cut AS (SELECT doc_id, {sql_words('text')} AS w FROM v_pages),
      win AS (SELECT doc_id, list_transform(range(0, len(w), 100), lambda i: array_to_string(list_slice(w, i + 1, i + 100), ' ')) AS p FROM cut)
      SELECT doc_id, pos - 1 AS pos, md5(s) AS window_md5 FROM (SELECT doc_id, CAST(generate_subscripts(p, 1) AS BIGINT) AS pos, unnest(p) AS s FROM win)""",
    "chunk_fixed": _sql_chunks("v_pages", *ch.FIXED),
    "chunk_fixed_multipage": _sql_chunks("v_multipage", 128, 20),
    "chunk_parents": f"""{_PARENTS} SELECT file_name, CAST(parent_index AS BIGINT) AS parent_index, parent_id, CAST(list_sum(n) AS BIGINT) AS n_words, md5(array_to_string(s, ' ')) AS text_md5 FROM parents""",
    "chunk_children": f"""{_PARENTS},
      pre2 AS (SELECT file_name, parent_index, list_prepend(0, list_transform(range(1, len(n) + 1), lambda i: list_sum(list_slice(n, 1, i)))) AS pre FROM parents),
      {_sql_groups('pre2', *ch.CHILD, keys='file_name, parent_index').replace('g AS', 'k AS', 1).replace('FROM g WHERE', 'FROM k WHERE')}
      SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY parent_index, c) - 1 AS chunk_index, count(*) OVER (PARTITION BY file_name) AS total_chunks, CAST(1 AS BIGINT) AS page,
        CAST(k.pre[e + 1] - k.pre[a] AS BIGINT) AS n_words, 'hierarchical_child' AS strategy, md5(array_to_string(list_slice(s, a, e), ' ')) AS text_md5
      FROM k JOIN parents USING (file_name, parent_index)""",
    "document_text": f"""{with_views('v_multipage')}, j AS (SELECT file_name, string_agg(text, chr(10) ORDER BY page) AS t FROM v_multipage WHERE trim(coalesce(text, '')) <> '' GROUP BY file_name)
      SELECT file_name, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM j""",
    "section_assign": f"""SELECT file_name, section, count(*) AS n FROM (
      SELECT file_name, CAST(least(floor(CAST(chunk_index AS DOUBLE) / greatest(total_chunks, 1) * {SECTIONS}), {SECTIONS - 1}) AS BIGINT) AS section FROM ({_sql_chunks('v_pages', *ch.FIXED)})) GROUP BY ALL""",
    "header_truncate": f"""SELECT doc_id, md5(CASE WHEN len({sql_words('text')}) <= 50 THEN text ELSE array_to_string(list_slice({sql_words('text')}, 1, 50), ' ') END) AS head_md5,
      md5(CASE WHEN length(text) > 2048 THEN left(text, 2048) ELSE text END) AS embed_md5,
      md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '... [truncated]' ELSE text END) AS prompt_md5 FROM documents""",
    "keyword_classifier": f"""WITH s AS (SELECT doc_id, CAST(len(list_filter({CORPUS_TERMS!r}, lambda k: contains(lower(text), k)))
      + CASE WHEN len(regexp_extract_all(text, '[$€£¥]\\s*[\\d,.]+\\s*[BMKbmk]?')) >= 3 THEN 1 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '\\d+\\.?\\d*\\s*%')) >= 3 THEN 1 ELSE 0 END AS BIGINT) AS signals FROM documents)
      SELECT doc_id, signals, signals >= 3 AS financial FROM s""",
    "sparse_vectors": f"SELECT doc_id, idx, round(weight, 6) AS weight FROM ({sql_sparse('documents', 'doc_id')})",
    "sparse_term_stats": f"""SELECT term, {_INDEX} AS idx, tf, df FROM (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term)""",
    "sparse_topk": f"""{with_views('v_questions', 'v_pages')}, q AS ({sql_sparse('v_questions', 'query_id', 'tenant_id')}), p AS ({sql_sparse('v_pages', 'doc_id', 'tenant_id')}),
      s AS (SELECT query_id, doc_id, round(sum(q.weight * p.weight), 6) AS score FROM q JOIN p USING (tenant_id, idx) GROUP BY ALL)
      SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
}
