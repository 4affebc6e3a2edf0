"""Small fixed vectors for expressions and operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import adapters, markup, sparse, text
from corpusloom.operators import accounts, chunking, feedback, retrieval, routing, store


def one(spark, column, **values):
    """Value of an expression over one row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value,want",
    [
        ("Dr. Smith reviewed revenue. It rose.", ["Dr. Smith reviewed revenue.", "It rose."]),
        ("In the U.S. Markets fell! (Really.) ok", ["In the U.S. Markets fell!", "(Really.) ok"]),
        ("We like e.g. Apples? \"Yes.\" No", ["We like e.g. Apples?", "\"Yes.\" No"]),
        ("  ", []),
        ("", []),
        ("no end", ["no end"]),
        ("Acme Corp. Ltd. Inc. Grew. Fast", ["Acme Corp. Ltd. Inc. Grew.", "Fast"]),
    ],
)
def test_sentences(spark, value, want):
    assert one(spark, text.sentences(F.col("t")), t=value) == want


def test_token_windows_and_truncation(spark):
    assert one(spark, text.token_windows(F.col("t"), 2), t="a b  c d\ne") == ["a b", "c d", "e"]
    assert one(spark, text.token_windows(F.col("t"), 2), t=" ") == []
    assert one(spark, text.truncate_words(F.col("t"), 100), t="word " * 10_000).split() == ["word"] * 100
    assert one(spark, text.truncate_chars(F.col("t"), 3, "..."), t="abcd") == "abc..."


def test_keyword_signals(spark):
    t = "Revenue and EBITDA rose; $1.2B, € 5, £3k; 4% 5.5 % 6%"
    assert one(spark, text.keyword_signals(F.col("t")), t=t) == 4
    assert one(spark, text.is_financial(F.col("t")), t="revenue, equity and $5") is False
    assert one(spark, text.is_financial(F.col("t")), t="REVENUE equity dividend") is True


def groups(spark, n, size, overlap):
    rows = spark.createDataFrame([(n,)], "n array<int>")
    return [(g.a, g.e) for g in rows.select(chunking.groups(F.col("n"), size, overlap).alias("g")).first()["g"]]


def fold(n, size, overlap):
    """The same by hand."""
    out, current, total = [], [], 0
    for i, k in enumerate(n, 1):
        if current and total + k > size:
            out.append((current[0], current[-1]))
            kept, w = [], 0
            for j in reversed(current):
                if w + n[j - 1] > overlap:
                    break
                kept.insert(0, j)
                w += n[j - 1]
            current, total = kept, w
        current.append(i)
        total += k
    return out + ([(current[0], current[-1])] if current else [])


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (10, 10), (1, 0), (7, 2)])
def test_groups(spark, size, overlap):
    for n in ([], [5], [20], [5, 5, 5], [1, 2, 3, 4, 5, 6, 7], [12, 1, 1, 12, 3, 3, 3, 3], [3] * 12):
        assert groups(spark, n, size, overlap) == fold(n, size, overlap), (n, size, overlap)


def test_chunk_documents_routes_by_content(spark):
    pages = spark.createDataFrame(
        [("a.txt", "h1", 1, "Revenue rose. Equity too. Dividend fell."), ("a.txt", "h1", 2, "More."), ("b.txt", "h2", 1, "Plain words. Nothing else."), ("c.txt", "h3", 1, None)],
        "file_name string, file_hash string, page int, text string",
    )
    rows = chunking.chunk_documents(pages).collect()
    kinds = {r["file_name"]: r["strategy"] for r in rows}
    assert kinds == {"a.txt": "hierarchical_child", "b.txt": "fixed"}
    assert all((r["parent_id"] is None) == (r["strategy"] == "fixed") for r in rows)


def test_sparse_terms(spark):
    assert one(spark, sparse.terms(F.col("t")), t="The and OR") == []
    assert one(spark, sparse.terms(F.col("t")), t="Net-Income, été a 10K!") == ["net", "income", "été", "10k"]

    def djb2(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + b) & 0xFFFFFFFF
        return h % 65536

    for w in ("revenue", "été", "a" * 50, "日本"):
        assert one(spark, sparse.term_index(F.col("t")), t=w) == djb2(w)
    assert math.isclose(one(spark, sparse.term_weight(F.col("n")), n=3), 1 + math.log(3))


def test_cosine(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<double>")
    assert one(spark, retrieval.cosine(arr(1.0, 2.0), arr(2.0, 4.0))) == pytest.approx(1.0)
    assert one(spark, retrieval.cosine(arr(1.0, 0.0), arr(0.0, 1.0))) == 0.0
    assert one(spark, retrieval.cosine(arr(), arr())) == 0.0
    assert one(spark, retrieval.cosine(arr(0.0), arr(1.0))) == 0.0


def test_mmr_prefers_what_is_new(spark):
    c = spark.createDataFrame([(1, 1, 0.9, 1, [1.0, 0.0, 0.0]), (1, 2, 0.8, 2, [0.98, 0.02, 0.0]), (1, 3, 0.7, 3, [0.0, 1.0, 0.0])], "query_id int, doc_id int, score double, rank int, embedding array<float>")
    assert [r["doc_id"] for r in retrieval.mmr(c, 2).orderBy("pos").collect()] == [1, 3]
    assert retrieval.mmr(c, 10).count() == 3


def test_fusion_ignores_the_order_of_lists(spark):
    rows = [(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1), (1, "b", 12, 2)]
    got = [retrieval.fuse(spark.createDataFrame(r, "query_id int, list_id string, doc_id int, rank int")).orderBy("rank").collect() for r in (rows, rows[::-1])]
    assert got[0] == got[1] and [r["doc_id"] for r in got[0]] == [11, 10, 12]


@pytest.mark.parametrize("n,want", [(1, [0]), (2, [0, 1]), (4, [0, 3, 1, 2]), (6, [0, 5, 1, 2, 3, 4])])
def test_reorder(spark, n, want):
    rows = spark.range(n).select(retrieval.reorder(F.col("id"), F.lit(n)).alias("p")).collect()
    assert [r["p"] for r in rows] == want


def test_parent_text_or_own(spark):
    hits = spark.createDataFrame([("p1", "child", 0.123456, None, None), (None, "alone", 1.0, "s", 3)], "parent_id string, text string, score double, source string, page int")
    parents = spark.createDataFrame([("p1", "whole")], "parent_id string, text string")
    got = {(r["text"], r["score"], r["source"], r["page"]) for r in retrieval.expand_parents(hits, parents).collect()}
    assert got == {("whole", 0.1235, "unknown", 0), ("alone", 1.0, "s", 3)}


def test_empty_tenant_finds_nothing(spark):
    q = spark.createDataFrame([(1, "", [1.0]), (2, None, [1.0]), (3, "t", [1.0])], "query_id int, tenant_id string, embedding array<float>")
    p = spark.createDataFrame([(7, "", [1.0]), (8, "t", [1.0]), (9, None, [1.0])], "doc_id int, tenant_id string, embedding array<float>")
    assert [(r["query_id"], r["doc_id"]) for r in retrieval.dense_search(q, p).collect()] == [(3, 8)]


def test_safe_intent(spark):
    raw = spark.createDataFrame([("balance", "9999", "-10", "Starbucks"), ("nope", "x", None, ""), ("recent", "0", "400", "a%_b")], "intent string, limit string, days string, merchant string")
    got = [tuple(r) for r in accounts.safe_intent(raw).collect()]
    assert got == [("balance", 50, 1, "%Starbucks%"), ("recent", 10, 30, None), ("recent", 10, 365, "%a b%")]


def test_money(spark):
    assert one(spark, accounts.money(F.col("x")), x=5842.51) == "$5,842.51"


def test_evaluator(spark):
    q = lambda a, n=3: one(spark, routing.quick_scores(F.col("a"), F.col("n")), a=a, n=n)
    assert tuple(q("")) == (0.0, 0.0) and tuple(q(routing.CANNOT_ANSWER.upper())) == (1.0, 0.0)
    assert tuple(q("Something", 0)) == (0.0, 0.0) and q("Something") is None
    for value, want in (("1.5", 1.0), ("-0.1", 0.0), (None, 0.7), ("bad", 0.7), ("0.3", 0.3)):
        assert one(spark, routing.safe_score(F.col("s").cast("string")), s=value) == want
    step = lambda f, r, n: one(spark, routing.step_after_evaluate(F.lit(f), F.lit(r), F.lit(n)))
    assert (step(0.9, 0.9, 0), step(0.5, 0.9, 0), step(0.5, 0.9, 1)) == ("end", "retry", "end")


def test_questions(spark):
    for q, kind in [
        ("What is my current balance?", "sql"), ("Show me my last 5 transactions", "sql"), ("Do I have any flagged or suspicious transactions?", "sql"),
        ("What was Apple's iPhone revenue in Q3 2024?", "general"), ("How did Goldman Sachs manage risk in 2025?", "general"), ("Why was I charged a foreign transaction fee on June 26?", "hybrid"),
    ]:
        assert one(spark, routing.route(F.col("q")), q=q) == kind
    limit = accounts.fallback_intent(F.col("q"))["limit"]
    assert one(spark, limit, q="Show me my last 5 transactions") == 5 and one(spark, limit, q="recent 75") == 50


def test_citations(spark):
    a = "x [Source: a.pdf, page 1, Chunk #2] y [Source: b.pdf, page 3] z [Source: a.pdf, page 1, Chunk #2]"
    s = routing.extract_sources(F.col("a"))
    assert one(spark, s, a=a) == ["a.pdf, page 1, Chunk #2", "b.pdf, page 3"]
    assert one(spark, routing.cited_files(s), a=a) == ["a.pdf", "b.pdf"]


@pytest.mark.parametrize("k,helpful,want", [(20, 4, 25), (20, 9, 18), (10, 9, 10), (50, 4, 50), (20, 6, 20)])
def test_tuning(spark, k, helpful, want):
    rates = spark.createDataFrame([("t", helpful, 10)], "tenant_id string, helpful_count int, total int")
    params = spark.createDataFrame([("t", k)], "tenant_id string, top_k int")
    r = feedback.tune(rates, params).first()
    assert r["top_k"] == want and r["rerank_top_n"] == min(max(round(want * 0.4), 4), 20) and r["mmr_final_k"] == min(max(round(want * 0.3), 3), 10)


def test_tuning_in_runs_is_tuning_step_by_step(spark, monkeypatch):
    rows = [(i, "t", (i * 7919) % 97 < i % 97, i) for i in range(1, 1200)]
    votes = spark.createDataFrame(rows, "fid int, tenant_id string, helpful boolean, created_at int")
    k = 20
    for n in range(10, 1200, 10):
        last = [h for _, _, h, _ in rows[max(0, n - 50) : n]]
        rate = sum(last) / len(last)
        k = min(k + 5, 50) if rate < 0.5 else max(k - 2, 10) if rate > 0.8 else k
    for run in (1, 3, 1000):
        monkeypatch.setattr(feedback, "RUN", run)
        assert feedback.tune_all(votes).first()["top_k"] == k


def test_points_and_batches(spark):
    chunks = spark.createDataFrame([("t", "f", "h", 1, i, "tt", [1.0] if i else None, {100: 1.0, 200: 1.5} if i else None) for i in range(500)], "text string, file_name string, file_hash string, page int, chunk_index int, tenant_id string, dense array<float>, sparse map<int,double>")
    p = store.points(chunks, "over").where("payload.chunk_index = 0").first()
    assert p["dense"] == [] and p["indices"] == [] and p["payload"]["tenant_id"] == "over"
    assert sorted(r["n"] for r in store.batches(chunks, "file_hash", "chunk_index").groupBy("batch").agg(F.count("*").alias("n")).collect()) == [244, 256]


def test_ingesting_twice_is_ingesting_once(spark):
    row = lambda h, s, n: (h, s, n)
    old = spark.createDataFrame([row("a", "processing", 1), row("b", "complete", 1)], "file_hash string, status string, seq int")
    new = spark.createDataFrame([row("a", "complete", 2)], "file_hash string, status string, seq int")
    once = store.upsert(old, new, "file_hash", "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upsert(once, new, "file_hash", "seq").collect())) == [("a", "complete", 2), ("b", "complete", 1)]
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_hash string")
    assert [r["file_hash"] for r in store.hash_gate(files, once).collect()] == ["c"]


def test_enriched(spark):
    assert one(spark, adapters.enriched(F.lit("chunk"), F.col("c")), c="tiny") == "chunk"
    assert one(spark, adapters.enriched(F.lit("chunk"), F.col("c")), c=" A long enough context. ") == "A long enough context.\n\nchunk"


def test_models_are_columns(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id int, text string")
    sizes = adapters.apply_model(rows, lambda x: [float(len(x))] * len(x), "text", "batch", "double", batch=90)
    assert max(r["batch"] for r in sizes.collect()) <= 90
    vectors = adapters.apply_model(rows, lambda x: [[float(len(t))] for t in x], "text", "v", "array<float>")
    assert all(r["v"] == [float(len(r["text"]))] for r in vectors.collect())
    with pytest.raises(Exception, match="outputs for"):
        adapters.apply_model(rows, lambda x: x[:1] if len(x) > 1 else [], "text", "v", "string").collect()


def test_markdown(spark):
    lines = F.array(markup.markdown_line([F.lit("1"), F.lit("2")]))
    assert one(spark, markup.markdown_table(["a", "b"], lines)) == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, markup.markdown_table(["a"], F.array().cast("array<string>"))) == ""


def test_similar_chunks(spark):
    """Files are chosen before ranking; a missing parent is null; an empty tenant finds nothing."""
    from corpusloom.operators.retrieval import similar_chunks

    points = spark.createDataFrame([(1, "a", "f1", "p1", [1.0, 0.0]), (2, "a", "f2", "p2", [0.9, 0.1]), (3, "a", "f2", None, [0.0, 1.0]), (4, "b", "f2", "p1", [1.0, 0.0]), (5, "", "f1", "p1", [1.0, 0.0])], "point_id long, tenant_id string, file_name string, parent_id string, embedding array<double>")
    texts = points.selectExpr("point_id", "concat('t', point_id) AS text")
    parents = spark.createDataFrame([("p1", "parent one")], "parent_id string, text string")
    asks = spark.createDataFrame([(10, "a", [1.0, 0.0]), (11, "a", [1.0, 0.0]), (12, "", [1.0, 0.0]), (13, "a", [1.0, 0.0])], "query_id long, tenant_id string, embedding array<double>")
    files = spark.createDataFrame([(11, "f2"), (11, "f2"), (13, "none")], "query_id long, file_name string")
    got = sorted((r["query_id"], r["rank"], r["point_id"], r["text"], r["parent_text"]) for r in similar_chunks(asks, points, texts, parents, files, 2).collect())
    assert got == [(10, 1, 1, "t1", "parent one"), (10, 2, 2, "t2", None), (11, 1, 2, "t2", None), (11, 2, 3, "t3", None)]
    assert {r["query_id"] for r in similar_chunks(asks, points, texts, parents, k=1).collect()} == {10, 11, 13}


def test_similar_chunks_within_sets(spark):
    """Sets of files give what their pairs of query and file give, without a row a pair."""
    from corpusloom.operators.retrieval import similar_chunks

    vector = F.array(*(F.sin(F.col("id") * k + 1) for k in range(1, 5)))
    points = spark.range(200).select(F.col("id").alias("point_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("").alias("tenant_id"), F.concat(F.lit("f"), F.col("id")).alias("file_name"), F.concat(F.lit("p"), F.col("id") % 9).alias("parent_id"), vector.alias("embedding"), (F.col("id") % 7).alias("set"))
    texts, parents = points.selectExpr("point_id", "concat('t', point_id) AS text"), points.selectExpr("parent_id", "concat('of ', parent_id) AS text").distinct()
    asks = points.where("point_id % 5 = 0").select((F.col("point_id") + 1000).alias("query_id"), "tenant_id", "embedding", F.when(F.col("point_id") % 2 == 0, F.col("point_id") % 8).alias("set"))
    files = asks.where("set IS NOT NULL").select("query_id", "set").join(points.select("set", "file_name"), "set")
    # A query whose set has no file finds nothing, as pairs say it only by a file that no point has.
    files = files.drop("set").unionByName(asks.where("set = 7").select("query_id", F.lit("none").alias("file_name")))
    got = similar_chunks(asks, points, texts, parents, k=3, within="set")
    want = similar_chunks(asks.drop("set"), points.drop("set"), texts, parents, files, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30


def test_length_of_a_vector_is_taken_once(spark):
    """Elements are divided by a variable, not by an expression that adds up the whole vector for each of them."""
    rows = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0), F.col("id").cast("double")).alias("e")).select(retrieval.unit(F.col("e")).alias("v"))
    assert rows.first()["v"] == [0.6, 0.8, 0.0]
    assert " / lambda " in rows._jdf.queryExecution().analyzed().toString()
