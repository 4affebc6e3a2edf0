"""Greedy sentence-aware chunking: fixed windows, and parents with children."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import count_words, is_financial, sentence_pieces

FIXED, PARENT, CHILD = (512, 50), (1024, 0), (256, 30)


def word_pieces(text: Column) -> Column:
    """array<struct<s, n>>: sentences with their words, long ones in windows."""
    return F.transform(sentence_pieces(text), lambda s: F.struct(s.alias("s"), count_words(s).alias("n")))


def pieces_of_files(pages: DataFrame, key: str = "file_name", measure: Callable[[Column], Column] = word_pieces) -> DataFrame:
    """One row a file: ``key``, file_hash and pieces array<struct<s, page, n>> in page and sentence order.

    ``pages`` has ``key``, file_hash, page and text; null texts are skipped.  ``measure``: what cuts a text and counts its pieces, in words
    or, with ``functions.tokens.bpe_pieces``, in tokens; all budgets of chunks are then in its unit, and so is their column n_words."""
    dealt = pages.where(F.col("text").isNotNull()).select(key, "file_hash", "page", "text").repartition(key)  # whole texts, so that cutting runs in parallel
    # A measure that runs in Python must be called once for each text, beside the functions over its result.
    measured = dealt.select(key, "file_hash", "page", measure(F.col("text")).alias("cut"))
    cut = F.transform("cut", lambda s: F.struct(s.s.alias("s"), F.col("page").cast("int").alias("page"), s.n.alias("n")))
    rows = measured.select(key, "file_hash", F.struct(F.col("page").cast("int").alias("page"), cut.alias("cut")).alias("p"))
    files = rows.groupBy(key).agg(F.min("file_hash").alias("file_hash"), F.array_sort(F.collect_list("p")).alias("ps"))
    return files.select(key, "file_hash", F.flatten(F.transform("ps", lambda p: p.cut)).alias("pieces")).where(F.size("pieces") > 0)


def groups(n: Column, size: int, overlap: int) -> Column:
    """Chunks of pieces with ``n`` words each: array<struct<a, e>> of first and last piece, 1-based.

    A chunk is closed when the next piece would make it larger than ``size``; the longest run of last pieces of at most
    ``overlap`` words is carried into the next chunk, to which the piece is then added whatever its size."""
    empty = F.array().cast("array<struct<a:int,e:int>>")
    start = F.struct(empty.alias("done"), F.lit(1).alias("a"), F.lit(0).alias("total"))

    def carry(state: Column, i: Column) -> Column:
        """(pieces carried, their words), looking back from the piece before i to the chunk's first."""
        back = F.sequence(i - 1, state.a, F.lit(-1))
        none = F.struct(F.lit(0).alias("k"), F.lit(0).alias("w"), F.lit(True).alias("on"))

        def look(c: Column, j: Column) -> Column:
            fits = c.on & (c.w + F.get(n, j - 1) <= overlap)
            return F.struct((c.k + F.when(fits, 1).otherwise(0)).alias("k"), (c.w + F.when(fits, F.get(n, j - 1)).otherwise(0)).alias("w"), fits.alias("on"))

        return F.aggregate(back, none, look)

    def step(state: Column, i: Column) -> Column:
        size_i = F.get(n, i - 1)
        full = (i > state.a) & (state.total + size_i > size)
        closed = F.concat(state.done, F.array(F.struct(state.a.alias("a"), (i - 1).alias("e"))))
        kept = carry(state, i) if overlap else F.struct(F.lit(0).alias("k"), F.lit(0).alias("w"))
        return F.when(full, F.struct(closed.alias("done"), (i - kept.k).alias("a"), (kept.w + size_i).alias("total"))).otherwise(
            F.struct(state.done.alias("done"), state.a.alias("a"), (state.total + size_i).alias("total"))
        )

    last = lambda s: F.concat(s.done, F.array(F.struct(s.a.alias("a"), F.size(n).alias("e"))))
    return F.when(F.size(n) > 0, F.aggregate(F.sequence(F.lit(1), F.size(n)), start, step, last)).otherwise(empty)


def _with_groups(rows: DataFrame, name: str, pieces: str, size: int, overlap: int) -> DataFrame:
    """``rows`` that have pieces, with their groups.  These are exploded by the outer form, which loses nothing, since no row is empty: for the
    inner one Spark would add a filter that makes the groups, and the pieces anew at each step of their fold."""
    rows = rows.where(F.size(pieces) > 0)
    return rows.withColumn("_n", F.transform(F.col(pieces), lambda p: p.n)).withColumn(name, groups(F.col("_n"), size, overlap)).drop("_n")


def _take(pieces: Column, g: Column) -> Column:
    return F.slice(pieces, g.a, g.e - g.a + 1)


def _chunk_columns(pieces: Column) -> list[Column]:
    return [
        F.array_join(F.transform(pieces, lambda p: p.s), " ").alias("text"),
        F.element_at(pieces, 1).page.alias("page"),
        F.aggregate(pieces, F.lit(0), lambda a, p: a + p.n).alias("n_words"),
    ]


def chunk_fixed(files: DataFrame, key: str = "file_name", size: int = FIXED[0], overlap: int = FIXED[1]) -> DataFrame:
    """``key``, chunk_index, total_chunks, strategy, parent_id (null), text, page, n_words."""
    rows = _with_groups(files, "g", "pieces", size, overlap)
    rows = rows.select(key, "pieces", F.size("g").alias("total_chunks"), F.posexplode_outer("g").alias("chunk_index", "g"))
    rows = rows.withColumn("own", _take(F.col("pieces"), F.col("g")))
    return rows.select(key, "chunk_index", "total_chunks", F.lit("fixed").alias("strategy"), F.lit(None).cast("string").alias("parent_id"), *_chunk_columns(F.col("own")))


def parents_of(files: DataFrame, key: str = "file_name", size: int = PARENT[0], overlap: int = PARENT[1]) -> DataFrame:
    """``key``, file_hash, parent_index, parent_id (from content, so a second run makes the same), text, page, n_words, own (pieces)."""
    rows = _with_groups(files, "g", "pieces", size, overlap)
    rows = rows.select(key, "file_hash", "pieces", F.posexplode_outer("g").alias("parent_index", "g")).withColumn("own", _take(F.col("pieces"), F.col("g")))
    parent_id = F.sha2(F.concat_ws("|", "file_hash", F.col("parent_index").cast("string")), 256)
    return rows.select(key, "file_hash", "parent_index", parent_id.alias("parent_id"), "own", *_chunk_columns(F.col("own")))


def chunk_children(parents: DataFrame, key: str = "file_name", size: int = CHILD[0], overlap: int = CHILD[1]) -> DataFrame:
    """Children within each parent; chunk_index runs over the whole file."""
    from pyspark.sql import Window

    rows = _with_groups(parents.select(key, "parent_index", "parent_id", F.col("own").alias("pieces")), "g", "pieces", size, overlap)
    rows = rows.select(key, "parent_index", "parent_id", "pieces", F.posexplode_outer("g").alias("child", "g")).withColumn("own", _take(F.col("pieces"), F.col("g")))
    rows = rows.select(key, "parent_index", "child", "parent_id", *_chunk_columns(F.col("own")))
    in_file = Window.partitionBy(key)
    return rows.select(
        key,
        (F.row_number().over(in_file.orderBy("parent_index", "child")) - 1).alias("chunk_index"),
        F.count("*").over(in_file).cast("int").alias("total_chunks"),
        F.lit("hierarchical_child").alias("strategy"),
        "parent_id",
        "text",
        "page",
        "n_words",
    )


def chunk_documents(pages: DataFrame, key: str = "file_name", terms: list[str] | None = None) -> DataFrame:
    """Files whose first three pages look financial are chunked as parents and children, others in fixed windows."""
    from pyspark.sql import Window

    first = pages.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("page"))).where("_rank <= 3")
    sample = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p.t), " ").alias("sample"))
    files = pieces_of_files(pages, key).join(sample.select(key, is_financial(F.col("sample"), terms).alias("financial")), key)
    return chunk_fixed(files.where(~F.col("financial")), key).unionByName(chunk_children(parents_of(files.where("financial"), key), key))


def file_texts(pages: DataFrame, key: str = "file_name") -> DataFrame:
    """Pages that are not blank, joined by line feeds in page order."""
    rows = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text), "\n")
    return rows.groupBy(key).agg(joined.alias("text"))


def assign_sections(chunks: DataFrame, sections: Column) -> DataFrame:
    """Adds section int: which of ``sections`` windows of its file a chunk lies in."""
    at = F.floor(F.col("chunk_index") / F.greatest(F.col("total_chunks"), F.lit(1)) * sections)
    return chunks.withColumn("section", F.least(at, sections - 1).cast("int"))
