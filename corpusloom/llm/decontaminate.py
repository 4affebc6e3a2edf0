"""Operator 4: benchmark decontamination by a distributed positional inverted index.

The training texts' words are indexed in shards of at most ``SHARD_BYTES`` of text (one text at least); a shard is a
row of a stored table: sorted term hashes, the bounds of their posting lists, and the postings, positions of the shard in
ascending order.  A position is a word's number plus its document's number, so no phrase can cross two documents.

A search takes distinct benchmark items in blocks of about ``BLOCK_BYTES``, one block at a time: it is sent to the tasks, every shard
answers it, and it is given up before the next one.  So the driver and each task hold one block, whatever the benchmark's size.  A phrase starts from the posting list of its rarest term in the shard; the lists of its other
terms, shifted by their offsets, are intersected from the next rarest on until nothing is left or all agree.  Proximity
search asks for the terms in any order within a number of words of the rarest one.

With one block there is no shuffle: the index is partitioned by document, and only answers leave a shard.  With more, the answers to
each block, covered spans of the documents that it meets, are a stored table; they are put together by document, spans overlapping or not.

Defined results: null and wordless texts have no words, hits or items; a null or wordless item has no window; an item id
counts once however many rows carry it; rows with a null item id mark hits, but are neither listed nor counted; an item
of fewer words than ``WINDOW`` is one window; repeated documents are answered as often as they occur; empty tables give
empty tables or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.blocks import text_key
from corpusloom.llm.common import arrow_texts, enter, groups_by_bytes, materialize, text_or_empty
from corpusloom.llm.textvec import ALPHANUMERIC, word_hashes

WINDOW = 13
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20
BROADCAST_ROWS = 200_000  # keys of 32 characters
KEY = "_text_key_"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a table, one row a shard: shard string, ids array, n_words array<int>, terms, bounds, postings binary.

    ``terms`` are sorted unsigned 64-bit hashes, ``bounds`` and ``postings`` unsigned 32-bit integers."""
    import pyarrow as pa

    id_field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enter("decontaminate")
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        id_type = None

        def shard() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in found])
            counts = np.concatenate([x for _, x in found])
            order = np.argsort(h, kind="stable")
            positions = (np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts))[order].astype("<u4")
            terms, first = np.unique(h[order], return_index=True)
            bounds = np.append(first, len(h)).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{number}"]),
                    pa.array([[x for c in ids for x in c.to_pylist()]], pa.list_(id_type)),
                    pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (terms.astype("<u8"), bounds, positions)),
                ],
                ["shard", "ids", "n_words", "terms", "bounds", "postings"],
            )

        for batch in batches:
            texts, id_type = arrow_texts(batch.column(1)), batch.schema.field(0).type
            for a, b in groups_by_bytes(texts, 1 << 20):
                size = sum(map(len, texts[a:b]))
                if held and held + size > shard_bytes:
                    yield shard()
                    ids.clear()
                    found.clear()
                    held, number = 0, number + 1
                ids.append(batch.column(0).slice(a, b - a))
                found.append(word_hashes(texts[a:b], ALPHANUMERIC))
                held += size
        if ids:
            yield shard()

    kind = id_field.dataType.simpleString()
    rows = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"shard string, ids array<{kind}>, n_words array<int>, terms binary, bounds binary, postings binary")


class Postings:
    """One shard's lists."""

    def __init__(self, n_words: np.ndarray, terms: bytes, bounds: bytes, postings: bytes):
        self.n_words = n_words
        self.terms, self.bounds = np.frombuffer(terms, "<u8"), np.frombuffer(bounds, "<u4").astype(np.int64)
        self.postings = np.frombuffer(postings, "<u4")
        self.begin = np.concatenate([[0], np.cumsum(n_words + 1)])  # first position of each document

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) of the list of each term; length 0 if it does not occur."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return self.bounds[at], np.where(there, self.bounds[at + 1] - self.bounds[at], 0)

    def phrase(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Positions at which the terms with these lists stand one after the other."""
        order = np.argsort(length, kind="stable")
        k = order[0]
        at = self.postings[begin[k] : begin[k] + length[k]].astype(np.int64) - k
        for k in order[1:]:
            if not len(at):
                break
            other = self.postings[begin[k] : begin[k] + length[k]]
            j = np.searchsorted(other, at + k)
            at = at[(j < len(other)) & (other[np.minimum(j, len(other) - 1)] == at + k)]
        return at

    def near(self, begin: np.ndarray, length: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within so many words, in the same document."""
        order = np.argsort(length, kind="stable")
        k = order[0]
        at = self.postings[begin[k] : begin[k] + length[k]].astype(np.int64)
        doc = self.document(at)
        low = np.maximum(at - within, self.begin[doc])
        high = np.minimum(at + within, self.begin[doc + 1] - 2)
        alive = np.ones(len(at), bool)
        for k in order[1:]:
            other = self.postings[begin[k] : begin[k] + length[k]]
            alive &= np.searchsorted(other, high, "right") > np.searchsorted(other, low)
        return at[alive]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, positions, "right") - 1


class Items:
    """Benchmark items of one block: distinct terms, and each item's words as numbers of terms."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        h, counts = word_hashes([t.encode() for _, t in rows], ALPHANUMERIC)
        self.terms, words = np.unique(h, return_inverse=True)
        ends = np.cumsum(counts)
        self.items = [(i, words[e - n : e]) for (i, _), e, n in zip(rows, ends.tolist(), counts.tolist(), strict=True) if n]
        self.window = window

    def phrases(self, p: Postings) -> Iterator[tuple[str | None, np.ndarray, int]]:
        """(item id, positions, words) of each window that occurs."""
        begin, length = p.lookup(self.terms)
        for item, words in self.items:
            size = min(self.window, len(words))
            missing = np.concatenate([[0], np.cumsum(length[words] == 0)])
            for i in np.flatnonzero(missing[size:] == missing[:-size]).tolist():
                w = words[i : i + size]
                if len(at := p.phrase(begin[w], length[w])):
                    yield item, at, size

    def proximities(self, p: Postings, within: int) -> Iterator[tuple[str | None, np.ndarray]]:
        begin, length = p.lookup(self.terms)
        for item, words in self.items:
            w = np.unique(words)
            if length[w].all() and len(at := p.near(begin[w], length[w], within)):
                yield item, at


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list[tuple[str | None, str]]]]:
    """How many blocks there are, and the distinct (id, text) of one, about ``block_bytes`` at a time."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), text_or_empty(F.col(text_col)).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield n, [(r["id"], r["text"]) for r in part.collect()]


def _each_block(index: DataFrame, items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int, one, more) -> list[DataFrame]:
    """``one(broadcast items)`` of the only block; or ``more`` of each, stored before the next block is fetched."""
    out = []
    for n, rows in item_blocks(items, item_col, text_col, block_bytes):
        block = index.sparkSession.sparkContext.broadcast(Items(rows, window))
        if n == 1:
            return [one(block)]
        out.append(materialize(more(block), "block-answers"))
        block.unpersist()
    return out


def _covered(p: Postings, block: Items) -> tuple[np.ndarray, list[set[str]]]:
    """Which positions of a shard lie in an occurrence of a window, and the items of each document."""
    steps = np.zeros(int(p.begin[-1]) + 1, np.int32)
    listed: list[set[str]] = [set() for _ in range(len(p.begin) - 1)]
    for item, at, size in block.phrases(p):
        np.add.at(steps, at, 1)
        np.add.at(steps, at + size, -1)
        if item is not None:
            for d in set(p.document(at).tolist()):
                listed[d].add(item)
    return np.cumsum(steps) > 0, listed


def _postings(batch, k: int) -> Postings:
    return Postings(np.asarray(batch.column("n_words")[k].values, dtype=np.int64), *(batch.column(c)[k].as_buffer() for c in ("terms", "bounds", "postings")))


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Phrase matches, one row for each indexed document: id, n_words long, n_hit long, items array<string> (sorted, distinct)."""
    import pyarrow as pa

    kind = index.schema["ids"].dataType.elementType.simpleString()
    rows = index.select("shard", "ids", "n_words", "terms", "bounds", "postings")

    def whole(block) -> DataFrame:
        """A row for each document of each shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            for batch in batches:
                for k in range(batch.num_rows):
                    p = _postings(batch, k)
                    covered, listed = _covered(p, block.value)
                    hit = np.concatenate([[0], np.cumsum(covered)])
                    n_hit = hit[p.begin[1:]] - hit[p.begin[:-1]]
                    n_words = batch.column("n_words")[k].values.cast(pa.int64())
                    found = [batch.column("ids")[k].values, n_words, pa.array(n_hit.astype(np.int64)), pa.array([sorted(x) for x in listed], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(found, ["id", "n_words", "n_hit", "items"])

        return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_hit bigint, items array<string>")

    def spans(block) -> DataFrame:
        """A row for each document with a match: its number in the shard, the covered spans and the items."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
            for batch in batches:
                for k in range(batch.num_rows):
                    p = _postings(batch, k)
                    covered, listed = _covered(p, block.value)
                    turns = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                    first, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
                    # A position lies between two documents, so no span reaches over their border.
                    docs, at = np.unique(p.document(first), return_index=True)
                    pairs = pa.StructArray.from_arrays([pa.array(first), pa.array(end)], fields=list(span))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)).astype(np.int32)), pairs)
                    found = [pa.array([batch.column("shard")[k].as_py()] * len(docs), pa.string()), pa.array(docs.astype(np.int64)), lists, pa.array([sorted(listed[d]) for d in docs], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(found, ["shard", "doc", "spans", "items"])

        return rows.mapInArrow(run, "shard string, doc bigint, spans array<struct<first bigint, end bigint>>, items array<string>")

    found = _each_block(index, items, item_col, text_col, window, block_bytes, whole, spans)
    if "shard" not in found[0].columns:
        return found[0]
    met = found[0]
    for part in found[1:]:
        met = met.unionByName(part)
    met = met.groupBy("shard", "doc").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Spans by their first position: each adds what lies beyond the end of those before it.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    more = lambda a, x: F.struct((a.n + F.greatest(x.end - F.greatest(x.first, a.end), F.lit(0).cast("bigint"))).alias("n"), F.greatest(a.end, x.end).alias("end"))
    met = met.select("shard", "doc", F.aggregate("spans", start, more).n.alias("n_hit"), "items")
    docs = index.select("shard", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "d")).select("shard", F.col("doc").cast("bigint").alias("doc"), F.col("d.ids").alias("id"), F.col("d.n_words").cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return docs.join(met, ["shard", "doc"], "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def proximity(index: DataFrame, items: DataFrame, within: int, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold all of an item's words within ``within`` words of its rarest: id, item string, n_places long."""
    import pyarrow as pa

    kind = index.schema["ids"].dataType.elementType.simpleString()

    def answers(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, p = batch.column("ids")[k].values, _postings(batch, k)
                    for item, at in block.value.proximities(p, within):
                        d, n = np.unique(p.document(at), return_counts=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array([item] * len(d), pa.string()), pa.array(n.astype(np.int64))], ["id", "item", "n_places"])

        return index.select("ids", "n_words", "terms", "bounds", "postings").mapInArrow(run, f"id {kind}, item string, n_places bigint")

    found = _each_block(index, items, item_col, text_col, WINDOW, block_bytes, answers, answers)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def report(found: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """The contract's columns from what ``search`` returns."""
    return found.select(
        F.col("id").alias(id_name),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def contaminated(n_hit, n_words):
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Rows are told apart by their text, so null and repeated ids do no harm.  The contaminated texts' keys are broadcast if there
    are at most ``broadcast_rows`` (counted), else joined by a shuffle."""
    keyed = docs.withColumn(KEY, text_key(F.col(text_col)))
    index = materialize(build_index(keyed.select(KEY, text_col), KEY, text_col), "postings")
    found = search(index, items, item_col).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("id").alias(KEY)).distinct()
    found = materialize(found, "contaminated")
    few = found.count() <= broadcast_rows
    return keyed.join(F.broadcast(found) if few else found, KEY, "left_anti").drop(KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: contamination of every whole document by the whole benchmark."""
    from corpusloom.llm.common import table

    index = materialize(build_index(table(spark, sf_dir, "documents")), "postings")
    return report(search(index, table(spark, sf_dir, "benchmark")))
