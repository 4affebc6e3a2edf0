"""Operator 1: token ids in fixed-width bit packed shard files.

File layout (all integers little-endian):

    magic "CLPK", u16 version, u16 bits per id, u32 ids per block, u64 ids, u64 documents
    u64[documents + 1]      first id of each document within the shard, then the number of ids
    u64[blocks + 1]         byte offset of each block from the start of the data, then the size of the data
    data                    blocks; each starts on a byte, ids packed from the lowest bit up

``bits`` is the least width that holds every id of the vocabulary.  A block can be unpacked alone, so a range of ids
costs the header and the blocks that it touches.

Documents are dealt to shards by ranges of the document id, so that shard order is id order.  Each file is written under
a temporary name and then renamed; a task that runs again replaces its file by an equal one.  Where a shard begins
follows from running totals within groups of ``SHARD_GROUP`` shards and over the groups; the driver sees no row of it.

Defined results: null text is empty text (only the end id is stored).  Rows with a null id come first; rows with equal
ids stand in the order of a hash of their texts.  An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import STEP, VOCABULARY, codec, free_codecs
from corpusloom.llm.common import AtomicFile, arrow_texts, enter, filesystem, groups_by_bytes, scratch, text_or_empty, tokenizer_path

MAGIC, VERSION, HEAD = b"CLPK", 1, struct.Struct("<4sHHIQQ")
BLOCK = 4096  # ids of a block
SHARD_BYTES = 32 << 20  # text that a shard should hold


SHARD_GROUP = 1024  # shards whose places are found together
READ_IDS = 1 << 20  # ids read back at once


def shard_name(number: int) -> str:
    return f"shard-{number:06d}.clpk"


def width(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first, padded with zero bits to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def shard_bytes(docs: list[np.ndarray], bits: int, block: int = BLOCK) -> Iterator[bytes]:
    """The parts of a shard file that holds these documents' ids."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    starts = np.cumsum([0] + [len(d) for d in docs], dtype=np.uint64)
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    yield HEAD.pack(MAGIC, VERSION, bits, block, len(ids), len(docs))
    yield starts.astype("<u8").tobytes()
    yield np.cumsum([0] + [len(b) for b in blocks], dtype=np.uint64).astype("<u8").tobytes()
    yield from blocks


class Shard:
    """Reads a shard file; only the header and the blocks asked for are fetched."""

    def __init__(self, folder: str, name: str):
        fs, root = filesystem(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        magic, version, self.bits, self.block, self.n_ids, self.n_docs = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{name} is no packed token file")
        n_blocks = -(-self.n_ids // self.block)
        at = HEAD.size
        self.starts = np.frombuffer(self.file.read_at(8 * (self.n_docs + 1), at), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(self.file.read_at(8 * (n_blocks + 1), at), "<u8").astype(np.int64)
        self.data = at + 8 * (n_blocks + 1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of the shard."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), self.data + int(self.offsets[first]))
        out = []
        for k in range(first, last + 1):
            a, b = int(self.offsets[k] - self.offsets[first]), int(self.offsets[k + 1] - self.offsets[first])
            out.append(unpack(data[a:b], min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(out)[begin - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int | None = 2,
    block: int = BLOCK,
    shards: int | None = None,
) -> DataFrame:
    """Write all documents' ids to shard files below ``folder`` in ascending id order.

    Returns the index, one row for each document: ``id_col``, shard int, ordinal int (within the shard), shard_start long
    (ids of all shards before).  Texts are dealt by range before they are encoded: finding the ranges reads the rows once
    more, which must not encode them twice.
    """
    import pyarrow as pa

    spark, path = docs.sparkSession, tokenizer or tokenizer_path(VOCABULARY)
    id_type = docs.schema[id_col].dataType.simpleString()
    if shards is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enter("bpe", free_codecs)
        c = codec(path)
        bits = width(c.tokenizer.get_vocab_size())
        wire = np.dtype("<u2" if bits <= 16 else "<u4")
        end = np.array([] if end_id is None else [end_id], wire)
        number = TaskContext.get().partitionId()
        name = shard_name(number)
        kept, docs_ids = [], []
        for batch in batches:
            kept.append(batch.column(0))
            texts = arrow_texts(batch.column(1))
            for a, b in groups_by_bytes(texts, STEP):
                flat, counts = c.encode_flat(texts[a:b])
                last = np.cumsum(counts)
                flat = np.insert(flat.astype(wire), last, end[0]) if len(end) else flat.astype(wire)
                docs_ids += np.split(flat, (last + len(end) * np.arange(1, len(last) + 1))[:-1])
        if not docs_ids:
            return
        out = AtomicFile(folder, name)
        for part in shard_bytes(docs_ids, bits, block):
            out.write(part)
        out.close()
        at, n = 0, sum(map(len, docs_ids))
        for col in kept:
            yield pa.RecordBatch.from_arrays(
                [col, pa.array([number] * len(col), pa.int32()), pa.array(range(at, at + len(col)), pa.int32()), pa.array([n] * len(col), pa.int64())], ["id", "shard", "ordinal", "shard_ids"]
            )
            at += len(col)

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # so that even rows of one id can be dealt to several shards
    ordered = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    index_path = folder.rstrip("/") + "-index"
    ordered.mapInArrow(write, f"id {id_type}, shard int, ordinal int, shard_ids bigint").write.parquet(index_path)
    index = spark.read.parquet(index_path)
    # Where each shard begins: running totals within groups of shards, then over the groups, of which there are few.
    sizes = index.groupBy("shard").agg(F.max("shard_ids").alias("n")).withColumn("g", F.floor(F.col("shard") / SHARD_GROUP))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("gn"))
    groups = groups.select("g", (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("g").orderBy("shard")) - F.col("n")
    manifest = sizes.withColumn("within", within).join(groups, "g").select("shard", (F.col("before") + F.col("within")).alias("shard_start"))
    return index.join(manifest, "shard").select(F.col("id").alias(id_col), "shard", "ordinal", "shard_start")


def read_tokens(index: DataFrame, folder: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """Read the shard files back: ``id_col``, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and,
    with ``ids``, the ids as array<int>."""
    import pyarrow as pa

    id_type = index.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for batch in batches:
            crc, lists = [], []
            numbers, ordinals, base = (np.asarray(batch.column(k)) for k in (1, 2, 3))
            start, n = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            # Rows that stand in a row in a shard are read together.
            runs = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(ordinals) != 1)) + 1 if len(numbers) else []
            for first, end in pairwise([0, *runs, len(numbers)]) if len(numbers) else ():
                if numbers[first] != number:
                    if shard:
                        shard.close()
                    shard, number = Shard(folder, shard_name(int(numbers[first]))), numbers[first]
                at = shard.starts[ordinals[first] : ordinals[first] + (end - first) + 1]
                start[first:end], n[first:end] = base[first:end] + at[:-1], np.diff(at)
                a = 0
                while a < end - first:  # a bounded number of ids at once, one document at least
                    b = max(a + 1, int(np.searchsorted(at, at[a] + READ_IDS, "right")) - 1)
                    ids_run = shard.ids(int(at[a]), int(at[b])).astype("<u4", copy=False)
                    view = memoryview(ids_run).cast("B") if len(ids_run) else b""
                    cuts = (at[a : b + 1] - at[a]).tolist()
                    crc += [zlib.crc32(view[4 * i : 4 * j]) for i, j in pairwise(cuts)]
                    if ids:
                        lists += [ids_run[i:j].astype(np.int32) for i, j in pairwise(cuts)]
                    a = b
            cols = [batch.column(0), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(lists, pa.list_(pa.int32()))] if ids else []), [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)
        if shard:
            shard.close()

    schema = f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return index.select(id_col, "shard", "ordinal", "shard_start").mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: place, length and checksum of every document's ids, read back from the files."""
    from corpusloom.llm.common import table

    folder = scratch(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder), folder, ids=False)
