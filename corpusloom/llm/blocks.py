"""Corpus-wide token counts and their way back to the texts, without a row for each token.

Texts are dealt to blocks by a hash of the text.  A block turns its texts into sorted distinct tokens (64-bit hashes) with
counts, cut by ranges of the hash into buckets.  A bucket adds up what all blocks sent for its range; a token that every
text holds arrives once from each block, so no bucket grows with the hottest token.  The totals go back to the blocks that
sent the tokens, where the texts are cogrouped with them.  Blocks and buckets hold about ``BLOCK_BYTES`` of text each,
whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import enter, text_or_empty

BLOCK_BYTES = 5 << 20
U = np.uint64


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences, byte plane by byte plane: the planes of zeros compress to nothing."""
    d = np.diff(x, prepend=U(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U)


def block_count(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for all texts, from the sum of their sizes."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // block_bytes))


def text_key(text: Column) -> Column:
    return F.md5(text_or_empty(text).cast("binary"))


def distinct_texts(docs: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """(block int, key string, text string): each task passes a text on once, so a text's copies shrink before the shuffle."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("blocks")
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for k in batch.column(1).to_pylist():
                b = bytes.fromhex(k)
                keep.append(b not in seen)
                seen.add(b)
            yield pa.RecordBatch.from_arrays([pc.filter(c, pa.array(keep, pa.bool_())) for c in batch.columns], ["block", "key", "text"])

    text = text_or_empty(F.col(text_col))
    key = text_key(F.col(text_col))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), key.alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "block int, key string, text string")


def totals(dealt: DataFrame, buckets: int, tokens: Callable, least: int = 1) -> DataFrame:
    """Totals of all tokens, by block: (block int, bucket int, tokens, totals, first binary).

    ``first`` has a bit for each token, set in one of the rows that the token is in.

    ``dealt`` has a column block and whatever ``tokens(table)`` needs, which returns (sorted distinct tokens, counts) of one
    block's rows.  Tokens whose total is below ``least`` are left out."""
    import pyarrow as pa

    def count(table: pa.Table) -> pa.Table:
        enter("blocks")
        x, n = tokens(table)
        block = table.column("block")[0].as_py()
        cuts = np.searchsorted(x, (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(U)) if buckets > 1 else np.zeros(0, np.int64)
        cuts = np.concatenate([[0], cuts, [len(x)]]).astype(np.int64)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        parts = [(pack_sorted(x[cuts[i] : cuts[i + 1]]), n[cuts[i] : cuts[i + 1]].astype("<u4").tobytes()) for i in full]
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), "tokens": pa.array([p for p, _ in parts], pa.binary()), "n": pa.array([p for _, p in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        enter("blocks")
        sent = [unpack_sorted(b) for b in table.column("tokens").to_pylist()]
        every = np.concatenate(sent)
        _, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(b, "<u4") for b in table.column("n").to_pylist()])).astype("<u8")
        each = total[inverse]
        new = np.zeros(len(every), bool)
        new[np.unique(inverse, return_index=True)[1]] = True
        out_t, out_n, out_f, at = [], [], [], 0
        for x in sent:
            own, fresh = each[at : at + len(x)], new[at : at + len(x)]
            at += len(x)
            keep = own >= least
            out_f.append(np.packbits(fresh[keep]).tobytes())
            out_t.append(pack_sorted(x[keep]))
            out_n.append(own[keep].tobytes())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "tokens": pa.array(out_t, pa.binary()), "totals": pa.array(out_n, pa.binary()), "first": pa.array(out_f, pa.binary())})

    counted = dealt.groupBy("block").applyInArrow(count, "bucket int, block int, tokens binary, n binary")
    return counted.groupBy("bucket").applyInArrow(add, "block int, bucket int, tokens binary, totals binary, first binary")


def lookup_table(table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted tokens, totals) of one block's rows of ``totals``; ranges of buckets are disjoint and ascending."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("tokens").to_pylist(), table.column("totals").to_pylist(), strict=True))
    x = np.concatenate([np.zeros(0, U), *(unpack_sorted(t) for _, t, _ in rows)])
    return x, np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(n, "<u8") for _, _, n in rows)])


def lookup(keys: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Total of each key, 0 where it is absent."""
    if not len(x):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(x, keys), len(x) - 1)
    return np.where(x[at] == keys, n[at], 0).astype(np.int64)
