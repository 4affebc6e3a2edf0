from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packed
from corpusloom.llm.common import scratch
from tests.llm.data import ROWS, documents


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 20, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = packed.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (packed.unpack(data, 1001, bits) == ids).all()


def test_width_is_least():
    assert [packed.width(n) for n in (1, 2, 3, 4, 5, 49408, 65536, 65537)] == [1, 1, 2, 2, 3, 16, 16, 17]


def test_random_access(tmp_path):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50_000, n, dtype=np.uint32) for n in (0, 5, 1000, 1, 0, 300)]
    (tmp_path / "s").write_bytes(b"".join(packed.shard_bytes(docs, 17, block=64)))
    s = packed.Shard(str(tmp_path), "s")
    every = np.concatenate(docs)
    assert all((s.document(i) == d).all() for i, d in enumerate(docs))
    for a, b in ((0, 0), (0, 1), (63, 65), (64, 128), (900, 1306), (0, 1306)):
        assert (s.ids(a, b) == every[a:b]).all()
    (tmp_path / "bad").write_bytes(b"xxxx" + bytes(60))
    with pytest.raises(ValueError):
        packed.Shard(str(tmp_path), "bad")


def signed_hash(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def expected(rows):
    t = Tokenizer.from_file(P.path(bpe.VOCABULARY))
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1] or ""))):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_awkward_rows(spark, shards):
    folder = scratch(spark, "test-tokens")
    index = packed.write_tokens(documents(spark), folder, shards=shards)
    got = packed.read_tokens(index, folder)
    rows = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()), key=lambda r: r[1])
    assert rows == expected([(r[0], r[1]) for r in ROWS])
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in got.collect())


def test_more_shards_than_digits_of_a_name_and_than_a_group(spark, monkeypatch):
    """Shards stand in the order of their numbers, not of their names; totals go over groups of shards."""
    monkeypatch.setattr(packed, "SHARD_GROUP", 2)
    monkeypatch.setattr(packed, "shard_name", lambda number: f"shard-{number}")
    monkeypatch.setattr(packed, "READ_IDS", 10)
    rows = [(i, f"document number {i} " * (i % 7), None, None) for i in range(60)]
    folder = scratch(spark, "test-tokens")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = packed.read_tokens(packed.write_tokens(docs, folder, shards=13), folder, ids=False).collect()
    assert sorted(tuple(r) for r in got) == expected([r[:2] for r in rows])


def test_empty_table(spark):
    folder = scratch(spark, "test-tokens")
    assert packed.read_tokens(packed.write_tokens(documents(spark, []), folder), folder).count() == 0


def test_query(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in packed.query(spark, tiny).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == expected(docs)
