from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import media
from corpusloom.llm.common import filesystem, scratch, text_or_empty
from tests.llm.data import ROWS, documents


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.binary(min_size=1, max_size=64))
def test_image_round_trip(lines, seed):
    payload = (seed * 960)[: lines * media.UNIT]
    image = media.encode_image(payload)
    assert media.decode_image(image) == payload
    assert media.image_header(image[: media.HEADER]) == (64, lines, 8, 3)


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        media.image_header(b"\0" * 33)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000])
def test_awkward_rows(spark, shard_bytes):
    docs = documents(spark).select("doc_id", text_or_empty(F.col("text")).alias("text"))
    folder = scratch(spark, "test-media")
    addresses = media.store(docs.select(media.payload_of(F.col("text")).alias("payload")), folder, shard_bytes)
    rows = {r["digest"]: r for r in media.read_features(media.fill_metadata(addresses, folder), folder).collect()}
    payloads = set()
    for _, t, *_ in ROWS:
        b = (t or "").encode()
        payloads.add(b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b)))
    assert set(rows) == {hashlib.sha256(p).hexdigest() for p in payloads}
    members: dict[str, dict] = {}
    for p in payloads:
        r = rows[hashlib.sha256(p).hexdigest()]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        shard = members.setdefault(r["shard"], media.extract(folder, r["shard"]))  # an ordinary tar reader finds the same bytes
        image = shard[r["digest"] + ".png"]
        assert (hashlib.sha256(image).hexdigest(), len(image)) == (r["media_sha256"], r["media_bytes"]) and media.decode_image(image) == p
        assert r["feature"].startswith(f"png 64x{len(p) // 192}x3 8-bit mean ")


def test_empty_table_stores_nothing(spark):
    folder = scratch(spark, "test-media")
    addresses = media.store(documents(spark, []).select(F.col("text").alias("payload")), folder)
    assert addresses.count() == 0 and media.fill_metadata(addresses, folder).count() == 0
    fs, root = filesystem(folder)
    assert not fs.get_file_info(root).is_file


def test_query(spark, tiny):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = media.query(spark, tiny).collect()
    assert len(got) == len(docs)
    seen: dict[str, tuple] = {}
    for r in got:
        b = docs[r["doc_id"]].encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        assert (r["n_bytes"], r["payload_sha256"]) == (len(b), hashlib.sha256(p).hexdigest())
        own = tuple(r)[1:]
        assert seen.setdefault(docs[r["doc_id"]], own) == own
