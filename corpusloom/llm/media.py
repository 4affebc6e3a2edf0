"""Operator 7: media columns, content-addressed payloads in tar shards.

A payload (bytes, a multiple of 192) is stored without loss as the samples of an 8-bit RGB image, 64 pixels wide, in PNG.
The member's name in its tar shard is the payload's SHA-256; rows carry digest, shard, offset and length of the image.
Metadata columns come from range reads of the image header alone (33 bytes); features from reading the whole image back.

Each task stores a payload once and writes its shards alone, under names that no other attempt uses, so a task that runs
again leaves an unreferenced file at worst.  No payload is ever shuffled: only addresses are, and for payloads that several
tasks have stored the smallest address becomes everyone's.  So all rows with equal payloads carry the same address.

Defined results: null text is empty text, whose payload is 192 blanks; repeated rows give repeated rows; an empty table
stores nothing and gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import AtomicFile, arrow_texts, enter, filesystem, materialize, scratch, text_or_empty

UNIT = 192
PIXELS = 64
SHARD_BYTES = 64 << 20
HEADER = 33  # bytes up to the end of an image's header chunk
LEVEL = 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: Column) -> Column:
    """The text's UTF-8 bytes, padded with blanks to a positive multiple of ``UNIT``."""
    n = F.octet_length(text)
    return F.concat(text, F.repeat(F.lit(" "), (F.greatest(F.ceil(n / UNIT), F.lit(1)) * UNIT - n).cast("int")))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """The payload as an RGB image of 8-bit samples, every line unfiltered."""
    height = len(payload) // UNIT
    lines = np.zeros((height, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, UNIT)
    head = struct.pack(">IIBBBBB", PIXELS, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def image_header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits of a sample, samples of a pixel) from the first ``HEADER`` bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not an image of this kind")
    width, height, bits, color = struct.unpack(">IIBB", data[16:26])
    return width, height, bits, {0: 1, 2: 3, 4: 2, 6: 4}[color]


def decode_image(data: bytes) -> bytes:
    """The samples of an image that ``encode_image`` made."""
    width, height, bits, samples = image_header(data)
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width * samples * bits // 8 + 1)
    if lines[:, 0].any():
        raise ValueError("a line is filtered")
    return lines[:, 1:].tobytes()


class TarShard:
    """Appends members to a tar file of the shared folder."""

    def __init__(self, folder: str):
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.file = AtomicFile(folder, self.name)

    def add(self, name: str, data: bytes) -> int:
        """Returns the offset of the member's data."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.file.write(info.tobuf(tarfile.USTAR_FORMAT))
        at = self.file.write(data)
        self.file.write(b"\0" * (-len(data) % 512))
        return at

    def close(self) -> None:
        self.file.write(b"\0" * 1024)
        self.file.close()


class RangeReader:
    """Reads byte ranges of shards; keeps the last one open."""

    def __init__(self, folder: str):
        self.fs, self.root = filesystem(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def store(payloads: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads (column payload: string or binary) and return their addresses, one row for each distinct one:
    digest, shard, offset long, length long."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("media")
        seen: set[bytes] = set()
        shard = None
        for batch in batches:
            rows = []
            for p in arrow_texts(batch.column(0)):
                digest = hashlib.sha256(p)
                if digest.digest() in seen:
                    continue
                seen.add(digest.digest())
                if shard and shard.file.size > shard_bytes:
                    shard.close()
                    shard = None
                shard = shard or TarShard(folder)
                image = encode_image(p)
                rows.append((digest.hexdigest(), shard.name, shard.add(digest.hexdigest() + ".png", image), len(image)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    found = materialize(payloads.select("payload").mapInArrow(run, "digest string, shard string, offset bigint, length bigint"), "addresses")
    least = found.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return materialize(least.select("digest", "at.*"), "addresses")


def fill_metadata(addresses: DataFrame, folder: str) -> DataFrame:
    """Adds width, height, bits and samples int by header-only range reads."""
    import pyarrow as pa

    names = ["width", "height", "bits", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            found = [image_header(reader.read(s, o, HEADER)) for s, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in (zip(*found, strict=True) if found else ([],) * 4))], [*batch.schema.names, *names])

    rows = addresses.select("digest", "shard", "offset", "length")
    schema = "digest string, shard string, offset bigint, length bigint, " + ", ".join(f"{n} int" for n in names)
    return rows.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def read_features(media: DataFrame, folder: str) -> DataFrame:
    """From what ``fill_metadata`` returns: digest, shard, offset, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature (kind, size and the mean of each channel), all from the stored bytes."""
    import pyarrow as pa

    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            rows = []
            for shard, offset, length, *meta in zip(*(batch.column(k).to_pylist() for k in range(1, 8)), strict=True):
                data = reader.read(shard, offset, length)
                p = decode_image(data)
                mean = np.frombuffer(p, np.uint8).reshape(-1, meta[3]).mean(axis=0)
                feature = f"png {meta[0]}x{meta[1]}x{meta[3]} {meta[2]}-bit mean " + ",".join(f"{m:.3f}" for m in mean)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))], ["digest", "shard", "offset", *kinds])

    schema = "digest string, shard string, offset bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("digest", "shard", "offset", "length", "width", "height", "bits", "samples").mapInArrow(run, schema)


def extract(folder: str, shard: str) -> dict[str, bytes]:
    """All members of a shard, by an ordinary tar reader."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{shard}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole text stored as media and read back."""
    from corpusloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    folder = scratch(spark, "media")
    addresses = store(docs.select(payload_of(F.col("text")).alias("payload")), folder)
    features = read_features(fill_metadata(addresses, folder), folder)
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(payload_of(F.col("text")).cast("binary"), 256).alias("digest"))
    return rows.join(features, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset")


