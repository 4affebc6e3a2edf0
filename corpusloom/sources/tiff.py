"""TIFF files: the directories of their frames, and each frame as a picture that a vision model takes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from corpusloom.sources.parsers import Page, Vision, blind

# Tags of a directory, sizes of its value types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 279, 317
TYPE_SIZES = {1: 1, 3: 2, 4: 4}
PLAIN, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 8, 32946, 32773


def png(width: int, height: int, channels: int, samples: bytes) -> bytes:
    """A PNG file of 8-bit grey (one channel) or RGB samples."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    step = width * channels
    rows = b"".join(b"\0" + samples[i * step : (i + 1) * step] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def directories(data: bytes) -> Iterator[tuple[dict[int, list[int]], int, int]]:
    """(values by tag, place, place of the next directory's offset) of each frame, in order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPE_SIZES:
                place = at + 10 + 12 * i
                if count * TYPE_SIZES[kind] > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{count}{'?BBHI'[kind] if kind != 1 else 'B'}", data, place))
        link = at + 2 + 12 * n
        yield tags, at, link
        at = struct.unpack_from(order + "I", data, link)[0]


def _unpacked(data: bytes) -> bytes:
    """PackBits: runs of literals and of one byte."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 1 + (n > 128)
    return bytes(out)


def picture(data: bytes, tags: dict[int, list[int]], at: int, link: int) -> tuple[bytes, str]:
    """(file, media type) of a frame: PNG where its samples can be read here, else a TIFF file of this frame alone."""
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, samples, way, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, PLAIN), set(tags.get(BITS, [1]))
    undo = {PLAIN: bytes, PACKBITS: _unpacked, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}.get(way)
    plain = undo and one(PREDICTOR, 1) == 1 and one(PHOTOMETRIC, 1) in (0, 1, 2) and ((samples == 1 and bits <= {1, 8}) or (samples == 3 and bits == {8}))
    if plain and STRIPS in tags and len(tags[STRIPS]) == len(tags.get(STRIP_BYTES, [])):
        raw = b"".join(undo(data[s : s + n]) for s, n in zip(tags[STRIPS], tags[STRIP_BYTES], strict=True))
        if bits == {1}:
            step = (width + 7) // 8
            raw = b"".join(bytes(255 * (row[j >> 3] >> (7 - (j & 7)) & 1) for j in range(width)) for row in (raw[i * step : (i + 1) * step] for i in range(height)) if len(row) == step)
        if one(PHOTOMETRIC, 1) == 0:
            raw = bytes(255 - x for x in raw)
        if len(raw) >= width * height * samples > 0:
            return png(width, height, samples, raw), "image/png"
    order = "<" if data[:2] == b"II" else ">"
    alone = bytearray(data)
    struct.pack_into(order + "I", alone, 4, at)
    struct.pack_into(order + "I", alone, link, 0)
    return bytes(alone), "image/tiff"


def parse_tiff(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    """A page for each frame that the model finds text in; frame k is page k + 1."""
    texts = [(k, vision(*picture(content, *d))) for k, d in enumerate(directories(content), 1)]
    return [(k, text, None) for k, text in texts if text.strip()]
