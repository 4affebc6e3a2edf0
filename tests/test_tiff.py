"""TIFF files that the test writes itself."""

from __future__ import annotations

import struct
import zlib

import pytest

from corpusloom.sources import tiff
from corpusloom.sources.parsers import parse


def build(frames, order="<"):
    """A file of frames (width, height, samples, bits, compression, photometric, strips as stored)."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for width, height, samples, bits, way, photo, strips in frames:
        places = []
        for s in strips:
            places.append(len(out))
            out += s
        arrays = {}
        for tag, kind, values in ((258, "H", [bits] * samples), (273, "I", places), (279, "I", [len(s) for s in strips])):
            if len(values) * struct.calcsize(kind) > 4:
                arrays[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}{kind}", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * samples), (259, 3, [way]), (262, 3, [photo]), (273, 4, places), (277, 3, [samples]), (279, 4, [len(s) for s in strips])]
        out += struct.pack(order + "H", len(entries))
        for tag, kind, values in entries:
            out += struct.pack(order + "HHI", tag, kind, len(values))
            out += struct.pack(order + "I", arrays[tag]) if tag in arrays else struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values).ljust(4, b"\0")
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


GREY = bytes(range(12))
FRAMES = [
    (4, 3, 1, 8, 1, 1, [GREY[:8], GREY[8:]]),
    (4, 3, 1, 8, 8, 0, [zlib.compress(GREY)]),
    (2, 2, 3, 8, 1, 2, [GREY]),
    (9, 2, 1, 1, 1, 1, [b"\xaa\x80\x55\x00"]),
    (4, 3, 1, 8, 32773, 1, [b"\xfd\x07" + b"\x07" + GREY[:8]]),
    (4, 3, 1, 8, 5, 1, [b"LZW data"]),
]


@pytest.mark.parametrize("order", ["<", ">"])
def test_frames_are_pages(order):
    """Frame k is page k + 1, frames without text are no pages, and each frame is seen alone."""
    seen = []

    def vision(data, kind):
        seen.append((kind, data))
        return "" if len(seen) == 2 else f"frame {len(seen)}"

    assert parse(build(FRAMES, order), "scan.TIFF", vision) == [(k, f"frame {k}", None) for k in (1, 3, 4, 5, 6)]
    bits = bytes(255 * int(b) for b in "101010101" + "010101010")
    want = [tiff.png(4, 3, 1, GREY), tiff.png(4, 3, 1, bytes(255 - x for x in GREY)), tiff.png(2, 2, 3, GREY), tiff.png(9, 2, 1, bits), tiff.png(4, 3, 1, b"\x07" * 4 + GREY[:8])]
    assert seen[:5] == [("image/png", w) for w in want]
    kind, alone = seen[5]
    assert kind == "image/tiff" and [t[259] for t, _, _ in tiff.directories(alone)] == [[5]]


def test_broken_files():
    for data in (b"", b"II", b"PNG-----", build(FRAMES)[:40]):
        with pytest.raises((ValueError, struct.error)):
            parse(data, "x.tif")
    loop = bytearray(build(FRAMES[:1]))
    loop[-4:] = loop[4:8]  # a directory that follows itself
    assert len(list(tiff.directories(bytes(loop)))) == 1
