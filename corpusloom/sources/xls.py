"""XLS files: the streams of a compound file, and the cells of a workbook's sheets as the texts that an xlsx file would hold.

Numbers, texts, truth values, errors and cached results of formulas are read.  Pictures and charts are not; workbooks before version 8 and
protected ones are errors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# A compound file's first bytes and sector marks, record types, texts of errors.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
LAST_SECTOR = 0xFFFFFFFA
BOF, EOF, SHEET, STRINGS, CONTINUE, PROTECTED = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C, 0x002F
NUMBER, RK, ROW_OF_RK, SHARED, LABEL, TRUTH, FORMULA, RESULT, BLANK, BLANKS = 0x0203, 0x027E, 0x00BD, 0x00FD, 0x0204, 0x0205, 0x0006, 0x0207, 0x0201, 0x00BE
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != SIGNATURE or len(data) < 512:
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, limit, first_small, first_more = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 68))
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    sector = lambda n: data[size * (n + 1) : size * (n + 2)]

    tables, more = numbers(data[76:512]), first_more
    for _ in range(len(data) // size):
        if more >= LAST_SECTOR:
            break
        *found, more = numbers(sector(more))
        tables += found
    following = [n for t in tables if t < LAST_SECTOR for n in numbers(sector(t))]

    def chain(first: int, links: list[int], part) -> bytes:
        out, seen, n = [], set(), first
        while n < LAST_SECTOR:
            if n in seen or n >= len(links):
                raise ValueError("broken chain of sectors")
            seen.add(n)
            out.append(part(n))
            n = links[n]
        return b"".join(out)

    entries = chain(first_dir, following, sector)
    found: dict[str, tuple[int, int, int]] = {}
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        if kind in (2, 5):
            name = entries[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            found.setdefault(name, (kind, *struct.unpack_from("<II", entries, at + 116)))
    root = next((v for v in found.values() if v[0] == 5), (5, LAST_SECTOR, 0))
    inner = chain(root[1], following, sector)
    links = numbers(chain(first_small, following, sector))
    part = lambda n: inner[small * n : small * (n + 1)]
    return {name: (chain(first, links, part) if n < limit else chain(first, following, sector))[:n] for name, (kind, first, n) in found.items() if kind == 2}


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, body and its continuations) from ``at`` to the end of that part of the workbook."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
        if kind == EOF:
            break
    if held:
        yield held


class _Texts:
    """Reads texts from a body whose continuations can begin within a text."""

    def __init__(self, bodies: list[bytes], at: int = 0):
        self.bodies, self.k, self.at = bodies, 0, at

    def raw(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.bodies[self.k]):
                self.k, self.at = self.k + 1, 0
            out += (got := self.bodies[self.k][self.at : self.at + n - len(out)])
            self.at += len(got)
        return out

    def text(self, width: str = "<H") -> str:
        left = struct.unpack(width, self.raw(struct.calcsize(width)))[0]
        flags = self.raw(1)[0]
        after = 4 * struct.unpack("<H", self.raw(2))[0] if flags & 8 else 0
        after += struct.unpack("<I", self.raw(4))[0] if flags & 4 else 0
        out = []
        while left:
            step = 2 if flags & 1 else 1
            here = self.bodies[self.k][self.at : self.at + left * step]
            here = here[: len(here) // step * step]
            if not here:
                # A continued text says anew how wide its characters are.
                self.k, self.at = self.k + 1, 1
                flags = self.bodies[self.k][0]
                continue
            out.append(here if step == 2 else here.decode("latin-1").encode("utf-16-le"))
            self.at += len(here)
            left -= len(here) // step
        self.raw(after)
        return b"".join(out).decode("utf-16-le", "replace")


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _short(b: bytes) -> str:
    """A number in 30 bits: the high bits of a double or an integer, perhaps in hundredths."""
    n = struct.unpack("<i", b)[0]
    x = float(n >> 2) if n & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", n & 0xFFFFFFFC))[0]
    return _number(x / 100 if n & 1 else x)


def _cells(stream: bytes, at: int, shared: list[str]) -> dict[int, dict[int, str]]:
    table: dict[int, dict[int, str]] = {}
    awaits: tuple[int, int] | None = None  # the formula whose text follows
    for kind, bodies in records(stream, at):
        b = bodies[0]
        if kind == RESULT and awaits:
            table[awaits[0]][awaits[1]] = _Texts(bodies).text()
        if kind not in (NUMBER, RK, ROW_OF_RK, SHARED, LABEL, TRUTH, FORMULA, BLANK, BLANKS):
            continue
        i, j = struct.unpack_from("<HH", b)
        row = table.setdefault(i, {})
        awaits = None
        if kind == NUMBER:
            row[j] = _number(struct.unpack_from("<d", b, 6)[0])
        elif kind == RK:
            row[j] = _short(b[6:10])
        elif kind == ROW_OF_RK:
            row |= {j + k: _short(b[6 + 6 * k : 10 + 6 * k]) for k in range((len(b) - 6) // 6)}
        elif kind == SHARED:
            row[j] = shared[struct.unpack_from("<I", b, 6)[0]]
        elif kind == LABEL:
            row[j] = _Texts(bodies, 6).text()
        elif kind == TRUTH:
            row[j] = ERRORS.get(b[6], "#N/A") if b[7] else str(b[6])
        elif kind == BLANK:
            row[j] = ""
        elif kind == BLANKS:
            row |= {j + k: "" for k in range((len(b) - 6) // 2)}
        elif b[12:14] != b"\xff\xff":
            row[j] = _number(struct.unpack_from("<d", b, 6)[0])
        else:
            row[j] = {1: str(b[8]), 2: ERRORS.get(b[8], "#N/A")}.get(b[6], "")
            awaits = (i, j) if b[6] == 0 else None
    return table


def sheets(content: bytes) -> Iterator[tuple[int, str, dict[int, dict[int, str]]]]:
    """(number from 1, name, cells by row and column) of each sheet of cells; sheets of charts have a number, but no cells."""
    found = streams(content)
    stream = found.get("Workbook")
    if stream is None:
        raise ValueError("no workbook of version 8 in this file, or a protected one")
    named: list[tuple[int, int, str]] = []
    shared: list[str] = []
    for n, (kind, bodies) in enumerate(records(stream)):
        if n == 0 and (kind != BOF or bodies[0][:2] != b"\x00\x06"):
            raise ValueError("not a workbook of version 8")
        if kind == PROTECTED:
            raise ValueError("a protected workbook")
        if kind == SHEET:
            named.append((struct.unpack_from("<I", bodies[0])[0], bodies[0][5], _Texts(bodies, 6).text("<B")))
        if kind == STRINGS:
            texts = _Texts(bodies, 8)
            shared = [texts.text() for _ in range(struct.unpack_from("<I", bodies[0], 4)[0])]
    for number, (at, kind, name) in enumerate(named, 1):
        yield number, name, _cells(stream, at, shared) if kind == 0 else {}
