"""XLS fixtures, made record by record, against the same cells as an xlsx file and as values."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest

from corpusloom.sources import parsers, xls

LONG = "Grüße, 表 " * 700  # beyond one record


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(s, width="<H"):
    wide = any(ord(c) > 255 for c in s)
    return struct.pack(width, len(s)) + bytes([wide]) + s.encode("utf-16-le" if wide else "latin-1")


def shared_strings(strings, most):
    """The table of strings cut into continuations of at most ``most`` bytes, within texts where it falls so; one text has runs of fonts."""
    out, body, kind = b"", struct.pack("<II", len(strings), len(strings)), xls.STRINGS
    for n, s in enumerate(strings):
        wide, runs = any(ord(c) > 255 for c in s), 2 if n == 1 else 0
        head = struct.pack("<HB", len(s), wide | 8 * bool(runs)) + (struct.pack("<H", runs) if runs else b"")
        if len(body) + len(head) + 2 > most:
            out, body, kind = out + record(kind, body), b"", xls.CONTINUE
        body += head
        units = s.encode("utf-16-le" if wide else "latin-1")
        while units:
            room = (most - len(body)) // (1 + wide) * (1 + wide)
            body, units = body + units[:room], units[room:]
            if units:
                out, body, kind = out + record(kind, body), bytes([wide]), xls.CONTINUE
        body += b"\1\0\2\0" * runs
    return out + record(kind, body)


def workbook(sheets, strings=(), most=8224, protected=False):
    """sheets: (name, kind, records)."""
    begin, end = lambda t: record(xls.BOF, struct.pack("<HHII", 0x600, t, 0, 0) + b"\0" * 4), record(xls.EOF)
    bodies = [begin(0x10) + b"".join(r) + end for _, _, r in sheets]
    heads = lambda at: b"".join(record(xls.SHEET, struct.pack("<IBB", a, 0, k) + text(n, "<B")) for a, (n, k, _) in zip(at, sheets, strict=True))
    front = begin(5) + (record(xls.PROTECTED, b"\0" * 6) if protected else b"")
    rest = shared_strings(strings, most) + end
    at, places = len(front + heads([0] * len(sheets)) + rest), []
    for b in bodies:
        places.append(at)
        at += len(b)
    return front + heads(places) + rest + b"".join(bodies)


def compound(stream, name="Workbook"):
    """A compound file of one stream, in small sectors below 4,096 bytes."""
    pad = lambda b, n: b + b"\0" * (-len(b) % n)
    entry = lambda n, kind, first, size: pad((n + "\0").encode("utf-16-le"), 64)[:64] + struct.pack("<HB", 2 * len(n) + 2, kind) + b"\0" * 49 + struct.pack("<IQ", first, size)
    small = len(stream) < 4096
    n = -(-len(stream) // 512)
    n_fat = -(-(n + 4) // 124)
    first = n_fat + 2
    fat = [0xFFFFFFFD] * n_fat + [0xFFFFFFFE] * 2 + [*range(first + 1, first + n), 0xFFFFFFFE]
    links = [*range(1, -(-len(stream) // 64)), 0xFFFFFFFE] if small else []
    root = entry("Root Entry", 5, first if small else 0xFFFFFFFE, len(stream) if small else 0)
    folder = pad(root + entry(name, 2, 0 if small else first, len(stream)), 512)
    header = xls.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", n_fat, n_fat, 0, 4096, n_fat + 1 if small else 0xFFFFFFFE, int(small), 0xFFFFFFFE, 0)
    header += struct.pack("<109I", *([*range(n_fat)] + [0xFFFFFFFF] * (109 - n_fat)))
    table = struct.pack(f"<{128 * n_fat}I", *(fat + [0xFFFFFFFF] * (128 * n_fat - len(fat))))
    mini = struct.pack("<128I", *(links + [0xFFFFFFFF] * (128 - len(links))))
    return header + table + folder + mini + pad(stream, 512)


def cell(kind, i, j, body=b""):
    return record(kind, struct.pack("<HHH", i, j, 0) + body)


def rk(x, hundredths=False):
    return struct.pack("<i", (x << 2) | 2 | hundredths)


STRINGS = ["name", "quality", LONG, "x", ""]
CELLS = [
    cell(xls.SHARED, 0, 0, struct.pack("<I", 0)), cell(xls.SHARED, 0, 1, struct.pack("<I", 1)), cell(xls.NUMBER, 2, 0, struct.pack("<d", 7.0)), cell(xls.SHARED, 2, 1, struct.pack("<I", 3)),
    cell(xls.BLANK, 3, 0), cell(xls.RK, 3, 1, rk(8)), cell(xls.FORMULA, 5, 0, b"\0" * 6 + b"\xff\xff" + b"\0" * 8), record(xls.RESULT, text("é made")), cell(xls.SHARED, 5, 1, struct.pack("<I", 2)),
    record(xls.ROW_OF_RK, struct.pack("<HH", 6, 0) + b"\0\0" + rk(-3) + b"\0\0" + rk(125, True) + struct.pack("<H", 1)), cell(xls.TRUTH, 7, 0, b"\1\0"), cell(xls.TRUTH, 7, 1, b"\x07\1"),
    cell(xls.FORMULA, 8, 0, struct.pack("<d", 0.1) + b"\0" * 8), cell(xls.FORMULA, 8, 1, b"\1\0\1\0\0\0\xff\xff" + b"\0" * 8), cell(xls.LABEL, 9, 0, text("表")), cell(xls.RK, 9, 1, struct.pack("<I", struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32)),
    cell(xls.FORMULA, 10, 0, b"\3\0\0\0\0\0\xff\xff" + b"\0" * 8), cell(xls.FORMULA, 10, 1, b"\2\0\x2a\0\0\0\xff\xff" + b"\0" * 8), record(xls.BLANKS, struct.pack("<HHHHH", 11, 0, 0, 0, 1)),
]
WANT = {
    0: {0: "name", 1: "quality"}, 2: {0: "7", 1: "x"}, 3: {0: "", 1: "8"}, 5: {0: "é made", 1: LONG}, 6: {0: "-3", 1: "1.25"}, 7: {0: "1", 1: "#DIV/0!"}, 8: {0: "0.1", 1: "1"},
    9: {0: "表", 1: "1.5"}, 10: {0: "", 1: "#N/A"}, 11: {0: "", 1: ""},
}


@pytest.mark.parametrize("most", [8224, 61, 60, 37])
def test_cells(most):
    """Texts are cut by continuations at even and odd places."""
    book = workbook([("Data", 0, CELLS), ("Chart", 2, []), ("Ünï", 0, CELLS[:2])], STRINGS, most)
    assert list(xls.sheets(compound(book))) == [(1, "Data", WANT), (2, "Chart", {}), (3, "Ünï", {0: WANT[0]})]


def test_small_and_large_files_equal_xlsx():
    few = CELLS[:6]
    small, large = (compound(workbook([("Data", 0, few), ("One row", 0, few[:2])], [*STRINGS[:2], s, "x"])) for s in ("short", LONG))
    assert len(small) < len(large)
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="B1" t="inlineStr"><is><t>quality</t></is></c></row><row r="3"><c r="A3"><v>7</v></c><c r="B3" t="inlineStr"><is><t>x</t></is></c></row><row r="4"><c r="A4"/><c r="B4"><v>8</v></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    want = parsers.parse(out.getvalue(), "a.xlsx")
    assert len(want) == 1 and parsers.parse(small, "a.XLS") == parsers.parse(large, "a.xls") == want == parsers.parse(out.getvalue(), "named.xls")


def test_broken_files_are_one_error_each(spark, tmp_path):
    good = compound(workbook([("Data", 0, CELLS)], STRINGS))
    files = {"good": good, "cut": good[:3000], "none": compound(b"\0" * 5000, "Other"), "old": compound(record(xls.BOF, b"\0\5\5\0") + record(xls.EOF)), "locked": compound(workbook([], protected=True)), "text": b"a,b"}
    loop = bytearray(good)
    struct.pack_into("<I", loop, 512 + 4 * 4, 3)  # a sector that leads back
    files["loop"] = bytes(loop)
    for name, data in files.items():
        (tmp_path / f"{name}.xls").write_bytes(data)
    rows = {r["path"].split("/")[-1][:-4]: r for r in parsers.read_files(spark, str(tmp_path)).collect()}
    assert len(rows) == len(files) and rows["good"]["error"] is None and rows["good"]["text"].startswith("Sheet: Data\n\n| name | quality |")
    assert all(r["error"] and r["text"] is None for name, r in rows.items() if name != "good")
    assert "version 8" in rows["old"]["error"] and "protected" in rows["locked"]["error"] and "chain" in rows["loop"]["error"]
