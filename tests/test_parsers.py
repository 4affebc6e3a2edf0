from __future__ import annotations

import io
import zipfile

import pytest

from corpusloom.sources import parsers as p

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
CHART = """<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><c:chart>
<c:title><c:tx><c:rich><a:t>Sales</a:t></c:rich></c:tx></c:title><c:barChart><c:ser><c:tx><c:v>2024</c:v></c:tx><c:cat><c:pt><c:v>Q1</c:v></c:pt><c:pt><c:v>Q2</c:v></c:pt></c:cat>
<c:val><c:pt><c:v>5</c:v></c:pt><c:pt><c:v>7</c:v></c:pt></c:val></c:ser></c:barChart></c:chart></c:chartSpace>"""


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def see(data: bytes, kind: str) -> str:
    return f"{kind}:{len(data)}"


def test_html():
    html = """<html><head><style>x{}</style><script>var t="</p>";</script></head><body><nav>menu</nav><p>One <b>two</b><p>Three &amp; four<br>five
    <table><tr><th>a</th><td> b </td></tr><tr><td>1</td><td>2</td></tr></table><img src="data:image/png;base64,AAAA"><footer>end</footer></body></html>"""
    assert p.html_text(html, see) == "One\ntwo\nThree & four\nfive\n[Table]\n| a | b |\n| --- | --- |\n| 1 | 2 |\n[Image]\nimage/png:3"
    assert p.parse_html(b"<p> </p>") == []


def test_csv():
    assert p.parse_csv("﻿a;b\n1;x,y\n".encode()) == [(1, "| a | b |\n| --- | --- |\n| 1 | x,y |", None)]
    assert "é" in p.parse_csv("a,b\n1,é\n".encode("latin-1"))[0][1]
    assert p.parse_csv(b"") == []


def test_chart():
    assert p.chart_text(CHART.encode()) == "Chart: Sales\n\nSeries: 2024\n| Category | Value |\n| --- | --- |\n| Q1 | 5 |\n| Q2 | 7 |"


def test_docx():
    body = f"""<w:document {W}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
    <w:p><w:r><w:drawing><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r><w:r><w:drawing><a:blip r:embed="i"/><c:chart r:id="c"/></w:drawing></w:r></w:p>
    <w:sectPr><w:headerReference r:id="h"/><w:headerReference r:id="h"/><w:footerReference r:id="f"/></w:sectPr></w:body></w:document>"""
    rels = f'<Relationships {REL}>' + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in (("h", "header1.xml"), ("f", "footer1.xml"), ("i", "media/i.jpg"), ("c", "charts/c.xml"))) + "</Relationships>"
    edge = lambda t: f"<w:hdr {W}><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:hdr>"
    content = zipped({"word/document.xml": body, "word/_rels/document.xml.rels": rels, "word/header1.xml": edge("top"), "word/footer1.xml": edge("bottom"), "word/media/i.jpg": b"12345", "word/charts/c.xml": CHART})
    assert p.parse(content, "x.DOCX", see)[0][1] == (
        "[Header]\ntop\n\nHello world\n\n[Table]\n| h |\n| --- |\n| v |\n\n[Text box]\nboxed\n\n[Image]\nimage/jpeg:5\n\n[Chart]\n" + p.chart_text(CHART.encode()) + "\n\n[Footer]\nbottom"
    )


def xlsx(rows: str, drawing: bool = False) -> bytes:
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Data" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si><si><r><t>qu</t></r><r><t>ality</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": f"<worksheet {s}><sheetData/></worksheet>",
    }
    if drawing:
        x = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" ' + W
        anchor = lambda row: f'<xdr:twoCellAnchor><xdr:from><xdr:row>{row}</xdr:row></xdr:from><c:chart r:id="c"/></xdr:twoCellAnchor>'
        parts |= {
            "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {REL}><Relationship Id="d" Target="../drawings/drawing1.xml"/></Relationships>',
            "xl/drawings/drawing1.xml": f"<xdr:wsDr {x}>{anchor(1)}{anchor(40)}</xdr:wsDr>",
            "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships {REL}><Relationship Id="c" Target="../charts/chart1.xml"/></Relationships>',
            "xl/charts/chart1.xml": CHART,
        }
    return zipped(parts)


ROWS = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="B3"><v>8</v></c></row>'


def test_excel_fills_down_then_right():
    assert p.parse_excel(xlsx(ROWS)) == [(1, "Sheet: Data\n\n| name | quality |\n| --- | --- |\n| 7 | x |\n| 7 | 8 |", None)]


def test_excel_charts_stand_at_their_rows():
    text = p.parse_excel(xlsx(ROWS, True))[0][1]
    assert text.index("| 7 | x |") < text.index("[Chart]") < text.index("| 7 | 8 |") < text.rindex("[Chart]")
    with pytest.raises(ValueError):
        p.parse_excel(b"no zip")


def test_email():
    raw = b"""From: a@b.c
Date: Mon, 1 Jan 2024 00:00:00 +0000
Subject: Hi
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="X"

--X
Content-Type: text/plain

plain
--X
Content-Type: text/html

<p>rich</p><img src="cid:pic"><style>s</style>
--X
Content-Type: image/png
Content-ID: <pic>
Content-Transfer-Encoding: base64

AAAA
--X
Content-Type: text/csv
Content-Disposition: attachment; filename="t.csv"

a,b
1,2
--X
Content-Type: application/x-unknown
Content-Disposition: attachment; filename="t.unknown"

zzz
--X--
"""
    pages = p.parse(raw, "m.eml", see)
    assert pages[0][1].startswith("From: a@b.c\nDate: Mon, 01 Jan 2024 00:00:00 +0000\nSubject: Hi\n\nplain") and pages[0][1].endswith("rich\n[Image]\nimage/png:3")
    assert pages[1:] == [(1, "| a | b |\n| --- | --- |\n| 1 | 2 |", "t.csv")]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hi</p>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.xlsx").write_bytes(b"broken")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in p.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.html"]["text"] == "hi" and rows["b.csv"]["text"].startswith("| x | y |")
    assert "not a PDF file" in rows["c.pdf"]["error"] and "ValueError" in rows["d.xlsx"]["error"]


def test_file_beyond_the_size_has_its_own_error(spark, tmp_path):
    (tmp_path / "long.txt").write_text("some words " * 10)
    (tmp_path / "short.txt").write_text("some words")
    (tmp_path / "blank.txt").write_text(" ")
    got = {r["path"].rsplit("/", 1)[1]: r for r in p.read_files(spark, str(tmp_path), most_bytes=50).collect()}
    assert got["long.txt"]["error"] == "larger than most_bytes: 110 of 50 bytes" and got["long.txt"]["text"] is None
    assert got["short.txt"]["error"] is None and "most_bytes" not in (got["blank.txt"]["error"] or "")
    assert got["long.txt"].__fields__ == ["path", "file_hash", "page", "text", "source_attachment", "error"]


def test_chart_points_stand_by_their_index():
    """A value without a category, or the other way round, does not shift the rest; scatter charts have no categories."""
    head = '<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:plotArea><c:lineChart/><c:barChart><c:ser>'
    tail = "</c:ser></c:barChart></c:plotArea></c:chartSpace>"
    point = lambda i, v: f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>'
    gaps = f"<c:cat>{point(0, 'a')}{point(1, 'b')}{point(2, 'c')}</c:cat><c:val>{point(0, 1)}{point(2, 3)}</c:val>"
    assert p.chart_text((head + gaps + tail).encode()) == "Bar Chart\n\nData\n| Category | Value |\n| --- | --- |\n| a | 1 |\n| c | 3 |"
    assert p.chart_text((head + f"<c:yVal>{point(0, 4)}{point(1, 5)}</c:yVal>" + tail).encode()) == "Bar Chart\n\nValues: 4, 5"
    assert p.chart_text((head + tail).encode()) == "Bar Chart"


def test_attached_message_is_a_file():
    inner = b"From: x@y.z\nSubject: In\nContent-Type: text/plain\n\ninside\n"
    raw = b'From: a@b.c\nSubject: Out\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="X"\n\n--X\nContent-Type: text/plain\n\nouter\n--X\nContent-Type: message/rfc822\nContent-Disposition: attachment; filename="in.eml"\n\n' + inner + b"\n--X--\n"
    (_, text, none), (_, nested, file) = p.parse_email(raw)
    assert "outer" in text and "inside" not in text and none is None
    assert "Subject: In" in nested and "inside" in nested and file == "in.eml"
