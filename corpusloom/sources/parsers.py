"""File parsers: bytes of one file to pages, and their use over a table of files.

A parser is a function (content, name, vision) -> [(page, text, attachment name or None)].  ``vision`` turns an image's bytes and media
type into text; without a model it gives nothing, and images are left out.  Nothing is ever fetched from a network."""

from __future__ import annotations

import base64
import csv
import email
import email.policy
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Page = tuple[int, str, str | None]
Vision = Callable[[bytes, str], str]

# Tags that carry no text, tags that end a line, and XML name spaces of office files.
SKIPPED = {"script", "style", "nav", "footer", "header"}
LINE_TAGS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "section", "article"}
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "c": "http://schemas.openxmlformats.org/drawingml/2006/chart",
    "s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "xdr": "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}
#: Kinds of charts by precedence, the labels of a chart's text, the head lines of a message.
CHARTS = ["barChart", "lineChart", "pieChart", "scatterChart", "areaChart", "doughnutChart", "radarChart", "bubbleChart"]
CHART_LABELS = {"title": "Chart: ", "series": "Series: ", "table": "Data", "list": "Values", "columns": ["Category", "Value"]}
EMAIL_HEAD = ["From", "Date", "Subject"]
IMAGES = {"png", "jpg", "jpeg", "gif", "webp", "bmp"}


def blind(_: bytes, __: str) -> str:
    return ""


def media_type(extension: str) -> str:
    e = extension.lower()
    return "image/jpeg" if e in ("jpg", "jpeg") else f"image/{e}"


def markdown(rows: list[list[str]]) -> str:
    """A table with its first row as head; "" without rows."""
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def _image(data: bytes, kind: str, vision: Vision) -> list[str]:
    try:
        text = vision(data, kind)
    except Exception:  # a model's failure costs one image, not the file
        return []
    return [f"[Image]\n{text}"] if text.strip() else []


class _Collector(HTMLParser):
    """Text, tables and images of a page in document order.  Unclosed tags need no care: only tables and skipped tags nest."""

    def __init__(self, skipped: set[str], images: dict[str, tuple[bytes, str]], vision: Vision):
        super().__init__(convert_charrefs=True)
        self.skipped, self.images, self.vision = skipped, images, vision
        self.parts: list[str] = []
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.depth = 0
        self.rows: list[list[list[str]]] = []
        self.cell = False

    def flush(self) -> None:
        t = "".join(self.text).strip()
        self.text.clear()
        if t:
            self.parts.append(t)

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.flush()
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag == "table":
            self.flush()
            self.depth += 1
            if self.depth == 1:
                self.rows = []
        elif self.depth:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append([])
        else:
            self.flush()
            if tag == "img":
                self._picture(dict(attrs).get("src") or "")
            elif tag == "br":
                self.parts.append("")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                rows = [["".join(c) for c in r] for r in self.rows if r]
                if rows:
                    self.parts.append("[Table]\n" + markdown(rows))
        elif not self.depth:
            self.flush()
            if tag in LINE_TAGS:
                self.parts.append("")

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.depth:
            self.text.append(data)
        elif self.rows and self.rows[-1]:
            self.rows[-1][-1].append(data.strip())

    def _picture(self, src: str) -> None:
        src = src.strip()
        if src.startswith("cid:") and src[4:] in self.images:
            self.parts += _image(*self.images[src[4:]], self.vision)
        elif m := re.match(r"data:(image/[\w.+-]+);base64,(.*)", src, re.S):
            try:
                self.parts += _image(base64.b64decode(m[2]), m[1], self.vision)
            except ValueError:
                pass


def html_text(html: str, vision: Vision = blind, skipped: set[str] = SKIPPED, images: dict | None = None) -> str:
    c = _Collector(skipped, images or {}, vision)
    c.feed(html)
    c.close()
    c.flush()
    return "\n".join(x for x in "\n".join(c.parts).splitlines() if x.strip())


def parse_html(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    text = html_text(content.decode("utf-8", "ignore"), vision)
    return [(1, text, None)] if text else []


def parse_text(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    text = content.decode("utf-8", "replace").strip()
    return [(1, text, None)] if text else []


def parse_csv(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    """One markdown page; the delimiter is found out, the encoding is UTF-8 or else Latin-1."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    try:
        dialect = csv.Sniffer().sniff(text[:65536], ",\t;|")
    except csv.Error:
        dialect = csv.excel
    rows = [r for r in csv.reader(io.StringIO(text), dialect) if r]
    return [(1, markdown(rows), None)] if rows else []


def parse_image(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    text = vision(content, media_type(os.path.splitext(name)[1].lstrip(".")))
    return [(1, text, None)] if text.strip() else []


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _written(e: ET.Element | None, tag: str) -> list[str]:
    """Texts of the elements of this name below an element."""
    return [t for x in (e.iter() if e is not None else ()) if _local(x) == tag and (t := (x.text or "").strip())]


def _cache(e: ET.Element | None) -> dict[int, str]:
    """A series' cached points by their index; a point without one stands in its place."""
    points = [x for x in e.iter() if _local(x) == "pt"] if e is not None else []
    return {int(x.get("idx", k)): v[0] for k, x in enumerate(points) if (v := _written(x, "v"))}


def _series_text(series: ET.Element) -> str:
    """A table where points have a category, else a list; empty without values."""
    parts = {_local(x): x for x in series}
    name = (_written(parts.get("tx"), "t") or _written(parts.get("tx"), "v"))[:1]
    labels, values = _cache(parts.get("cat")), _cache(parts.get("val")) or _cache(parts.get("yVal"))
    if not values:
        return ""
    head = CHART_LABELS["series"] + name[0] if name else CHART_LABELS["table" if labels else "list"]
    if labels:
        return head + "\n" + markdown([CHART_LABELS["columns"], *([labels[k], values[k]] for k in sorted(labels.keys() & values.keys()))])
    return head + ": " + ", ".join(values[k] for k in sorted(values))


def chart_text(xml: bytes) -> str:
    """Title or kind of a chart, then its series, each by its cached points."""
    root = ET.fromstring(xml)
    parts: dict[str, list[ET.Element]] = {}
    for e in root.iter():
        parts.setdefault(_local(e), []).append(e)
    titles = [t for tag in ("t", "v") for e in parts.get("title", ()) for t in _written(e, tag)]
    kinds = [k for k in CHARTS if k in parts]
    head = CHART_LABELS["title"] + " ".join(titles) if titles else kinds[0].replace("Chart", " Chart").title() if kinds else ""
    return "\n\n".join(t for t in (head, *map(_series_text, parts.get("ser", ()))) if t)


class _Package:
    """An office file: parts and the targets of their relations."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, part: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(part)) if part in self.names else None

    def relations(self, part: str) -> dict[str, str]:
        folder, base = os.path.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        found = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            found[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else os.path.normpath(f"{folder}/{target}")
        return found

    def drawing(self, element: ET.Element, relations: dict[str, str], vision: Vision) -> list[str]:
        """Images and charts below an element."""
        out = []
        for blip in element.iter(f"{{{NS['a']}}}blip"):
            part = relations.get(blip.get(f"{{{NS['r']}}}embed", ""))
            if part in self.names:
                out += _image(self.zip.read(part), media_type(part.rsplit(".", 1)[-1]), vision)
        for chart in element.iter(f"{{{NS['c']}}}chart"):
            part = relations.get(chart.get(f"{{{NS['r']}}}id", ""))
            if part in self.names and (text := chart_text(self.zip.read(part))).strip():
                out.append(f"[Chart]\n{text}")
        return out


def _w(tag: str) -> str:
    return f"{{{NS['w']}}}{tag}"


def _paragraph(p: ET.Element) -> str:
    """A paragraph's own text; that of text boxes is not its own."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        for x in e:
            if x.tag in (_w("drawing"), _w("pict")):
                continue
            if x.tag == _w("t"):
                out.append(x.text or "")
            elif x.tag == _w("tab"):
                out.append("\t")
            elif x.tag in (_w("br"), _w("cr")):
                out.append("\n")
            else:
                walk(x)

    walk(p)
    return "".join(out).strip()


def parse_docx(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    """Headers, then the body in order with tables, text boxes, charts and images, then footers, as one page."""
    pkg = _Package(content)
    main = "word/document.xml"
    root, relations = pkg.xml(main), pkg.relations(main)

    def edge(kind: str) -> list[str]:
        seen: list[str] = []
        for ref in root.iter(_w(f"{kind}Reference")):
            part = pkg.xml(relations.get(ref.get(f"{{{NS['r']}}}id", ""), ""))
            text = "\n".join(t for t in map(_paragraph, part.iter(_w("p"))) if t) if part is not None else ""
            if text and text not in seen:
                seen.append(text)
        return [f"[{kind.title()}]\n{t}" for t in seen]

    parts = edge("header")
    body = root.find("w:body", NS)
    for e in body if body is not None else ():
        if e.tag == _w("p"):
            if text := _paragraph(e):
                parts.append(text)
            for d in e.iter(_w("drawing")):
                boxes = [[t for t in map(_paragraph, b.iter(_w("p"))) if t] for b in d.iter(_w("txbxContent"))]
                parts += ["[Text box]\n" + "\n".join(b) for b in boxes if b] + pkg.drawing(d, relations, vision)
        elif e.tag == _w("tbl"):
            rows = [["\n".join(map(_paragraph, c.findall("w:p", NS))).strip() for c in r.findall("w:tc", NS)] for r in e.findall("w:tr", NS)]
            if table := markdown([r for r in rows if r]):
                parts.append(f"[Table]\n{table}")
    parts += edge("footer")
    return [(1, "\n\n".join(parts), None)] if parts else []


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _filled(rows: list[list[str]]) -> list[list[str]]:
    """Empty cells take the value above, then the value to the left."""
    for i, row in enumerate(rows):
        for j, cell in enumerate(row):
            if cell == "" and i:
                row[j] = rows[i - 1][j]
    for row in rows:
        for j in range(1, len(row)):
            if row[j] == "":
                row[j] = row[j - 1]
    return rows


def _sheet_text(name: str, table: dict[int, dict[int, str]], anchored: list[tuple[int, str]]) -> str:
    """A sheet of two rows or more as a table; texts anchored to a row stand after it, the others at the end."""
    width = 1 + max(max(r) for r in table.values())
    at = sorted(table)
    rows = [[table[i].get(j, "") for j in range(width)] for i in at]
    lines = markdown([rows[0], *_filled(rows[1:])]).split("\n")
    out, last = lines[:2], at[-1]
    for k, line in zip(at[1:], lines[2:], strict=True):
        out += [line, *("\n" + t for r, t in anchored if r == k)]
    tail = [t for r, t in anchored if r > last or r not in at[1:] and r <= last]
    return "\n\n".join([f"Sheet: {name}", "\n".join(out), *tail])


def parse_excel(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    """A page for each sheet that has rows; images and charts of xlsx files stand after the row they are anchored to.  Both formats, told apart
    by their first bytes."""
    from corpusloom.sources import xls

    if content.startswith(xls.SIGNATURE):
        return [(number, _sheet_text(sheet, table, []), None) for number, sheet, table in xls.sheets(content) if len(table) > 1]
    try:
        pkg = _Package(content)
    except zipfile.BadZipFile as e:
        raise ValueError(f"not an xlsx or xls file: {name}") from e
    strings = pkg.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in s.iter(f"{{{NS['s']}}}t")) for s in strings] if strings is not None else []
    book, links = pkg.xml("xl/workbook.xml"), pkg.relations("xl/workbook.xml")
    pages: list[Page] = []
    for number, sheet in enumerate(book.iter(f"{{{NS['s']}}}sheet"), 1):
        part = links.get(sheet.get(f"{{{NS['r']}}}id", ""), "")
        root = pkg.xml(part)
        table: dict[int, dict[int, str]] = {}
        for i, row in enumerate(root.iter(f"{{{NS['s']}}}row") if root is not None else ()):
            at = int(row.get("r", i + 1)) - 1
            for j, c in enumerate(row.findall("s:c", NS)):
                v = c.find("s:v", NS)
                value = "".join(t.text or "" for t in c.iter(f"{{{NS['s']}}}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                table.setdefault(at, {})[_column(c.get("r", "")) if c.get("r") else j] = shared[int(value)] if c.get("t") == "s" and value else value
        if len(table) < 2:
            continue
        anchored: list[tuple[int, str]] = []
        relations = pkg.relations(part)
        for target in (t for t in relations.values() if "drawings/" in t and t in pkg.names):
            inner = pkg.relations(target)
            for tag in ("twoCellAnchor", "oneCellAnchor"):
                for a in pkg.xml(target).iter(f"{{{NS['xdr']}}}{tag}"):
                    row = a.findtext("xdr:from/xdr:row", "0", NS)
                    anchored += [(int(row), t) for t in pkg.drawing(a, inner, vision)]
        anchored.sort(key=lambda x: x[0])
        pages.append((number, _sheet_text(sheet.get("name"), table, anchored), None))
    return pages


def _parts(part: EmailMessage) -> Iterator[tuple[str, EmailMessage]]:
    """("file" or the content type, part) of a message's leaves in reading order; a file is a leaf, whatever it holds."""
    if part.is_attachment():
        yield "file", part
    elif part.is_multipart():
        for inner in part.iter_parts():
            yield from _parts(inner)
    else:
        yield part.get_content_type(), part


def _file_pages(part: EmailMessage, vision: Vision) -> list[Page]:
    """Pages of an attached file under its name; none if it has no name or cannot be parsed."""
    name = part.get_filename()
    try:
        content = part.get_payload(0).as_bytes() if part.is_multipart() else part.get_payload(decode=True)
        return [(page, text, name) for page, text, _ in parse(content or b"", name, vision)] if name else []
    except Exception:  # the message itself is still good
        return []


def parse_email(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    """Head lines and bodies as one page, then the pages of the attachments; one that fails costs only itself."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    leaves = list(_parts(message))
    pictures = {p["Content-ID"].strip("<>"): (p.get_payload(decode=True) or b"", p.get_content_type()) for _, p in leaves if p["Content-ID"] and p.get_content_maintype() == "image"}
    read = {"text/plain": lambda p: p.get_content(), "text/html": lambda p: html_text(p.get_content(), vision, {"script", "style"}, {k: v for k, v in pictures.items() if v[0]})}
    head = [f"{h}: {message.get(h, '')}" for h in EMAIL_HEAD]
    bodies = [t for kind, p in leaves if kind in read and ((t := read[kind](p)) or kind == "text/plain")]
    files = [page for kind, p in leaves if kind == "file" for page in _file_pages(p, vision)]
    return [(1, "\n".join(head) + "\n\n" + "\n".join(bodies), None), *files]


def _tiff(content: bytes, name: str = "", vision: Vision = blind) -> list[Page]:
    from corpusloom.sources.tiff import parse_tiff

    return parse_tiff(content, name, vision)


#: Parser of each extension; ``read_files`` sends PDF files to ``sources.pdf``.
PARSERS: dict[str, Callable[[bytes, str, Vision], list[Page]]] = {
    ".html": parse_html, ".htm": parse_html, ".csv": parse_csv, ".txt": parse_text, ".docx": parse_docx, ".xlsx": parse_excel, ".xls": parse_excel, ".eml": parse_email,
    ".tif": _tiff, ".tiff": _tiff, **{f".{e}": parse_image for e in sorted(IMAGES)},
}


def parse(content: bytes, name: str, vision: Vision = blind) -> list[Page]:
    extension = os.path.splitext(name)[1].lower()
    if extension not in PARSERS:
        raise ValueError(f"unsupported file type {extension!r}; supported: {', '.join(sorted(PARSERS))}")
    return PARSERS[extension](content, name, vision)


def parse_files(files: DataFrame, vision: Vision = blind, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, content binary, *keep) to (path, *keep, page int, text, source_attachment, error): a row a page, or one row with the error
    of a file that cannot be parsed or has no page."""
    import pyarrow as pa

    rows = files.select("path", "content", *keep)
    names = ["path", *keep, "page", "text", "source_attachment", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            for i, (path, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                try:
                    pages = [(*p, None) for p in parse(content or b"", path or "", vision)] or [(None, None, None, "no pages")]
                except Exception as e:  # the file's error is its result
                    pages = [(None, None, None, f"{type(e).__name__}: {e}")]
                found += pages
                at += [i] * len(pages)
            cols = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            own = [batch.column(k).take(pa.array(at, pa.int32())) for k in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    schema = rows.drop("content").schema.add("page", "integer").add("text", "string").add("source_attachment", "string").add("error", "string")
    return rows.mapInArrow(run, schema)


def read_files(spark, path: str, vision: Vision = blind, most_bytes: int = 512 << 20) -> DataFrame:
    """Pages of all files below a path; a longer file is not parsed, and its one row has an error that tells its size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.when(F.col("length") <= most_bytes, F.col("content"))
    from corpusloom.sources.pdf import pdf_pages

    own = files.select("path", small.alias("content"), F.sha2("content", 256).alias("file_hash"), "length")
    is_pdf, keep = F.endswith(F.lower("path"), F.lit(".pdf")), ("file_hash", "length")
    rows = parse_files(own.where(~is_pdf), vision, keep)
    rows = rows.unionByName(pdf_pages(own.where(is_pdf), vision, keep), allowMissingColumns=True)
    long = F.col("length") > most_bytes
    told = F.concat(F.lit("larger than most_bytes: "), F.col("length").cast("string"), F.lit(f" of {most_bytes} bytes"))
    return rows.withColumn("error", F.when(long, told).otherwise(F.col("error"))).drop("length")
