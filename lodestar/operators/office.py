"""Office, delimited and JSON documents as Markdown.

Containers are read with the standard library inside one Arrow UDF over binary rows (``spark.read.format("binaryFile")``).
A document that can't be read gives a message in italics, never an error.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html as pages

MAX_ROWS, MAX_COLS, CSV_ROWS = 200, 30, 500
MAX_EPUB = 150_000
TEXT_ENDINGS = ("ini", "log", "markdown", "md", "rst", "tex", "toml", "txt", "xml", "yaml", "yml")


def kind_of(content_type: Column, name: Column) -> Column:
    """The kind of a document by its content type, or else the ending of its name."""
    ct = F.trim(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    ext = F.regexp_extract(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[?#].*$", ""), r"\.([a-z0-9]{1,5})$", 1)
    has = lambda s: F.contains(ct, F.lit(s))
    return (
        F.when((ct == "application/pdf") | (ext == "pdf"), "pdf")
        .when(has("wordprocessingml") | (ct == "application/msword") | (ext == "docx"), "docx")
        .when(has("spreadsheetml") | (ct == "application/vnd.ms-excel") | (ext == "xlsx"), "xlsx")
        .when(has("presentationml") | (ct == "application/vnd.ms-powerpoint") | (ext == "pptx"), "pptx")
        .when((ct == "application/epub+zip") | (ext == "epub"), "epub")
        .when((ct == "application/vnd.oasis.opendocument.text") | (ext == "odt"), "odt")
        .when((ct == "text/csv") | (ext == "csv"), "csv")
        .when((ct == "application/json") | F.endswith(ct, F.lit("+json")) | (ext == "json"), "json")
        .when(ct.isin("text/html", "application/xhtml+xml") | ext.isin("html", "htm", "xhtml"), "html")
        .when(F.startswith(ct, F.lit("text/")) | ext.isin(*TEXT_ENDINGS), "text")
        .otherwise("unknown")
    )


def sniff_zip(data: bytes) -> str:
    """The kind of a container by the names of its parts."""
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, OSError):
        return "unknown"
    if "word/document.xml" in names:
        return "docx"
    for prefix, kind in (("xl/worksheets/", "xlsx"), ("ppt/slides/", "pptx")):
        if any(n.startswith(prefix) for n in names):
            return kind
    if "content.xml" in names:
        return "odt"
    return "epub" if "META-INF/container.xml" in names or any(n.endswith(".opf") for n in names) else "unknown"


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _xml(files: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(files.read(name))
    except (KeyError, ET.ParseError):
        return None


def _numbered(names: list[str], pattern: str) -> list[str]:
    """Names that match, by the number in them: slide 10 after slide 2."""
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(files: zipfile.ZipFile) -> str:
    root = _xml(files, "word/document.xml")
    if root is None:
        return "_DOCX archive has no word/document.xml._"

    def said(e: ET.Element) -> str:
        marks = {"tab": "\t", "br": "\n"}
        return "".join(x.text or "" if _local(x) == "t" else marks.get(_local(x), "") for x in e.iter())

    def flat(e: ET.Element) -> str:
        return re.sub(r"\n+", " ", said(e)).strip()

    def level(p: ET.Element) -> int:
        style = next((_attr(x, "val") or "" for x in _all(p, "pStyle")), None)
        if style is None:
            outline = next((_attr(x, "val") for x in _all(p, "outlineLvl")), None)
            return min(6, int(outline) + 1) if outline and outline.isdigit() else 0
        named = re.fullmatch(r"(?i)heading\s*(\d)", style)
        return 1 if style.lower() == "title" else min(6, int(named[1])) if named else 0

    out = []
    body = next(_all(root, "body"), root)
    for e in body:
        if _local(e) == "tbl":
            rows = [[" ".join(filter(None, map(flat, _all(c, "p")))) for c in r if _local(c) == "tc"] for r in _all(e, "tr")]
            out.append(pages.markdown_table(rows))
        elif _local(e) == "p" and (text := flat(e)):
            n = level(e)
            out.append("#" * n + " " + text if n else f"- {text}" if next(_all(e, "numPr"), None) is not None else text)
    core = _xml(files, "docProps/core.xml")
    title = next(((x.text or "").strip() for x in _all(core, "title")), "") if core is not None else ""
    if title and not any(title in b for b in out):
        out.insert(0, f"# {title}")
    return "\n\n".join(filter(None, out))


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(files: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    """Names and cells of a workbook's sheets in order."""
    shared = []
    if (root := _xml(files, "xl/sharedStrings.xml")) is not None:
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(root, "si")]
    targets = {}
    if (root := _xml(files, "xl/_rels/workbook.xml.rels")) is not None:
        targets = {_attr(r, "Id"): "xl/" + (_attr(r, "Target") or "").removeprefix("/xl/") for r in _all(root, "Relationship")}
    names = files.namelist()
    book = _xml(files, "xl/workbook.xml")
    listed = [(_attr(s, "name") or "Sheet", targets.get(_attr(s, "id") or "")) for s in _all(book, "sheet")] if book is not None else []
    listed = [(n, t) for n, t in listed if t in names]
    if not listed:
        listed = [(f"Sheet{i}", n) for i, n in enumerate(_numbered(names, r"xl/worksheets/sheet(\d+)\.xml"), 1)]
    out = []
    for name, target in listed:
        rows = []
        root = _xml(files, target)
        for row in _all(root, "row") if root is not None else ():
            cells: list[str] = []
            for c in _all(row, "c"):
                at = column_number(_attr(c, "r") or "") if _attr(c, "r") else len(cells)
                if at < 0 or at > 16_384:
                    continue
                value = next((v.text or "" for v in _all(c, "v")), "")
                kind = _attr(c, "t")
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _all(c, "t"))
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            rows.append(cells)
        out.append((name, rows))
    return out


def xlsx(files: zipfile.ZipFile, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> str:
    out = []
    for name, rows in sheets(files):
        filled = [r for r in rows if any(c.strip() for c in r)]
        part = [f"## {name}", pages.markdown_table([r[:max_cols] for r in filled[:max_rows]]) or "_(empty sheet)_"]
        wide = max((len(r) for r in filled), default=0)
        if len(filled) > max_rows or wide > max_cols:
            part.append(f"_Showing {min(len(filled), max_rows)} of {len(filled)} rows and {min(wide, max_cols)} of {wide} columns._")
        out.append("\n\n".join(part))
    return "\n\n".join(out)


def pptx(files: zipfile.ZipFile) -> str:
    out = []
    for i, name in enumerate(_numbered(files.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
        root = _xml(files, name)
        lines = ["".join(t.text or "" for t in _all(p, "t")).strip() for p in _all(root, "p")] if root is not None else []
        notes = _xml(files, f"ppt/notesSlides/notesSlide{re.search(r'(\d+)', name)[1]}.xml")
        said = [x for x in lines if x]
        part = [f"## Slide {i}", *said]
        if notes is not None and (more := [x for p in _all(notes, "p") if (x := "".join(t.text or "" for t in _all(p, "t")).strip()) and not x.isdigit()]):
            part.append("> " + " ".join(more))
        out.append("\n\n".join(part))
    return "\n\n".join(out)


def epub(files: zipfile.ZipFile) -> str:
    names = files.namelist()
    container = _xml(files, "META-INF/container.xml")
    opf = next((_attr(r, "full-path") for r in _all(container, "rootfile")), None) if container is not None else None
    opf = opf or next((n for n in names if n.endswith(".opf")), None)
    root = _xml(files, opf) if opf else None
    out, order = [], []
    if root is not None:
        folder = opf.rpartition("/")[0]
        hrefs = {_attr(i, "id"): "/".join(filter(None, (folder, _attr(i, "href")))) for i in _all(root, "item")}
        order = [hrefs.get(_attr(r, "idref")) for r in _all(root, "itemref")]
        if title := next(((t.text or "").strip() for t in _all(root, "title")), ""):
            out.append(f"# {title}")
    order = [n for n in order if n in names] or sorted(n for n in names if re.search(r"\.x?html?$", n))
    total = 0
    for name in order:
        md = pages.convert(files.read(name).decode("utf-8", "replace"), None, article=False)["markdown"]
        if len(md) < 40:
            continue
        out.append(md)
        total += len(md)
        if total > MAX_EPUB:
            break
    return "\n\n".join(out)


def odt(files: zipfile.ZipFile) -> str:
    root = _xml(files, "content.xml")
    if root is None:
        return "_ODT archive has no content.xml._"
    out = []

    def said(e: ET.Element) -> str:
        return " ".join("".join(e.itertext()).split())

    def visit(e: ET.Element, listed: bool) -> None:
        for x in e:
            name = _local(x)
            if name == "h" and said(x):
                n = _attr(x, "outline-level") or "1"
                out.append("#" * min(6, int(n) if n.isdigit() else 1) + " " + said(x))
            elif name == "p" and said(x):
                out.append(("- " if listed else "") + said(x))
            elif name == "table":
                out.append(pages.markdown_table([[said(c) for c in r if _local(c) == "table-cell"] for r in _all(x, "table-row")]))
            else:
                visit(x, listed or name == "list-item")

    visit(next(_all(root, "text"), root), False)
    return "\n\n".join(filter(None, out))


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"(\((?:\\.|[^\\()])*\)|\[(?:\\.|[^\]])*\])\s*T[jJ]|(T\*|Td|TD|')", re.S)


def pdf(data: bytes) -> str:
    """Texts shown by plain or deflated content streams in simple encodings; scans and subset fonts give a message."""
    out = []
    for head, body in _STREAM.findall(data):
        if b"/Image" in head or b"/FontFile" in head:
            continue
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body, 20_000_000)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        line: list[str] = []
        for shown, move in _SHOWN.findall(body):
            if move:
                line.append("\n")
            for part in re.findall(rb"\(((?:\\.|[^\\()])*)\)", shown, re.S):
                part = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), part)
                line.append(re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"t": b"\t", b"r": b""}.get(m[1], m[1]), part).decode("latin-1"))
        out.append("".join(line))
    text = clean_pdf("\n\n".join(out))
    return text or "_This PDF has no extractable text (it may be scanned)._"


def clean_pdf(text: str) -> str:
    text = re.sub(r"([A-Za-z])-\n([a-z])", r"\1\2", text.replace("\r\n", "\n"))
    text = re.sub(r"(?im)^\s*(page\s+)?\d{1,4}(\s*(/|of)\s*\d{1,4})?\s*$", "", text)
    text = re.sub(r"([a-z,;])\n([a-z(])", r"\1 \2", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", text)).strip()


def sniff_delimiter(text: str) -> str:
    """The most frequent of comma, tab, semicolon and bar in the first line."""
    line = text.split("\n", 1)[0]
    return max((",", "\t", ";", "|"), key=line.count) if any(d in line for d in ",\t;|") else ","


def delimited(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of cells. A quote opens a quoted part anywhere in a field; doubled quotes inside it stand for one."""
    text = text.removeprefix("﻿")
    d = delimiter or sniff_delimiter(text)
    rows, row, cell, quoted, i = [], [], [], False, 0
    pieces = re.compile(f'["\r\n{re.escape(d)}]')
    while i < len(text):
        m = re.compile('"').search(text, i) if quoted else pieces.search(text, i)
        if m is None:
            cell.append(text[i:])
            break
        cell.append(text[i : m.start()])
        i, c = m.end(), m[0]
        if quoted:
            if text[i : i + 1] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = False
        elif c == '"':
            quoted = True
        elif c == d:
            row.append("".join(cell))
            cell = []
        else:
            if c == "\r" and text[i : i + 1] == "\n":
                i += 1
            row.append("".join(cell))
            rows.append(row)
            row, cell = [], []
    if cell or row:
        row.append("".join(cell))
        rows.append(row)
    return [r for r in rows if r != [""]]


def csv_markdown(text: str, max_rows: int = CSV_ROWS, max_cols: int = MAX_COLS) -> str:
    rows = delimited(text)
    out = pages.markdown_table([r[:max_cols] for r in rows[: max_rows + 1]])
    return out + (f"\n\n_Showing {max_rows} of {len(rows) - 1} rows._" if len(rows) > max_rows + 1 else "")


def json_shape(value: object, depth: int = 3, most: int = 60) -> str:
    """The types of a value's parts, three levels deep."""
    if isinstance(value, dict):
        if depth == 0:
            return "{…}"
        shown = [f"{k}: {json_shape(v, depth - 1, most)}" for k, v in list(value.items())[:most]]
        return "{ " + ", ".join(shown + (["…"] if len(value) > most else [])) + " }"
    if isinstance(value, list):
        return f"Array({len(value)})" + (f" of {json_shape(value[0], depth - 1, most)}" if value and depth else "")
    return {str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")


def json_markdown(text: str, most: int = 100_000) -> str:
    """Pretty-printed; of a large value its shape and the beginning."""
    text = re.sub(r"^\)\]\}'?,?\s*", "", text)
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return f"```\n{text[:most]}\n```"
    pretty = json.dumps(value, indent=2, ensure_ascii=False)
    if len(pretty) <= most:
        return f"```json\n{pretty}\n```"
    return f"**Shape:** `{json_shape(value)}`\n\n```json\n{pretty[:most]}\n…\n```"


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "epub": epub, "odt": odt}


def parse(data: bytes | None, kind: str, most: int = 120_000) -> dict:
    """Markdown, title, kind, number of characters before cutting, whether it was cut, names of sheets and number of slides."""
    data = data or b""
    if kind == "unknown" and data[:2] == b"PK":
        kind = sniff_zip(data)
    if kind == "unknown" and data[:5] == b"%PDF-":
        kind = "pdf"
    names, slides = None, None
    if kind in READERS:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as files:
                md = READERS[kind](files)
                if kind == "xlsx":
                    names = [n for n, _ in sheets(files)]
                if kind == "pptx":
                    slides = len(_numbered(files.namelist(), r"ppt/slides/slide(\d+)\.xml"))
        except (zipfile.BadZipFile, OSError, ValueError, zlib.error) as error:
            md = f"_Could not read {kind.upper()} archive: {error}_"
    elif kind == "pdf":
        md = pdf(data)
    else:
        text = data.decode("utf-8", "replace")
        if kind == "unknown":
            head = text[:4000]
            printable = sum(c.isprintable() or c in "\n\r\t" for c in head if c != "�")
            kind = "text" if head and printable / len(head) > 0.9 else kind
        if kind == "text" and re.match(r"(?i)\s*<(!doctype|html)", text):
            kind = "html"
        if kind == "csv":
            md = csv_markdown(text)
        elif kind == "json":
            md = json_markdown(text)
        elif kind == "html":
            md = pages.convert(text)["markdown"]
        elif kind == "text":
            md = text
        else:
            md = "_Unsupported binary document._"
    md = pages.tidy(md)
    heading = re.search(r"(?m)^#{1,3}\s+(.{3,160})$", md)
    return {"markdown": md[:most], "title": heading[1].strip() if heading else None, "kind": kind, "chars": len(md), "truncated": len(md) > most, "sheets": names, "slides": slides}


DOCUMENT = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("chars", T.LongType()), T.StructField("truncated", T.BooleanType()), T.StructField("sheets", T.ArrayType(T.StringType())), T.StructField("slides", T.IntegerType())])


def document_of(most: int):
    """A function of a document's bytes and kind: struct<markdown, title, kind, ...>, with at most so many characters."""

    @F.pandas_udf(DOCUMENT)
    def read(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([parse(d, k, most) for d, k in zip(data, kind, strict=True)], columns=[f.name for f in DOCUMENT])
        return out.astype({"slides": "Int32"})

    return read


document = document_of(120_000)


def parse_documents(files: DataFrame, content: str = "content", name: str = "path", content_type: str | None = None, max_chars: int = 120_000) -> DataFrame:
    """Binary rows with a struct ``document`` of at most ``max_chars`` characters."""
    kind = kind_of(F.col(content_type) if content_type else F.lit(None).cast("string"), F.col(name))
    return files.withColumn("document", document_of(max_chars)(F.col(content), kind))


def read_files(spark, path: str, max_bytes: int = 100_000_000) -> DataFrame:
    """Files as documents, large ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= max_bytes)
    return parse_documents(files).drop("content")


def one_sheet(markdown: Column, sheet: str) -> Column:
    """The part of a workbook's Markdown under one sheet's heading, or null."""
    parts = F.split(markdown, r"\n(?=## )")
    return F.get(F.filter(parts, lambda x: F.substring_index(F.regexp_replace(x, "^## ", ""), "\n", 1) == sheet), F.lit(0))


def read_delimited(spark, path: str, delimiter: str = ",") -> DataFrame:
    """Large delimited files go to Spark's own reader: every cell a string."""
    return spark.read.option("sep", delimiter).option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
