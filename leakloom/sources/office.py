"""Blocks and text of docx, xlsx and pdf files, by the standard library alone.

A block is (block_no, type, level, section, text, rows). Files are parsed on the
executors, one in a row of a ``binaryFile`` scan; what can't be parsed gives a row with
an error and no block.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from leakloom.session import ship_package
from leakloom.sources.formats import ENCRYPTED, archive_kind
from leakloom.sources.pdf import Broken, pdf_pages

# The name spaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Built-in number formats that are dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
SCHEMA = "path string, format string, error string, blocks array<struct<block_no:int,type:string,level:int,section:int,text:string,rows:array<array<string>>>>"


class Unreadable(Exception):
    pass


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(archive.read(name))
    except KeyError as e:
        raise Unreadable(f"corrupted: no part {name}") from e
    except ElementTree.ParseError as e:
        raise Unreadable(f"corrupted: {name}") from e


def _links(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in archive.namelist():
        return {}
    return {x.get("Id"): (x.get("Target") if x.get("Target").startswith("/") else f"{folder}/{x.get('Target')}").lstrip("/") for x in _xml(archive, path).iter(f"{P}Relationship")}


def _opened(content: bytes, kind: str) -> zipfile.ZipFile:
    if content[:8] == ENCRYPTED:
        raise Unreadable("encrypted")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable("corrupted: not an archive") from e
    if archive_kind(content) != kind:
        raise Unreadable(f"corrupted: not {kind}")
    return archive


# --- docx ------------------------------------------------------------------------


def _paragraph(element: ElementTree.Element) -> str:
    out = []
    for node in element.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag == f"{W}tab":
            out.append("\t")
        elif node.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _table(element: ElementTree.Element) -> list[list[str]]:
    return [["\n".join(_paragraph(p) for p in cell.findall(f"{W}p")) for cell in row.findall(f"{W}tc")] for row in element.findall(f"{W}tr")]


def _level(element: ElementTree.Element, styles: dict[str, str]) -> int | None:
    style = element.find(f"{W}pPr/{W}pStyle")
    name = styles.get(style.get(f"{W}val"), "") if style is not None else ""
    if name.lower().startswith("heading"):
        last = name.rsplit(" ", 1)[-1]
        return int(last) if last.isdigit() else 0
    return 0 if name == "Title" else None


def docx_blocks(content: bytes) -> list[dict]:
    """Headers and footers of all sections first, then paragraphs and tables as they come; empty ones are left out."""
    with _opened(content, "docx") as archive:
        body = _xml(archive, "word/document.xml").find(f"{W}body")
        styles = {}
        if "word/styles.xml" in archive.namelist():
            for x in _xml(archive, "word/styles.xml").iter(f"{W}style"):
                name = x.find(f"{W}name")
                styles[x.get(f"{W}styleId")] = name.get(f"{W}val", "") if name is not None else ""
        links = _links(archive, "word/document.xml")
        out: list[dict] = []
        for k, section in enumerate(body.iter(f"{W}sectPr")):
            for kind in ("header", "footer"):
                for ref in section.findall(f"{W}{kind}Reference"):
                    if ref.get(f"{W}type") in (None, "default") and links.get(ref.get(f"{R}id")) in archive.namelist():
                        lines = [_paragraph(p) for p in _xml(archive, links[ref.get(f"{R}id")]).findall(f"{W}p")]
                        if text := "\n".join(x for x in lines if x.strip()):
                            out.append({"type": kind, "level": None, "section": k, "text": text, "rows": None})
        for element in body:
            if element.tag == f"{W}p" and (text := _paragraph(element)).strip():
                level = _level(element, styles)
                out.append({"type": "paragraph" if level is None else "heading", "level": level, "section": None, "text": text, "rows": None})
            elif element.tag == f"{W}tbl":
                rows = _table(element)
                if any(cell.strip() for row in rows for cell in row):
                    out.append({"type": "table", "level": None, "section": None, "text": None, "rows": rows})
    return out


# --- xlsx ------------------------------------------------------------------------


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _number(text: str, dated: bool) -> str:
    value = float(text)
    if dated:
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(value * 86400))
        return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(sep=" ")
    return str(int(value)) if value.is_integer() and "." not in text and "E" not in text.upper() else str(value)


def _sheets(content: bytes) -> Iterator[tuple[str, list[tuple[int, list[tuple[str, str | None]]]], set[int]]]:
    """(name, rows of (value, formula) in all columns, rows that start with a merged cell) of each sheet."""
    with _opened(content, "xlsx") as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{S}t")) for item in _xml(archive, "xl/sharedStrings.xml").findall(f"{S}si")]
        dated: list[bool] = []
        if "xl/styles.xml" in archive.namelist():
            styles = _xml(archive, "xl/styles.xml")
            own = {int(x.get("numFmtId")): bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", x.get("formatCode", "").lower()))) for x in styles.iter(f"{S}numFmt")}
            formats = styles.find(f"{S}cellXfs")
            dated = [own.get(int(x.get("numFmtId", 0)), int(x.get("numFmtId", 0)) in DATE_FORMATS) for x in formats] if formats is not None else []
        links = _links(archive, "xl/workbook.xml")
        for sheet in _xml(archive, "xl/workbook.xml").iter(f"{S}sheet"):
            page = _xml(archive, links.get(sheet.get(f"{R}id"), ""))
            merged = set()
            for x in page.iter(f"{S}mergeCell"):
                a, _, b = x.get("ref").partition(":")
                if b and _column(a) == 1 and _column(b) > 1 and re.search(r"\d+", a)[0] == re.search(r"\d+", b)[0]:
                    merged.add(int(re.search(r"\d+", a)[0]))
            rows, width = [], 0
            for row in page.iter(f"{S}row"):
                cells = {}
                for cell in row.findall(f"{S}c"):
                    kind, value, formula = cell.get("t"), cell.find(f"{S}v"), cell.find(f"{S}f")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{S}t"))
                    elif value is None or value.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "True" if value.text == "1" else "False"
                    elif kind in ("str", "e", "d"):
                        text = value.text
                    else:
                        style = int(cell.get("s", 0))
                        text = _number(value.text, style < len(dated) and dated[style])
                    cells[_column(cell.get("r"))] = (text, None if formula is None else f"={formula.text or ''}")
                rows.append((int(row.get("r")), cells))
                width = max([width, *cells])
            yield sheet.get("name"), [(n, [cells.get(k, (None, None)) for k in range(1, width + 1)]) for n, cells in rows], merged


def xlsx_blocks(content: bytes) -> list[dict]:
    """Per sheet tables of its rows, and paragraphs where a row starts with a cell merged over others of its row."""
    out: list[dict] = []
    for k, (_, rows, merged) in enumerate(_sheets(content)):
        table: list[list[str]] = []

        def close(section: int) -> None:
            if table:  # noqa: B023
                out.append({"type": "table", "level": None, "section": section, "text": None, "rows": list(table)})  # noqa: B023
                table.clear()  # noqa: B023

        for n, cells in rows:
            if n in merged:
                close(k)
                text = (cells[0][1] or cells[0][0] or "") if cells else ""
                if text.strip():
                    out.append({"type": "paragraph", "level": None, "section": k, "text": text, "rows": None})
                continue
            row = [(value or "") if formula is None else f"{value} (수식: {formula})" if value is not None else f"(수식: {formula})" for value, formula in cells]
            if any(x.strip() for x in row):
                table.append(row)
        close(k)
    return out


# --- pdf -------------------------------------------------------------------------


def pdf_blocks(content: bytes) -> list[dict]:
    """A block of lines for each page that has text, its number as the section; paragraphs are made of the lines later."""
    try:
        pages = pdf_pages(content)
    except Broken as e:
        raise Unreadable(str(e) if str(e) == "encrypted" else f"corrupted: {e}") from e
    return [{"type": "page", "level": None, "section": k, "text": text, "rows": None} for k, text in enumerate(pages) if text.strip()]


PARSERS = {"docx": docx_blocks, "xlsx": xlsx_blocks, "pdf": pdf_blocks}


def parse_documents(files: DataFrame, parsers: dict[str, Callable[[bytes], list[dict]]] = PARSERS) -> DataFrame:
    """(path, format, error, blocks) of files (path, content).

    ``parsers`` by format may be handed in: each makes a file's blocks (type, level,
    section, text, rows) of its bytes or raises ``Unreadable``. A file without content
    (null) is a missing one.
    """
    ship_package(files.sparkSession)
    kind = pa.list_(pa.struct([("block_no", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("section", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                form, error, blocks = "binary-unknown", None, None
                try:
                    if content is None:
                        raise Unreadable("missing")
                    if content[:8] == ENCRYPTED:
                        raise Unreadable("encrypted")
                    form = "pdf" if content[:5] == b"%PDF-" else archive_kind(content) if content[:2] == b"PK" else form
                    if form not in parsers:
                        raise Unreadable(f"unsupported: {form}")
                    blocks = [{"block_no": k, **b} for k, b in enumerate(parsers[form](content))]
                except Unreadable as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([form]), pa.array([error], pa.string()), pa.array([blocks], kind)], ["path", "format", "error", "blocks"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def gateway_text(form: str, content: bytes) -> str | None:
    """A file's text as the gateway reads it, which is not as the index does; None for what it can't read.

    Plain text without what is not UTF-8; a pdf's pages; a docx's paragraphs and then its tables; an
    xlsx's sheets under their names, cells without a value left out.
    """
    try:
        if form == "txt":
            return content.decode("utf-8", "ignore")
        if form == "pdf":
            return "\n".join(pdf_pages(content))
        if form == "docx":
            blocks = [b for b in docx_blocks(content) if b["type"] in ("heading", "paragraph", "table")]
            lines = [b["text"] for b in blocks if b["type"] != "table"]
            return "\n".join(lines + [" | ".join(row) for b in blocks if b["type"] == "table" for row in b["rows"]])
        if form == "xlsx":
            lines = []
            for name, rows, _ in _sheets(content):
                lines.append(f"[Sheet: {name}]")
                for _, cells in rows:
                    if own := [value for value, _ in cells if value is not None]:
                        lines.append(" | ".join(own))
            return "\n".join(lines)
    except (Unreadable, Broken):
        return None
    return None


def gateway_texts(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with ``text`` as the gateway reads it, by the ending of the path; null for what it can't read."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if content is None else gateway_text(path.rpartition(".")[2].lower(), content) for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(texts, pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")
