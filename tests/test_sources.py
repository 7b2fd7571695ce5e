import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from leakloom.operators import ingest, locate, registry
from leakloom.sources import formats, office, payloads, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, style=None):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


DOCX = archive({
    "word/document.xml": f'<w:document {W}><w:body>{p("Report", "T")}{p("Part", "H2")}{p("  ")}<w:tbl><w:tr><w:tc>{p("a")}{p("b")}</w:tc><w:tc>{p("c")}</w:tc></w:tr></w:tbl>{p("End.")}<w:sectPr><w:headerReference w:type="default" r:id="x"/><w:footerReference r:id="y"/></w:sectPr></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
    "word/_rels/document.xml.rels": RELS.format('<Relationship Id="x" Target="header1.xml"/><Relationship Id="y" Target="/word/footer1.xml"/>'),
    "word/header1.xml": f"<w:hdr {W}>{p('Secret')}{p('')}</w:hdr>",
    "word/footer1.xml": f"<w:ftr {W}>{p('1')}</w:ftr>",
})
XLSX = archive({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Target="worksheets/s.xml"/>'),
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Pay roll</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    "xl/worksheets/s.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.5</v></c></row><row r="3"><c r="A3" s="1"><v>45293</v></c><c r="B3" s="1"><v>45293.5</v></c><c r="C3"><f>C2*2</f><v>7</v></c></row><row r="4"/><row r="5"><c r="B5" t="b"><v>1</v></c><c r="C5"><f>A9</f></c></row></sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>',
})
FILES = {"a.docx": DOCX, "b.xlsx": XLSX, "c.pdf": b"%PDF-1.4", "d.zip": archive({"x": "y"}), "e.bin": b"\xff\xfe\x00", "f.txt": "text é".encode(), "g.docx": b"PK\x03\x04broken", "h.doc": formats.ENCRYPTED + b"..", "i.docx": archive({"word/document.xml": "<broken"})}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary").repartition(3)


def test_formats_and_routes(files):
    got = {r["path"]: (r["format"], r["route"], r["text"]) for r in formats.routed(files).collect()}
    assert got == {
        "a.docx": ("docx", "document", None), "b.xlsx": ("xlsx", "document", None), "c.pdf": ("pdf", "document", None), "d.zip": ("zip-unknown", "failure", None), "e.bin": ("binary-unknown", "failure", None),
        "f.txt": ("binary-unknown", "text", "text é"), "g.docx": ("zip-unknown", "failure", None), "h.doc": ("binary-unknown", "failure", None), "i.docx": ("docx", "document", None),
    }


def test_blocks(files):
    rows = {r["path"]: r for r in office.parse_documents(files).collect()}
    assert [(b["type"], b["level"], b["section"], b["text"], b["rows"]) for b in rows["a.docx"]["blocks"]] == [
        ("header", None, 0, "Secret", None), ("footer", None, 0, "1", None), ("heading", 0, None, "Report", None), ("heading", 2, None, "Part", None), ("table", None, None, None, [["a\nb", "c"]]), ("paragraph", None, None, "End.", None),
    ]
    assert [(b["type"], b["text"], b["rows"]) for b in rows["b.xlsx"]["blocks"]] == [("paragraph", "Pay roll", None), ("table", None, [["name", "", "3.5"], ["2024-01-02", "2024-01-02 12:00:00", "7 (수식: =C2*2)"], ["", "True", "(수식: =A9)"]])]
    assert rows["h.doc"]["error"] == "encrypted" and all(rows[k]["error"] and rows[k]["blocks"] is None for k in ("c.pdf", "d.zip", "e.bin", "g.docx", "i.docx"))


def test_what_the_gateway_reads():
    assert office.gateway_text("docx", DOCX) == "Report\nPart\nEnd.\na\nb | c"
    assert office.gateway_text("xlsx", XLSX) == "[Sheet: One]\nPay roll\nname | 3.5\n2024-01-02 | 2024-01-02 12:00:00 | 7\nTrue"
    assert office.gateway_text("txt", b"a\xffb") == "ab" and office.gateway_text("pdf", b"") is None and office.gateway_text("docx", b"x") is None


def made_pdf(pages, deflate=True, extra=b"", tounicode=b""):
    """A file of pages (content streams) whose font F1 has the given map."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(pages), 3: b"<< /Type /Font /BaseFont /X" + (b" /ToUnicode 4 0 R" if tounicode else b"") + b" >>"}

    def stream(data):
        body = zlib.compress(data) if deflate else data
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), b" /Filter /FlateDecode" if deflate else b"", body)

    if tounicode:
        objects[4] = stream(tounicode)
    for k, page in enumerate(pages):
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = stream(page)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R " + extra + b">>"


PAGE = rb"BT /F1 12 Tf 72 700 Td (The first line of a para-) Tj 0 -14 Td (graph \(so to say\) and) Tj T* [(its) -300 (last) 20 (ing end.)] TJ 0 -28 Td (- an item) Tj ET BI /W 1 ID \xff(( EI BT 1 0 0 1 72 500 Tm <4e6578742e> Tj ET"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf_text(deflate):
    assert pdf.pdf_pages(made_pdf([PAGE, b"BT (two \\351) Tj ET"], deflate)) == ["The first line of a para-\ngraph (so to say) and\nits lasting end.\n- an item\nNext.", "two é"]
    mapped = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <AC00> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<D55C> <AE00>] endbfrange"
    assert pdf.pdf_pages(made_pdf([b"BT /F1 9 Tf <000100020004> Tj <00050006> Tj ET"], deflate, tounicode=mapped)) == ["가ac한글"]
    for broken in (made_pdf([PAGE], deflate, b"/Encrypt << /V 1 >> "), b"%PDF-1.4 nothing", made_pdf([PAGE]).replace(b"FlateDecode", b"DCTDecode")):
        with pytest.raises(pdf.Broken):
            pdf.pdf_pages(broken)
    packed = b"20 0 21 9 << /A 1 >> (x)"
    assert pdf._objects(b"5 0 obj << /Type /ObjStm /N 2 /First 10 >>\nstream\n" + packed + b"\nendstream endobj")[20].startswith(b"<< /A")


def test_files_to_documents_postings_and_places(spark, tmp_path):
    prose = "The merger with the northern company is announced on the first of May and not one day before that."
    docx = archive({"word/document.xml": f"<w:document {W}><w:body>{p(prose)}<w:tbl><w:tr><w:tc>{p('left “cell”')}</w:tc><w:tc>{p('right  cell')}</w:tc></w:tr></w:tbl>{p('Ende.')}</w:body></w:document>"})
    for name, content in {"plan.docx": docx, "pay.xlsx": XLSX, "memo.pdf": made_pdf([PAGE]), "bad.docx": b"PK\x03\x04", "note.txt": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    documents, postings, index = ingest.ingest_directory(spark, str(tmp_path))
    rows = {r["doc_id"]: r for r in documents.collect()}
    assert set(rows) == {"plan", "pay", "memo", "bad"}
    assert rows["plan"]["text"] == prose + '\nleft "cell" | right cell\nEnde.'
    assert rows["memo"]["text"] == "The first line of a paragraph (so to say) and its lasting end.\n- an item Next." and rows["memo"]["format"] == "pdf"
    assert rows["pay"]["text"].startswith("Pay roll\nname |  | 3.5\n2024-01-02") and rows["bad"]["error"] and rows["bad"]["text"] is None
    expected = registry.build_postings(documents.filter("text is not null").select("doc_id", "text"))
    # The text of a document is not normalised again as a whole, which moves places but no window.
    both = ("hash", "doc_id")
    assert sorted(map(tuple, postings.select(*both).collect())) == sorted(map(tuple, expected.select(*both).collect())) and postings.filter("doc_id = 'plan'").count() > 40
    at = rows["plan"]["text"].index("right")
    places = spark.createDataFrame([("plan", at, at + 5), ("plan", 4, 10), ("memo", rows["memo"]["text"].index("Next"), None)], "doc_id string, start int, end int")
    got = {(r["doc_id"], r["start"]): r for r in locate.locate(index, places).collect()}
    assert (got["plan", at]["type"], got["plan", at]["cell"]["col"], got["plan", at]["word_indices"]) == ("table", 1, [3])
    assert got["plan", 4]["word_indices"] == [1] and got["plan", 4]["raw_start"] == 4
    assert got["memo", rows["memo"]["text"].index("Next")]["page"] == 1


def test_parsers_can_be_handed_in(spark, files):
    mine = {"pdf": lambda content: [{"type": "paragraph", "level": None, "section": None, "text": f"{len(content)} bytes", "rows": None}]}
    rows = {r["path"]: r for r in office.parse_documents(files, mine).collect()}
    assert rows["c.pdf"]["blocks"][0]["text"] == "8 bytes" and rows["a.docx"]["error"] == "unsupported: docx"
    missing = spark.createDataFrame([("gone.docx", None)], "path string, content binary")
    assert office.parse_documents(missing).first()["error"] == "missing"
    got = {r["path"]: r["text"] for r in office.gateway_texts(files).collect()}
    assert got["f.txt"] == "text é" and got["a.docx"].startswith("Report") and got["e.bin"] is None


def test_inputs_and_endings(spark, tmp_path):
    (tmp_path / "f.txt").write_text("from a file")
    rows = [formats.process_input(spark, x).first() for x in (str(tmp_path / "f.txt"), "just words", "x" * 5000, str(tmp_path))]
    assert [(r["route"], r["text"]) for r in rows] == [("text", "from a file"), ("text", "just words"), ("text", "x" * 5000), ("text", str(tmp_path))]
    got = spark.createDataFrame([("a.DOCX",), ("b/c.pdf",), ("d.txt",), ("e",)], "p string").select(formats.extension_route(F.col("p"))).collect()
    assert [r[0] for r in got] == ["docx", "pdf", None, None]


def test_directory(spark, tmp_path):
    for k, v in FILES.items():
        (tmp_path / k).write_bytes(v)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.docx").write_bytes(DOCX)
    assert [r["path"].rsplit("/", 1)[-1] for r in formats.read_directory(spark, str(tmp_path)).collect()] == ["a.docx", "b.xlsx", "c.pdf", "g.docx", "i.docx"]


def test_services(spark):
    hosts = ["chatgpt.com", "a.ChatGPT.com", "openai.com", "xopenai.com", "api.anthropic.com", "gemini.google.com", "google.com", None]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, h string")
    assert [r[1] for r in df.select("k", formats.service_for_host(F.col("h"))).orderBy("k").collect()] == ["ChatGPT", "ChatGPT", "ChatGPT/OpenAI", None, "Claude/Anthropic", "Gemini", None, None]


def plain_contents(body):
    out, given = [], body.get("input") if isinstance(body, dict) else None
    for item in [given] if isinstance(given, str) else given if isinstance(given, list) else []:
        content = item.get("content") if isinstance(item, dict) else item if isinstance(item, str) else None
        if isinstance(content, str):
            out.append(("prompt", content))
        elif isinstance(content, list) and isinstance(item, dict):
            for part in content:
                if isinstance(part, dict) and part.get("type") == "input_text":
                    out.append(("prompt", part.get("text", "")))
                elif isinstance(part, dict) and part.get("type") == "input_file":
                    out.append(("file", part.get("file_id"), part.get("filename")))
                elif isinstance(part, dict) and part.get("type") in ("input_image", "image_url"):
                    out.append(("image",))
    return out


BODIES = [
    {"input": "hello", "model": "m"}, {"input": ["a", {"content": "b"}, 3, None, {"content": 5}, {"x": 1}]}, {"input": {"content": "no list"}}, {"input": 7}, {}, [],
    {"input": [{"content": [{"type": "input_text", "text": "t"}, {"type": "input_text"}, {"type": "input_file", "file_id": "f1", "filename": "a.txt"}, {"type": "input_image", "image_url": "u"}, {"type": "other"}, "text", 3]}]},
]


def test_responses_bodies(spark):
    texts = [json.dumps(b) for b in BODIES] + ["{broken", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", payloads.responses_contents(F.col("t")).alias("c")).orderBy("k").collect()
    shape = lambda c: ("prompt", c["content"]) if c["type"] == "prompt" else ("file", c["file_id"], c["filename"]) if c["type"] == "file" else ("image",)
    assert [[shape(c) for c in r["c"]] for r in rows] == [plain_contents(b) for b in BODIES] + [[], [], []]
    event = df.filter("k = 6").select(payloads.responses_event(F.lit("r"), F.lit("now"), F.lit("ip"), F.lit("POST"), F.lit("/v1"), F.col("t"))).first()[0]
    assert json.loads(event)["metadata"]["content_count"] == 4
    checked = df.select("k", payloads.checkable_text(payloads.responses_contents(F.col("t"))).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in checked] == ["hello", "a\nb", "", "", "", "", "t", "", "", ""]


def test_chat_bodies(spark):
    m = lambda role, kind, parts: {"author": {"role": role}, "content": {"content_type": kind, "parts": parts}}
    bodies = [
        {"messages": [m("user", "text", ["a", " ", 3, {"x": 1}, "b"]), m("assistant", "text", ["no"]), m("user", "code", ["no"]), m("user", "text", ["c"])]},
        {"messages": [m("user", "text", ["  "])]}, {"messages": "x"}, {"messages": [1, {"author": "x"}, {"author": {"role": "user"}, "content": {"content_type": "text", "parts": "x"}}]}, {},
    ]
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(9, "no json")], "k int, t string")
    assert [r[1] for r in df.select("k", payloads.chat_prompt(F.col("t"))).orderBy("k").collect()] == ["a\nb\nc", None, None, None, None, None]


def test_uploads():
    body = b'--B\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nassistants\r\n--B\r\nContent-Disposition: form-data; name="file"; filename="a.txt"\r\nContent-Type: text/plain\r\n\r\nhello\r\n--B--\r\n'
    got = payloads.multipart_upload("multipart/form-data; boundary=B", body)
    assert (got["purpose"], got["filename"], got["file_bytes"].strip(), got["body_size"]) == ("assistants", "a.txt", b"hello", len(body))
    assert payloads.multipart_upload("application/json", b"{}")["filename"] is None
