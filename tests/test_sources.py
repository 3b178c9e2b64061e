import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sedimark.errors import CorruptDocument, HashError, ScanError, UnsupportedFormat
from sedimark.sources import formats, scan
from sedimark.sources.tables import table


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels"), t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped(
    word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>H</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:br w:type="page"/><w:t>next page</w:t></w:r></w:p></w:body></w:document>',
    docProps__core_xml='<c xmlns:dc="d"><dc:title>My Title</dc:title><dc:creator>Me</dc:creator></c>',
)
SLIDE = '<p xmlns:a="a" xmlns:p="p"><p:sp><p:nvSpPr><p:nvPr><p:ph type="{}"/></p:nvPr></p:nvSpPr><a:t>{}</a:t></p:sp><p:sp><a:t>body</a:t><a:t>text</a:t></p:sp></p>'
PPTX = zipped(**{"ppt__slides__slide10_xml": SLIDE.format("body", "Ten"), "ppt__slides__slide2_xml": SLIDE.format("title", "Two"), "ppt__media__image1.png": "png"})

def xlsx():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="r"><sheets><sheet name="First" r:id="x1"/><sheet name="Second" r:id="x2"/></sheets></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="x1" Target="worksheets/a.xml"/><Relationship Id="x2" Target="/xl/worksheets/b.xml"/></R>')
        z.writestr("xl/worksheets/a.xml", '<w><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c><c r="D3" t="e"><v>#REF!</v></c></row></sheetData></w>')
        z.writestr("xl/worksheets/b.xml", "<w><sheetData/></w>")
        z.writestr("xl/sharedStrings.xml", "<s><si><r><t>he</t></r><r><t>llo</t></r></si></s>")
    return b.getvalue()


def pdf():
    body = zlib.compress(b"BT (INTRO) Tj 0 -12 Td [(Hel) -20 (lo) -300 (World)] TJ ET")
    parts = [b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [4 0 R 3 0 R] /Count 2>> endobj", b"3 0 obj <</Type /Page /Parent 2 0 R /Contents [5 0 R]>> endobj", b"4 0 obj <</Type /Page /Parent 2 0 R /Contents 6 0 R>> endobj", b"5 0 obj <</Length 9>>\nstream\nBT (second \\(page\\)) Tj ET\nendstream endobj", b"6 0 obj <</Filter /FlateDecode /Length 9>>\nstream\n" + body + b"\nendstream endobj", b"7 0 obj <</Title (A Title) /Author <FEFF00C4>>> endobj", b"trailer <</Root 1 0 R /Info 7 0 R>>"]
    return b"%PDF-1.4\n" + b"\n".join(parts)


def kinds(found, kind):
    return [e for e in found if e["kind"] == kind]


def test_text_formats():
    found = formats.parse(b"line1\nline2\r\nline3\n", "TXT")
    assert [e["text"] for e in kinds(found, "line")] == ["line1", "line2", "line3"]
    md = formats.parse(b"# A\n\npara one\n\n## B\npara two\n#no\n", "md")
    assert [(e["level"], e["label"], e["pos"]) for e in kinds(md, "heading")] == [(1, "A", 0), (2, "B", 4)]
    assert [e["text"] for e in kinds(md, "paragraph")] == ["para one", "para two", "#no"]
    with pytest.raises(CorruptDocument):
        formats.parse(b"\xff\xfe", "txt")
    with pytest.raises(UnsupportedFormat):
        formats.parse(b"", "xyz")


def test_html():
    h = formats.parse("<html><head><meta charset=x><title>t</title><style>p{}</style></head><body><h1>Top</h1><p>one<p>two <b>bold</b></p><h2>Sub</h2><table><tr><th>H1<th>H2</tr><tr><td>A</td><td>B</td></tr></table><img alt='Photo' src=x><script>var p</script><p>last".encode(), "html")
    assert [(e["level"], e["label"], e["pos"]) for e in kinds(h, "heading")] == [(1, "Top", 0), (2, "Sub", 2)]
    assert [e["text"] for e in kinds(h, "paragraph")] == ["one", "two bold", "last"]
    assert [e["rows"] for e in kinds(h, "table")] == [[["H1", "H2"], ["A", "B"]]]
    assert [e["label"] for e in kinds(h, "image")] == ["Photo"]


def test_office():
    d = formats.parse(DOCX, "docx")
    assert [(e["level"], e["label"]) for e in kinds(d, "heading")] == [(1, "Top")]
    assert [e["text"] for e in kinds(d, "paragraph")] == ["Top", "one two", "next page"]
    assert [e["rows"] for e in kinds(d, "table")] == [[["H"], ["v"]]]
    assert [(e["number"], e["text"]) for e in kinds(d, "page")] == [(1, "Top\none two"), (2, "next page")]
    assert kinds(d, "meta")[0]["label"] == "My Title"
    p = formats.parse(PPTX, "pptx")
    assert [(e["number"], e["label"], e["text"]) for e in kinds(p, "slide")] == [(2, "Two", "Two body text"), (10, None, "Ten body text")]
    assert [e["data"] for e in kinds(p, "image")] == [b"png"]
    x = formats.parse(xlsx(), "xlsx")
    assert [(e["label"], e["rows"]) for e in kinds(x, "sheet")] == [("First", [["hello", "", "1.5", ""], ["", "", "", ""], ["", "true", "", "ERROR:#REF!"]]), ("Second", [])]
    for ext in ("docx", "pptx", "xlsx"):
        with pytest.raises(CorruptDocument):
            formats.parse(b"no zip", ext)
    assert [formats.heading_style(s) for s in ("Heading2", "heading 6", "Heading7", None)] == [2, 6, None, None]


def test_pdf():
    found = formats.parse(pdf(), "pdf")
    assert [(e["number"], e["text"]) for e in kinds(found, "page")] == [(1, "INTRO\nHello World"), (2, "second (page)")]
    assert [(e["level"], e["label"], e["number"]) for e in kinds(found, "heading")] == [(1, "INTRO", 1)]
    assert dict(kinds(found, "meta")[0]["rows"]) == {"title": "A Title", "author": "Ä"}
    with pytest.raises(CorruptDocument):
        formats.parse(b"hello", "pdf")


def test_registry():
    formats.register(".rev", lambda data: [formats.element("text", 0, text=data.decode()[::-1])])
    assert formats.parse(b"abc", "REV")[0]["text"] == "cba"
    del formats._PARSERS["rev"]


def test_parse_files(spark):
    rows = [("a", "txt", b"x\ny"), ("b", "docx", b"broken"), ("c", "xyz", b""), ("d", None, b""), ("e", "md", None), ("f", "pdf", pdf()), ("g", "txt", "z".encode() * 100_000)]
    got = formats.parse_files(spark.createDataFrame(rows, "file_id string, extension string, content binary"))
    errors = {r.file_id: (r.error or "").split(":")[0] for r in got.collect()}
    assert errors == {"a": "", "b": "CorruptDocument", "c": "UnsupportedFormat", "d": "UnsupportedFormat", "e": "CorruptDocument", "f": "", "g": ""}
    assert formats.of_kind(got, "line").where("file_id = 'a'").count() == 2
    blocks = {r.file_id: [b.kind for b in r.blocks] for r in formats.blocks(got).collect()}
    assert blocks == {"a": ["Text"], "f": ["Page", "Page"], "g": ["Text"]}


@pytest.fixture
def tree(tmp_path):
    for n in ("doc1.pdf", "doc2.txt", "image.png", "ignore.exe", ".hidden.md", "node_modules/lib.md", ".git/config", "src/main.rs", "src/readme.md", "Build/x.txt", "_kept.txt", "skipme/y.txt"):
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_text(n)
    (tmp_path / "link.txt").symlink_to(tmp_path / "doc2.txt")
    return tmp_path


def test_scan(spark, tree):
    got = scan.scan(spark, str(tree), patterns=("skip*",)).orderBy("path").collect()
    assert [r.path[len(str(tree)) + 1 :] for r in got] == ["_kept.txt", "doc1.pdf", "doc2.txt", "image.png", "src/readme.md"]
    assert all(len(r.hash) == 64 and len(r.file_id) == 64 for r in got)
    again = scan.scan(spark, str(tree), patterns=("skip*",)).orderBy("path").collect()
    assert got == again
    assert {r.hash for r in scan.scan(spark, str(tree), hashed=False).collect()} == {None}
    assert scan.scan(spark, str(tree), predicate=lambda p: p.endswith(".pdf")).count() == 1
    assert scan.scan(spark, str(tree / "src"), predicate=lambda p: False).count() == 0
    assert len(scan.readable_files(str(tree))) == 9
    with pytest.raises(ScanError):
        scan.scan(spark, str(tree / "doc1.pdf"))
    norm = {r.extension: (r.mime_type, r.category) for r in scan.normalise(scan.scan(spark, str(tree))).collect()}
    assert norm["png"] == ("image/png", "Image")
    raw = {r.path.rpartition("/")[2] for r in scan.binary_files(spark, str(tree)).collect()}
    assert "doc2.txt" in raw and ".hidden.md" not in raw


def test_hashes(tree):
    path = str(tree / "doc2.txt")
    h = scan.hash_file(path)
    assert scan.verify_hash(path, h.upper()) and not scan.verify_hash(path, "0") and not scan.verify_hash(path + "x", h)
    with pytest.raises(HashError):
        scan.hash_file(path, largest=2)


def test_moves(spark):
    m = spark.createDataFrame([("f", "a", "b", 1), ("f", "b", "c", 2), ("g", "x", "y", 5)], scan.MOVES)
    assert {(r.file_id, r.path) for r in scan.resolved_paths(m).collect()} == {("f", "c"), ("g", "y")}
    assert [r.new_path for r in scan.move_history(m, "f").collect()] == ["b", "c"]


def test_changes(spark):
    a = spark.createDataFrame([("same", "1"), ("edited", "2"), ("old", "3"), ("gone", "4"), ("twin1", "5"), ("twin2", "5"), ("n", None)], "path string, hash string")
    b = spark.createDataFrame([("same", "1"), ("edited", "9"), ("new", "3"), ("made", "7"), ("twin3", "5"), ("m", None)], "path string, hash string")
    got = {(r.event_type, r.path, r.old_path) for r in scan.changes(a, b).collect()}
    assert got == {("Modified", "edited", None), ("Renamed", "new", "old"), ("Deleted", "gone", None), ("Created", "made", None), ("Renamed", "twin3", "twin1"), ("Deleted", "twin2", None), ("Deleted", "n", None), ("Created", "m", None)}


def test_table(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x.parquet")
    assert table(spark, f"{tmp_path}/", "x").agg(F.sum("id")).first()[0] == 3
