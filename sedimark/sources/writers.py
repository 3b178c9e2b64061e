"""Writing documents: structured content to the bytes of a file of each format, and files to a folder."""

from __future__ import annotations

import html
import io
import os
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.errors import UnsupportedFormat
from sedimark.storage_paths import filesystem

#: What a file is written from: its parts in order, and besides them a table and a picture.
CONTENT = "struct<title:string,author:string,parts:array<struct<label:string,lines:array<string>>>,rows:array<array<string>>,picture:string>"
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _zipped(files: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def _core(c: dict) -> str:
    return f'<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(c["title"] or "")}</dc:title><dc:creator>{escape(c["author"] or "")}</dc:creator></p>'


def docx(c: dict) -> bytes:
    """The title and the parts' labels as headings of level 1 and 2, lines as paragraphs, each part on a page of its own, then the table."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    para = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else ""}{run(t)}</w:p>'
    body = [para(c["title"] or "", "Heading1")]
    for i, p in enumerate(c["parts"]):
        body += ['<w:p><w:r><w:br w:type="page"/></w:r></w:p>'] * bool(i) + [para(p["label"], "Heading2")] + [para(x) for x in p["lines"]]
    if c["rows"]:
        body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(x or '')}</w:tc>" for x in r) + "</w:tr>" for r in c["rows"]) + "</w:tbl>")
    files = {"word/document.xml": f"<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>", "docProps/core.xml": _core(c)}
    return _zipped(files | ({"word/media/image1.png": c["picture"]} if c["picture"] else {}))


def pptx(c: dict) -> bytes:
    """A slide for each part: its label as title, its lines as runs of text."""
    shape = lambda kind, lines: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr>{"".join(f"<a:t>{escape(x)}</a:t>" for x in lines)}</p:sp>'
    slide = lambda p: f'<p:sld xmlns:a="a" xmlns:p="p">{shape("<p:ph type=" + chr(34) + "title" + chr(34) + "/>", [p["label"]])}{shape("", p["lines"])}</p:sld>'
    files = {f"ppt/slides/slide{i}.xml": slide(p) for i, p in enumerate(c["parts"], 1)} | {"docProps/core.xml": _core(c)}
    return _zipped(files | ({"ppt/media/image1.png": c["picture"]} if c["picture"] else {}))


def xlsx(c: dict) -> bytes:
    """The table as the first sheet, and a sheet for each part with a line in each row; texts are shared strings."""
    texts: dict[str, int] = {}

    def sheet(rows: list[list[str]]) -> str:
        cell = lambda i, j, x: f'<c r="{_letters(j)}{i}" t="s"><v>{texts.setdefault(x or "", len(texts))}</v></c>'
        return "<worksheet><sheetData>" + "".join(f'<row r="{i}">' + "".join(cell(i, j, x) for j, x in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"

    sheets = [("Table", c["rows"] or []), *((p["label"], [[x] for x in p["lines"]]) for p in c["parts"])]
    files: dict[str, str | bytes] = {f"xl/worksheets/sheet{i}.xml": sheet(rows) for i, (_, rows) in enumerate(sheets, 1)}
    files["xl/workbook.xml"] = '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name={quoteattr(n)} r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>"
    files["xl/_rels/workbook.xml.rels"] = "<R>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</R>"
    files["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>"
    return _zipped(files | {"docProps/core.xml": _core(c)})


def _letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def pdf(c: dict) -> bytes:
    """A page for each part: its label and its lines, every other page's stream deflated. Texts are written as Latin-1."""
    literal = lambda t: b"(" + t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    n = len(c["parts"])
    kids = b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(n))
    objects = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [" + kids + b"] /Count %d>>" % n)]
    for i, p in enumerate(c["parts"]):
        stream = b"BT " + b" 0 -12 Td ".join(literal(x) + b" Tj" for x in [p["label"], *p["lines"]]) + b" ET"
        stream, kind = (zlib.compress(stream), b"/Filter /FlateDecode ") if i % 2 else (stream, b"")
        objects += [(3 + 2 * i, b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (4 + 2 * i)), (4 + 2 * i, b"<<" + kind + b"/Length %d>>\nstream\n" % len(stream) + stream + b"\nendstream")]
    objects.append((3 + 2 * n, b"<</Title " + literal(c["title"] or "") + b" /Author " + literal(c["author"] or "") + b">>"))
    body = b"\n".join(b"%d 0 obj %s endobj" % o for o in objects)
    return b"%PDF-1.4\n" + body + b"\ntrailer <</Root 1 0 R /Info %d 0 R>>\n" % (3 + 2 * n)


def html_page(c: dict) -> bytes:
    """The title and labels as h1 and h2, lines as paragraphs, then the table and the picture."""
    e = html.escape
    out = [f"<html><body><h1>{e(c['title'] or '')}</h1>"]
    for p in c["parts"]:
        out += [f"<h2>{e(p['label'])}</h2>"] + [f"<p>{e(x)}</p>" for x in p["lines"]]
    if c["rows"]:
        out.append("<table>" + "".join("<tr>" + "".join(f"<{'td' if i else 'th'}>{e(x or '')}</{'td' if i else 'th'}>" for x in r) + "</tr>" for i, r in enumerate(c["rows"])) + "</table>")
    if c["picture"]:
        out.append(f'<img src="image1.png" alt="{e(c["picture"])}">')
    return ("\n".join(out) + "\n</body></html>").encode()


def markdown(c: dict) -> bytes:
    return "\n".join([f"# {c['title'] or ''}", ""] + [x for p in c["parts"] for x in [f"## {p['label']}", "", *p["lines"], ""]]).encode()


def text(c: dict) -> bytes:
    return "\n".join(x for p in c["parts"] for x in p["lines"]).encode()


WRITERS: dict[str, Callable[[dict], bytes]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf, "html": html_page, "md": markdown, "txt": text}


def made(rows: DataFrame, extension: str, key: str = "file_id", content: str = "content") -> DataFrame:
    """(file_id, extension, content): the bytes of a file of this format for each row's ``CONTENT``. Rows without content have none."""
    if extension not in WRITERS:
        raise UnsupportedFormat(extension)
    write = WRITERS[extension]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extension] * part.num_rows), pa.array([write(c) for c in part.column(1).to_pylist()], pa.binary())], names=["file_id", "extension", "content"])

    return rows.where(F.col(content).isNotNull()).select(F.col(key).cast("string").alias("file_id"), F.col(content).cast(CONTENT).alias("content")).mapInArrow(run, "file_id string, extension string, content binary")


def saved(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's bytes to a file below a folder that all executors reach by a local path; the number of files. A name that comes twice is written twice."""
    fs, p = filesystem(files.sparkSession, folder)
    root = p.toUri().getPath() if fs.getUri().getScheme() == "file" else folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(root, n)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    picked = files.select(F.col(name).cast("string"), F.col(content).cast("binary")).where(F.col(name).isNotNull() & F.col(content).isNotNull())
    return picked.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def folder_of(spark: SparkSession, url: str) -> str:
    """The local path of a folder on a shared disk."""
    _, p = filesystem(spark, url)
    return p.toUri().getPath()
