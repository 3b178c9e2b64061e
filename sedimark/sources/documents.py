"""One document on the driver: metadata, outline, search, and reading by selector."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.errors import DocumentError, InvalidSelector
from sedimark.operators import chunking
from sedimark.sources import formats

#: Which formats have which selector.
SELECTORS = {
    "page": {"pdf"}, "pages": {"pdf"}, "slide": {"pptx"}, "note": {"pptx"}, "sheet": {"xlsx"}, "cell": {"xlsx"}, "table": {"html", "htm", "docx", "xlsx"}, "image": {"html", "htm", "docx", "pptx"},
    "heading": {"md", "html", "htm", "docx", "pdf"}, "paragraph": {"txt", "md", "html", "htm", "docx", "pptx"}, "range": {"txt", "md", "html", "htm", "pdf"}, "slice": set(formats._PARSERS),
}
_UNITS = {"pdf": "page", "pptx": "slide", "xlsx": "sheet", "html": "paragraph", "htm": "paragraph", "docx": "paragraph"}


@dataclass(frozen=True)
class Match:
    place: object
    text: str
    context: str = ""
    score: float = 1.0


@dataclass(frozen=True)
class Entry:
    """A line of an outline; ``parent`` is the position of the entry above it."""

    level: int
    label: str
    parent: int | None = None


class Document:
    def __init__(self, path: str, data: bytes | None = None, format: str | None = None):
        """The document at a path, or of ``data`` in a ``format`` if these are given."""
        if data is None and not os.path.isfile(path):
            raise DocumentError(f"no file: {path}")
        self.path, self.format = path, (format or os.path.splitext(path)[1][1:]).lower()
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        self.size, self.elements = len(data), formats.parse(data, self.format)

    def of(self, kind: str) -> list[dict]:
        return [e for e in self.elements if e["kind"] == kind]

    def metadata(self) -> dict:
        meta = next((dict(e["rows"]) for e in self.of("meta")), {})
        return {"path": self.path, "format": self.format, "size": self.size, "page_count": self.page_count(), **meta}

    def page_count(self) -> int | None:
        """Pages of PDF and of DOCX with several, slides of PPTX; else none."""
        return len(self.of("page")) or len(self.of("slide")) or None

    def outline(self) -> list[Entry]:
        """Headings with their parents; slides and sheets as roots. DOCX has two levels, PDF one."""
        if self.format in ("pptx", "xlsx"):
            return [Entry(1, e["label"] or f"Slide {e['number']}") for e in self.of("slide") + self.of("sheet")]
        out: list[Entry] = []
        for h in self.of("heading"):
            above = [i for i, e in enumerate(out) if e.parent is None] if self.format == "docx" else list(range(len(out)))
            last = above[-1:] if self.format == "docx" else [i for i in above if out[i].level < h["level"]][-1:]
            fits = last and out[last[0]].level < h["level"] and self.format != "pdf"
            out.append(Entry(h["level"], h["label"], last[0] if fits else None))
        return out

    def search(self, query: str, context: int = 2) -> list[Match]:
        """Lines with those around them, paragraphs, slides, cells or pages that contain the query in any case."""
        if not query:
            raise InvalidSelector("empty query")
        q = query.lower()
        if self.format == "xlsx":
            return [Match(_cell_name(i, j), c, f"Sheet: {e['label']}") for e in self.of("sheet") for i, r in enumerate(e["rows"]) for j, c in enumerate(r) if q in c.lower()]
        unit = _UNITS.get(self.format, "line")
        own = self.of(unit)
        hit = [i for i, e in enumerate(own) if q in (e["text"] or "").lower() or unit == "slide" and q in (e["label"] or "").lower()]
        near = lambda i: "\n".join(e["text"] for e in own[max(0, i - context) : i + context + 1]) if unit == "line" else ""
        return [Match(own[i]["number"] if unit in ("page", "slide") else i, own[i]["text"], near(i)) for i in hit]

    def read(self, kind: str | None = None, value=None) -> list:
        """What a selector picks; without one the whole text, pages or slides. What isn't there, or no selector of the format, is an error."""
        if kind is None:
            return [e["text"] if e["text"] is not None else e["rows"] for e in self.elements if e["kind"] in ("text", "page", "slide", "sheet") and not (e["kind"] == "page" and self.format == "docx")]
        if kind not in SELECTORS or self.format not in SELECTORS[kind]:
            raise InvalidSelector(f"{self.format} has no {kind}")
        picked = getattr(self, f"_{kind}")(value)
        if not picked:
            raise InvalidSelector(f"no {kind} {value}")
        return picked

    def _page(self, n):
        return [e["text"] for e in self.of("page") if e["number"] == int(n)]

    def _pages(self, numbers):
        by = {e["number"]: e["text"] for e in self.of("page")}
        found = [by[int(n)] for n in numbers if int(n) in by]
        return ["\n\n".join(found)] if found else []

    def _slide(self, n):
        return [e["text"] for e in self.of("slide") if e["number"] == int(n)]

    _note = _slide

    def _sheet(self, name):
        return [e["rows"] for e in self.of("sheet") if (e["label"] or "").lower() == str(name).lower()]

    def _cell(self, reference):
        from sedimark.operators.reading import cell_position

        i, j = cell_position(str(reference))
        rows = next((e["rows"] for e in self.of("sheet")), [])
        return [rows[i][j] if i < len(rows) and j < len(rows[i]) else ""]

    def _table(self, n):
        return [e["rows"] for e in self.of("sheet" if self.format == "xlsx" else "table")][int(n) : int(n) + 1]

    def _image(self, n):
        return [(e["label"], e["data"]) for e in self.of("image")][int(n) : int(n) + 1]

    def _paragraph(self, n):
        unit = {"txt": "line", "pptx": "slide"}.get(self.format, "paragraph")
        return [e["text"] for e in self.of(unit)][int(n) : int(n) + 1] if int(n) >= 0 else []

    def _range(self, value):
        start, end = (int(x) for x in str(value).replace(",", "-").split("-")) if not isinstance(value, (tuple, list)) else value
        raw = ("\n\n".join(e["text"] for e in self.of("page")) if self.format == "pdf" else (self.of("raw") or self.of("text"))[0]["text"]).encode()
        if not 0 <= start < end <= len(raw):
            raise InvalidSelector(f"no range {value} in {len(raw)} bytes")
        return [raw[start:end].decode("utf-8", "ignore")]

    def _slice(self, value):
        skip, take = (int(x) for x in str(value).split(",")) if not isinstance(value, (tuple, list)) else value
        unit = _UNITS.get(self.format, "line")
        own = [e["text"] if e["text"] is not None else e["rows"] for e in self.of(unit)]
        if not 0 <= skip < len(own):
            raise InvalidSelector(f"only {len(own)} {unit}s")
        return own[skip : skip + take]

    def _heading(self, name):
        heads = self.of("heading")
        at = next((i for i, h in enumerate(heads) if h["label"].lower() == str(name).strip().lower()), None)
        if at is None:
            return []
        h, later = heads[at], heads[at + 1 :]
        if self.format == "pdf":
            return self._page(h["number"])
        own = self.of("line" if self.format == "md" else "paragraph")
        if self.format in ("html", "htm"):
            stop = next((x["pos"] for x in later if x["pos"] > h["pos"]), len(own))
        else:
            stop = next((x["pos"] for x in later if x["level"] <= h["level"]), len(own))
        return ["\n".join(e["text"] for e in own[h["pos"] + (self.format == "docx") : stop])]

    def blocks(self) -> list[dict]:
        """The blocks that the chunker takes."""
        names = {"page": "Page", "slide": "Slide", "sheet": "Sheet", "text": "Text"}
        wanted = ("page", "slide", "sheet") if self.format in ("pdf", "pptx", "xlsx") else ("text",)
        return [{"kind": names[e["kind"]], "text": e["text"], "number": e["number"], "title": e["label"] if e["kind"] == "slide" else None, "name": e["label"] if e["kind"] == "sheet" else None, "rows": e["rows"]} for e in self.elements if e["kind"] in wanted]

    def chunks(self, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> list[dict]:
        return chunking.chunk_blocks(self.path, self.blocks(), config)


def _cell_name(row: int, column: int) -> str:
    name, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return f"{name}{row + 1}"


# --- many documents, each where it lies ---------------------------------------------------------


def _each(files: DataFrame, schema: str, rows: Callable[[Document], Iterable[tuple]], failed: Callable[[Exception], Iterable[tuple]]) -> DataFrame:
    """``rows`` of each document of ``files`` (file_id, extension, content), after its file_id; what ``failed`` makes of those that can't be read."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, ext, data = (b.column(n)[i].as_py() for n in range(3))
                try:
                    if data is None:
                        raise DocumentError("no content")
                    found = [(key, *r) for r in rows(Document(key, data, ext or ""))]
                except Exception as x:  # a document must not end the job
                    found = [(key, *r) for r in failed(x)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names=names)

    return files.select(F.col("file_id").cast("string"), F.col("extension").cast("string"), F.col("content").cast("binary")).mapInArrow(run, schema)


def _shown(part) -> str:
    """A part as text: rows as lines of cells with tabs between, a picture by its name and the hash of its bytes."""
    if isinstance(part, tuple):
        return f"{part[0]}:{hashlib.sha256(part[1] or b'').hexdigest()}"
    return part if isinstance(part, str) else "\n".join("\t".join(x or "" for x in r) for r in part)


def read_parts(files: DataFrame, requests: dict[str, tuple]) -> DataFrame:
    """(file_id, request, part, text, error): what each named request, a selector and its value or () for all, picks from each document; ``text`` is null and ``error`` says why where it picks nothing."""

    def rows(d: Document) -> Iterator[tuple]:
        for name, request in requests.items():
            try:
                yield from ((name, i, _shown(p), None) for i, p in enumerate(d.read(*request)))
            except DocumentError as x:
                yield name, 0, None, type(x).__name__

    return _each(files, "file_id string, request string, part int, text string, error string", rows, lambda x: [(n, 0, None, type(x).__name__) for n in requests])


def facts(files: DataFrame) -> DataFrame:
    """(file_id, format, size, page_count, title, author, error) of each document."""
    fields = "file_id string, format string, size long, page_count int, title string, author string, error string"

    def rows(d: Document) -> Iterator[tuple]:
        m = d.metadata()
        yield d.format, m["size"], m["page_count"], m.get("title"), m.get("creator") or m.get("author"), None

    return _each(files, fields, rows, lambda x: [(None, None, None, None, None, type(x).__name__)])


def outlines(files: DataFrame) -> DataFrame:
    """(file_id, pos, level, label, parent): the outline of each document; those that can't be read have none."""
    return _each(files, "file_id string, pos int, level int, label string, parent int", lambda d: ((i, e.level, e.label, e.parent) for i, e in enumerate(d.outline())), lambda x: ())


def searches(files: DataFrame, query: str, context: int = 2) -> DataFrame:
    """(file_id, place, text, context): what matches in each document, by line, paragraph, slide, cell or page; documents that can't be read are skipped."""
    return _each(files, "file_id string, place string, text string, context string", lambda d: ((str(m.place), m.text, m.context) for m in d.search(query, context)), lambda x: ())


def whole_blocks(files: DataFrame) -> DataFrame:
    """(file_id, block, kind, number, title, name, text): the blocks that the chunker takes, rows of sheets as text."""
    fields = "file_id string, block int, kind string, number int, title string, name string, text string"
    return _each(files, fields, lambda d: ((i, b["kind"], b["number"], b["title"], b["name"], _shown(b["text"] if b["text"] is not None else b["rows"])) for i, b in enumerate(d.blocks())), lambda x: ())


def document_chunks(files: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> DataFrame:
    """(file_id, chunk, content, heading, page, slide, sheet, block_type): the chunks of each document, opened, cut into blocks and chunked."""
    fields = "file_id string, chunk int, content string, heading string, page int, slide int, sheet string, block_type string"
    return _each(files, fields, lambda d: ((i, c["content"], c["heading"], c["page"], c["slide"], c["sheet"], c["block_type"]) for i, c in enumerate(d.chunks(config))), lambda x: ())
