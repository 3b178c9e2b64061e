"""Parsers: a file's bytes to its elements, one nested row a file.

An element is of kind ``line``, ``heading``, ``paragraph``, ``page``, ``slide``, ``sheet``, ``table``,
``image``, ``text`` (the whole text) or ``meta``; ``pos`` orders it among paragraphs or lines. A
parser is registered by extension; files that no parser takes, or that are broken, give an ``error``.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.errors import CorruptDocument, DocumentError, FileTooLarge, UnsupportedFormat

MAX_PARSED = 500 * 1024**2
FIELDS = {"kind": "string", "idx": "int", "pos": "int", "level": "int", "number": "int", "label": "string", "text": "string", "rows": "array<array<string>>", "data": "binary"}
_ARROW = pa.struct([("kind", pa.string()), ("idx", pa.int32()), ("pos", pa.int32()), ("level", pa.int32()), ("number", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("data", pa.binary())])
ELEMENT = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"

Element = dict
Parser = Callable[[bytes], list[Element]]


def element(kind: str, idx: int, **more) -> Element:
    return {**dict.fromkeys(FIELDS), "kind": kind, "idx": idx, **more}


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8")
    except UnicodeDecodeError as e:
        raise CorruptDocument(f"not UTF-8: {e}") from e


def _lines(text: str) -> list[str]:
    own = re.split(r"\r?\n", text)
    return own[:-1] if own and own[-1] == "" else own


def parse_txt(data: bytes) -> list[Element]:
    text = _text(data)
    return [element("text", 0, text=text)] + [element("line", i, pos=i, text=x) for i, x in enumerate(_lines(text))]


_ATX = re.compile(r"\s*(#{1,6}) +(.*?)\s*")


def parse_markdown(data: bytes) -> list[Element]:
    out = parse_txt(data)
    heads = [(e["pos"], m) for e in out if e["kind"] == "line" and (m := _ATX.fullmatch(e["text"]))]
    at = {p for p, _ in heads}
    body = [e for e in out if e["kind"] == "line" and e["text"].strip() and e["pos"] not in at]
    return out + [element("heading", i, pos=p, level=len(m[1]), label=m[2]) for i, (p, m) in enumerate(heads)] + [element("paragraph", i, pos=e["pos"], text=e["text"]) for i, e in enumerate(body)]


class _Html(HTMLParser):
    """Tolerant: an element that isn't closed ends where the next of its kind begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.count = {"heading": 0, "paragraph": 0, "table": 0, "image": 0}
        self.into: list[str] | None = None
        self.kind, self.level, self.silent = "", 0, 0
        self.tables: list[list[list[str]]] = []

    def _add(self, kind: str, **more) -> None:
        self.out.append(element(kind, self.count[kind], pos=self.count["paragraph"], **more))
        self.count[kind] += 1

    def _end(self) -> None:
        if self.into is None:
            return
        s, kind = " ".join("".join(self.into).split()), self.kind
        self.into, self.kind = None, ""
        if kind == "heading" and s:
            self._add("heading", level=self.level, label=s)
        elif kind == "paragraph" and s:
            self._add("paragraph", text=s)
        elif kind == "cell" and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(s)

    def _begin(self, kind: str) -> None:
        self._end()
        self.into, self.kind = [], kind

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self._begin("heading")
            self.level = int(tag[1])
        elif tag == "p" and not self.tables:
            self._begin("paragraph")
        elif tag == "table":
            self._end()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._end()
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self._begin("cell")
        elif tag == "img":
            a = dict(attrs)
            self._add("image", label=a.get("alt") or None, text=a.get("src"))
        elif tag == "br" and self.into is not None:
            self.into.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif re.fullmatch("h[1-6]|p|td|th", tag):
            self._end()
        elif tag == "table" and self.tables:
            self._end()
            rows = [r for r in self.tables.pop() if r]
            self._add("table", rows=rows)

    def handle_data(self, data):
        if self.into is not None and not self.silent:
            self.into.append(data)

    def close(self):
        super().close()
        self._end()
        while self.tables:
            self._add("table", rows=[r for r in self.tables.pop() if r])


def parse_html(data: bytes) -> list[Element]:
    text = _text(data)
    p = _Html()
    p.feed(text)
    p.close()
    body = "\n".join(e["label"] if e["kind"] == "heading" else e["text"] for e in p.out if e["kind"] in ("heading", "paragraph"))
    return [element("raw", 0, text=text), element("text", 0, text=body)] + p.out


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise CorruptDocument(str(e)) from e


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None
    except ElementTree.ParseError as e:
        raise CorruptDocument(f"{name}: {e}") from e


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _meta(z: zipfile.ZipFile) -> Element:
    root = _xml(z, "docProps/core.xml")
    found = {_tag(e): (e.text or "").strip() for e in root.iter()} if root is not None else {}
    rows = [[k, found[k]] for k in ("title", "creator", "created", "modified") if found.get(k)]
    return element("meta", 0, label=found.get("title") or None, rows=rows)


def _media(z: zipfile.ZipFile, folder: str) -> list[Element]:
    names = sorted(n for n in z.namelist() if n.startswith(folder) and not n.endswith("/"))
    return [element("image", i, label=n.rpartition("/")[2], text=n.rpartition(".")[2].lower(), data=z.read(n)) for i, n in enumerate(names)]


def heading_style(style: str | None) -> int | None:
    m = re.fullmatch(r"[Hh]eading ?([1-6])", style or "")
    return int(m[1]) if m else None


def parse_docx(data: bytes) -> list[Element]:
    z = _zip(data)
    root = _xml(z, "word/document.xml")
    if root is None:
        raise CorruptDocument("no word/document.xml")
    body = next((e for e in root if _tag(e) == "body"), root)
    paras: list[Element] = []
    heads: list[Element] = []
    tables: list[Element] = []
    pages: list[list[str]] = [[]]

    def run(p: ElementTree.Element) -> list[str]:
        parts = [""]
        for e in p.iter():
            t = _tag(e)
            if t == "t":
                parts[-1] += e.text or ""
            elif t == "tab":
                parts[-1] += "\t"
            elif t == "br":
                if _attr(e, "type") == "page":
                    parts.append("")
                else:
                    parts[-1] += "\n"
        return parts

    for e in body:
        if _tag(e) == "p":
            parts = run(e)
            text = "".join(parts)
            style = next((_attr(s, "val") for s in e.iter() if _tag(s) == "pStyle"), None)
            if (level := heading_style(style)) and text.strip():
                heads.append(element("heading", len(heads), pos=len(paras), level=level, label=text.strip()))
            for i, part in enumerate(parts):
                if i:
                    pages.append([])
                if part.strip():
                    pages[-1].append(part)
            if text.strip():
                paras.append(element("paragraph", len(paras), pos=len(paras), label=style, text=text))
        elif _tag(e) == "tbl":
            rows = [["".join("".join(run(p)) for p in c.iter() if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in e.iter() if _tag(r) == "tr"]
            tables.append(element("table", len(tables), pos=len(paras), rows=rows))
    whole = "\n".join(p["text"] for p in paras)
    sheets = [element("page", i, number=i + 1, text="\n".join(p)) for i, p in enumerate(pages)] if len(pages) > 1 else []
    return [_meta(z), element("text", 0, text=whole), *paras, *heads, *tables, *sheets, *_media(z, "word/media/")]


def _slide_number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def parse_pptx(data: bytes) -> list[Element]:
    z = _zip(data)
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_slide_number)
    out = [_meta(z)]
    for i, n in enumerate(names):
        root = _xml(z, n)
        runs = [e.text or "" for e in root.iter() if _tag(e) == "t"]
        title = None
        for shape in (e for e in root.iter() if _tag(e) == "sp"):
            if any(_tag(e) == "ph" and _attr(e, "type") == "title" for e in shape.iter()):
                title = next((e.text for e in shape.iter() if _tag(e) == "t" and e.text), None)
                break
        out.append(element("slide", i, pos=i, number=_slide_number(n), label=title, text=" ".join(r for r in runs if r)))
    return out + _media(z, "ppt/media/")


def parse_xlsx(data: bytes) -> list[Element]:
    z = _zip(data)
    book = _xml(z, "xl/workbook.xml")
    if book is None:
        raise CorruptDocument("no xl/workbook.xml")
    shared_root = _xml(z, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in shared_root if _tag(si) == "si"] if shared_root is not None else []
    rels = _xml(z, "xl/_rels/workbook.xml.rels")
    targets = {_attr(r, "Id"): _attr(r, "Target") for r in rels} if rels is not None else {}
    out = [_meta(z)]
    for i, s in enumerate(e for e in book.iter() if _tag(e) == "sheet"):
        rid = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
        target = (targets.get(rid) or f"worksheets/sheet{i + 1}.xml").lstrip("/")
        root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
        rows: list[list[str]] = []
        for r in (e for e in root.iter() if _tag(e) == "row") if root is not None else ():
            at = int(_attr(r, "r") or len(rows) + 1) - 1
            rows.extend([] for _ in range(at - len(rows) + 1))
            for c in (e for e in r if _tag(e) == "c"):
                m = re.match(r"([A-Z]+)", _attr(c, "r") or "")
                col = 0
                for ch in m[1] if m else "":
                    col = col * 26 + ord(ch) - 64
                col = col - 1 if m else len(rows[at])
                rows[at].extend("" for _ in range(col - len(rows[at])))
                rows[at].append(_cell(c, shared))
        width = max(map(len, rows), default=0)
        out.append(element("sheet", i, number=i, label=_attr(s, "name"), rows=[r + [""] * (width - len(r)) for r in rows]))
    return out


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind = _attr(c, "t")
    value = next((e.text or "" for e in c if _tag(e) == "v"), "")
    if kind == "inlineStr":
        return "".join(e.text or "" for e in c.iter() if _tag(e) == "t")
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "e":
        return f"ERROR:{value}"
    return value


# --- PDF: text of pages whose streams are plain or deflated ------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\[\]()<>])*)\]\s*TJ|(T\*|ET|(?:[-\d.]+\s+){2}T[dD])", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(s: bytes) -> str:
    if s.startswith(b"<"):
        raw = bytes.fromhex(re.sub(rb"\s", b"", s[1:-1]).decode().ljust(len(re.sub(rb"\s", b"", s[1:-1])) + len(re.sub(rb"\s", b"", s[1:-1])) % 2, "0"))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _stream(body: bytes) -> bytes | None:
    m = _STREAM.search(body)
    if not m:
        return None
    if b"FlateDecode" in m[1]:
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return None
    return None if b"/Filter" in m[1] else m[2]


def _shown(content: bytes) -> str:
    out: list[str] = []
    for m in _SHOWN.finditer(content):
        if m[1]:
            out.append(_literal(m[1]))
        elif m[2] is not None:
            for s in _STRING.findall(m[2]):
                if s[:1] in b"(<":
                    out.append(_literal(s))
                elif float(s) < -200:
                    out.append(" ")
        elif out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).strip("\n")


def capital_headings(text: str) -> list[tuple[int, str]]:
    out = []
    for line in map(str.strip, text.split("\n")):
        if len(line.encode()) > 3 and re.fullmatch(r"[^\W\d_a-z]+|[^a-z\d]+", line) and all(c.isupper() or c.isspace() or c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in line):
            n = len(line.split())
            out.append((1 if n <= 3 else 2 if n <= 6 else 3, line))
    return out


def parse_pdf(data: bytes) -> list[Element]:
    if not data.lstrip()[:5] == b"%PDF-":
        raise CorruptDocument("no PDF header")
    if b"/Encrypt" in data:
        raise UnsupportedFormat("encrypted PDF")
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    for body in list(objects.values()):  # objects within object streams
        if b"/ObjStm" in body and (s := _stream(body)) is not None and (n := re.search(rb"/N\s+(\d+)", body)) and (first := re.search(rb"/First\s+(\d+)", body)):
            head = list(map(int, s[: int(first[1])].split()[: 2 * int(n[1])]))
            starts = head[1::2] + [len(s) - int(first[1])]
            for k, num in enumerate(head[::2]):
                objects.setdefault(num, s[int(first[1]) + starts[k] : int(first[1]) + starts[k + 1]])
    pages = _page_order(objects)
    out, heads = [], []
    for i, number in enumerate(pages):
        refs = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", objects[number], re.S)
        ids = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs and refs[1] is not None else [int(refs[2])] if refs else []
        text = _shown(b"\n".join(s for r in ids if (s := _stream(objects.get(r, b""))) is not None))
        out.append(element("page", i, pos=i, number=i + 1, text=text))
        heads += [element("heading", 0, pos=i, number=i + 1, level=lv, label=t) for lv, t in capital_headings(text)]
    for i, h in enumerate(heads):
        h["idx"] = i
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    fields = objects.get(int(info[1]), b"") if info else b""
    found = {k: _literal(m[1]) for k in ("Title", "Author") if (m := re.search(rb"/" + k.encode() + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", fields, re.S))}
    return [element("meta", 0, label=found.get("Title"), rows=[[k.lower(), v] for k, v in found.items()]), *out, *heads]


def _page_order(objects: dict[int, bytes]) -> list[int]:
    leaf = [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    kids = {n: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] for n, b in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", b, re.S))}
    below = {k for ks in kids.values() for k in ks}
    order: list[int] = []

    def walk(n: int, depth: int) -> None:
        if depth > 50:
            return
        if n in kids:
            for k in kids[n]:
                walk(k, depth + 1)
        elif n in leaf and n not in order:
            order.append(n)

    for root in sorted(set(kids) - below):
        walk(root, 0)
    return order + sorted(n for n in leaf if n not in order)


_PARSERS: dict[str, Parser] = {"txt": parse_txt, "md": parse_markdown, "html": parse_html, "htm": parse_html, "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "pdf": parse_pdf}


def register(extension: str, parser: Parser) -> None:
    _PARSERS[extension.lower().lstrip(".")] = parser


def parser_for(extension: str) -> Parser:
    try:
        return _PARSERS[extension.lower().lstrip(".")]
    except KeyError:
        raise UnsupportedFormat(extension) from None


def parse(data: bytes, extension: str) -> list[Element]:
    if len(data) > MAX_PARSED:
        raise FileTooLarge(f"{len(data)} bytes")
    return parser_for(extension)(data)


def parse_files(files: DataFrame, content: str = "content", key: str = "file_id", ext: str = "extension") -> DataFrame:
    """(file_id, extension, elements, error): each file parsed where it lies. Broken, unknown and null files have an error and no elements."""
    registry = dict(_PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw, e = b.column(2)[i].as_py(), (b.column(1)[i].as_py() or "").lower()
                found, error = [], None
                try:
                    if raw is None:
                        raise CorruptDocument("no content")
                    if len(raw) > MAX_PARSED:
                        raise FileTooLarge(f"{len(raw)} bytes")
                    if e not in registry:
                        raise UnsupportedFormat(e)
                    found = registry[e](raw)
                except DocumentError as x:
                    error = f"{type(x).__name__}: {x}"
                except Exception as x:  # a parser must not end the job
                    error = f"CorruptDocument: {type(x).__name__}: {x}"
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([e]), pa.array([found], pa.list_(_ARROW)), pa.array([error], pa.string())], names=["file_id", "extension", "elements", "error"])

    picked = files.select(F.col(key).cast("string").alias("file_id"), F.col(ext).alias("extension"), F.col(content).cast("binary").alias("content"))
    return picked.mapInArrow(run, f"file_id string, extension string, elements array<{ELEMENT}>, error string")


def of_kind(parsed: DataFrame, kind: str) -> DataFrame:
    """(file_id, element fields...) of one kind."""
    return parsed.select("file_id", F.inline(F.filter("elements", lambda e: e["kind"] == kind)))


def blocks(parsed: DataFrame) -> DataFrame:
    """(file_id, blocks) for the chunker: pages of PDF, slides, sheets; one text of the other formats; tables and images besides."""
    none = F.lit(None)
    full = F.filter("elements", lambda e: e["kind"].isin("page", "slide", "sheet"))
    whole = F.filter("elements", lambda e: e["kind"] == "text")
    chosen = F.when(F.col("extension").isin("pdf", "pptx", "xlsx"), full).otherwise(whole)
    name = {"page": "Page", "slide": "Slide", "sheet": "Sheet", "text": "Text"}
    kind = lambda e: F.create_map(*[x for k, v in name.items() for x in (F.lit(k), F.lit(v))])[e["kind"]]
    made = F.transform(
        chosen,
        lambda e: F.struct(kind(e).alias("kind"), e["text"].alias("text"), e["number"].alias("number"), F.when(e["kind"] == "slide", e["label"]).alias("title"), F.when(e["kind"] == "sheet", e["label"]).alias("name"), none.cast("array<string>").alias("headers"), e["rows"].alias("rows"), none.cast("string").alias("caption")),
    )
    return parsed.where(F.col("error").isNull()).select("file_id", made.alias("blocks"))
