"""Blocks of a document to chunks of bounded size, in document order.

A chunk depends on those before it in its file, so a file's blocks are one row (an array) and files
are mapped where they lie: no shuffle where a parser made the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.errors import ChunkError

BLOCK = "kind string, text string, number int, title string, name string, headers array<string>, rows array<array<string>>, caption string"
CHUNK = "chunk_id string, file_id string, content string, heading string, page int, slide int, sheet string, block_type string, start_offset int, end_offset int"
MERGED = ("Text", "Page", "Cell")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_HEADING = re.compile(r"(#{1,6}) (.*)", re.S)
_BOUNDARY = re.compile(rb"\n|[.!?](?=[ \n\r\t])")
_SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$")


def count_tokens(text: str) -> int:
    return len(text.split()) + sum(c in _PUNCTUATION for c in text) // 2


def byte_tokens(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass")) // 4


def detect_heading(text: str) -> tuple[int, str] | None:
    """(level, rest) of a text that begins with one to six number signs and a blank; the rest is all of it."""
    m = _HEADING.match(text.strip())
    return (len(m[1]), m[2].strip()) if m else None


@dataclass(frozen=True)
class ChunkConfig:
    """``block_mode``: ``lines`` cuts the texts of one-block formats into lines first, ``document`` takes them whole."""

    min_tokens: int = 100
    max_tokens: int = 800
    overlap_sentences: int = 1
    include_images: bool = False
    rows_per_chunk: int = 50
    block_mode: str = "lines"
    estimator: Callable[[str], int] = field(default=count_tokens, compare=False)

    def checked(self) -> ChunkConfig:
        if self.min_tokens > self.max_tokens or self.max_tokens < 1 or self.rows_per_chunk < 1:
            raise ChunkError("min_tokens must not exceed max_tokens, which is at least 1, as are rows_per_chunk")
        return self


def sentence_boundary(text: str, limit: int) -> int | None:
    """Where to cut a text of more than ``limit`` bytes, in bytes; None for one that fits.

    The places in the second half of the limit, by rank: the last blank line with an end of a line or
    sentence after it; the first end of a line or sentence; the place after the first blank; the limit.
    A blank line right at the half hands over to the next end after it. Characters stay whole.
    """
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:
        return None
    half = max(limit // 2, 1)
    found = list(_BOUNDARY.finditer(raw, half, limit))
    ends = sorted({m.end() - (m[0] == b"\n") for m in found})
    blank = [m.start() for m in found if m[0] == b"\n" and raw[m.start() - 1 : m.start()] == b"\n" and m.start() < ends[-1]]
    if blank:
        cut = blank[-1] if blank[-1] > limit // 2 else ends[ends.index(blank[-1]) + 1]
    elif ends:
        cut = ends[0]
    else:
        cut = raw.find(b" ", half, limit) + 1 or limit
    return _character(raw, cut)


def _character(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at or len(raw[:1])


def last_sentences(text: str, n: int) -> str:
    parts = [p for p in _SENTENCES.findall(text) if p.strip()]
    return "".join(parts[-n:]).lstrip() if n else ""


def split_with_overlap(text: str, config: ChunkConfig) -> list[str]:
    """Parts of at most four bytes a token, each after the first headed by the last sentences of the part before."""
    limit, out, before = config.max_tokens * 4, [], ""
    raw = text.encode("utf-8", "surrogatepass")
    while raw:
        rest = raw.decode("utf-8", "surrogatepass")
        at = sentence_boundary(rest, limit)
        at = len(raw) if at is None else max(at, 1)
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        part = raw[:at].decode("utf-8", "surrogatepass")
        out.append(last_sentences(before, config.overlap_sentences) + part if out else part)
        before, raw = part, raw[at:]
    return out or [text]


class Chunker:
    """The state while a file's blocks go by."""

    def __init__(self, file_id: str, config: ChunkConfig):
        self.file_id, self.config = file_id, config
        self.done: list[dict] = []
        self.heading = self.page = self.slide = self.sheet = None
        self.text: list[str] = []
        self.kind = "Text"
        self.bytes = self.estimate = 0

    def emit(self, content: str, kind: str) -> None:
        self.done.append({"content": content, "heading": self.heading, "page": self.page, "slide": self.slide, "sheet": self.sheet, "block_type": kind})

    def append(self, text: str, kind: str) -> None:
        if not self.text:
            self.kind = kind
        piece = text if text.endswith((" ", "\n")) else text + " "
        self.text.append(piece)
        self.bytes += len(piece.encode("utf-8", "surrogatepass"))
        if self.bytes > 4 * self.config.max_tokens and self.config.estimator("".join(self.text)) > self.config.max_tokens:
            self.flush()

    def flush(self, last: bool = False) -> None:
        content = "".join(self.text).strip()
        self.text, self.bytes = [], 0
        if not content:
            return
        before = self.done[-1] if self.done else None
        if not last and before and before["heading"] == self.heading and before["block_type"] == self.kind and self.config.estimator(content) < self.config.min_tokens:
            before["content"] += " " + content
        else:
            self.emit(content, self.kind)

    def parts(self, content: str, kind: str) -> None:
        long = len(content.encode("utf-8", "surrogatepass")) > 4 * self.config.max_tokens
        for part in split_with_overlap(content, self.config) if long else [content]:
            self.emit(part, kind)

    def take(self, b: dict) -> None:
        kind, text = b["kind"], b.get("text") or ""
        if kind in ("Text", "Page"):
            if not text.strip():
                return
            if kind == "Page":
                self.page = b.get("number")
            if head := detect_heading(text):
                self.flush()
                self.emit(head[1], "Heading")  # under the heading before it
                self.heading = head[1]
            else:
                self.append(text, kind)
        elif kind == "Slide":
            self.flush()
            self.slide = b.get("number")
            title, head = b.get("title"), detect_heading(text)
            if title is not None:
                self.heading = title
            if head:
                self.heading = head[1]
            self.parts(text if title is None or head else f"{title}: {text}", "Slide")
        elif kind == "Sheet":
            self.flush()
            self.sheet = self.heading = b.get("name")
            rows, n = b.get("rows") or [], self.config.rows_per_chunk
            for i in range(0, len(rows), n):
                self.parts("".join("\t".join(x or "" for x in r) + "\n" for r in rows[i : i + n]), "Sheet")
            if not rows:
                self.emit(f"[Sheet: {self.sheet}]", "Sheet")
        elif kind == "Table":
            self.flush()
            lines = ([b["headers"]] if b.get("headers") else []) + list(b.get("rows") or [])
            content = "".join("\t".join(x or "" for x in r) + "\n" for r in lines)
            size = byte_tokens(content)
            self.emit(f"[WARNING: table exceeds {self.config.max_tokens} tokens (est. {size})]\n{content}" if size > self.config.max_tokens else content, "Table")
        elif kind == "Image":
            if self.config.include_images:
                self.flush()
                self.emit(f"[Image: {b['caption']}]" if b.get("caption") is not None else "[Image]", "Image")
        elif kind == "Cell":
            self.append(text, "Cell")
        elif kind == "Match":
            self.append(text, "Text")

    def finish(self) -> list[dict]:
        self.flush(last=True)
        merged: list[dict] = []
        for c in self.done:
            a = merged[-1] if merged else None
            if a and a["block_type"] == c["block_type"] in MERGED and a["heading"] == c["heading"] and byte_tokens(a["content"]) + byte_tokens(c["content"]) <= self.config.max_tokens:
                a["content"] += " " + c["content"]
            else:
                merged.append(c)
        return [{"chunk_id": f"{self.file_id}:{i:06d}", "file_id": self.file_id, **c, "start_offset": None, "end_offset": None} for i, c in enumerate(merged)]


def chunk_blocks(file_id: str, blocks: Iterable[dict], config: ChunkConfig = ChunkConfig(), strict: bool = False) -> list[dict]:
    """The chunks of one file's blocks. With ``strict`` no blocks are an error, else they give no chunks."""
    config.checked()
    blocks = list(blocks)
    if strict and not blocks:
        raise ChunkError("no blocks")
    c = Chunker(file_id, config)
    for b in blocks:
        if b.get("kind") == "Text" and config.block_mode == "lines" and "\n" in (b.get("text") or ""):
            for line in b["text"].splitlines():
                c.take({"kind": "Text", "text": line})
        else:
            c.take(b)
    return c.finish()


def chunk(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of ``files`` (file_id, blocks): one row a file with its blocks in order. Files with null id or blocks have none."""
    config.checked()
    names = [f.split()[0] for f in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 32):
                rows = [c for r in b.slice(i, 32).to_pylist() for c in chunk_blocks(r["file_id"], r["blocks"], config)]
                if rows:
                    types = {"page": pa.int32(), "slide": pa.int32(), "start_offset": pa.int32(), "end_offset": pa.int32()}
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)

    picked = files.where(F.col("file_id").isNotNull() & F.col("blocks").isNotNull())
    return picked.select(F.col("file_id").cast("string").alias("file_id"), F.col("blocks").cast(f"array<struct<{BLOCK.replace(' ', ':')}>>".replace(",:", ",")).alias("blocks")).mapInArrow(run, CHUNK)


def gathered(blocks: DataFrame) -> DataFrame:
    """``blocks`` (file_id, block_idx, ...) with one row a file. A file's blocks meet in one task; that is the size of a file."""
    fields = [f.split()[0] for f in BLOCK.split(", ")]
    rows = F.array_sort(F.collect_list(F.struct("block_idx", *fields)))
    return blocks.groupBy("file_id").agg(rows.alias("b")).select("file_id", F.transform("b", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("blocks"))


def text_blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(file_id, blocks) of plain texts: one Text block each."""
    nothing = {"number": "int", "title": "string", "name": "string", "headers": "array<string>", "rows": "array<array<string>>", "caption": "string"}
    block = F.struct(F.lit("Text").alias("kind"), F.col(text).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    return documents.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("file_id"), F.array(block).alias("blocks"))


def sheet_groups(sheets: DataFrame, size: int = 50) -> DataFrame:
    """(file_id, name, part, content): the rows of sheets in groups, cells joined by tabs; without Python and without a shuffle."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("rows") / size).cast("int") - 1, F.lit(0)))
    cut = sheets.select("file_id", "name", "rows", F.explode(parts).alias("part"))
    lines = F.transform(F.slice("rows", F.col("part") * size + 1, F.lit(size)), lambda r: F.concat(F.array_join(r, "\t", ""), F.lit("\n")))
    return cut.select("file_id", "name", "part", F.when(F.size("rows") > 0, F.array_join(lines, "")).otherwise(F.concat(F.lit("[Sheet: "), "name", F.lit("]"))).alias("content"))
