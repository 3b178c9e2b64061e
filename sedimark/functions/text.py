"""Text columns: token estimates, headings, tokens, names of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories that a scan leaves out, and file kinds that it takes.
IGNORED_DIRECTORIES = [".git", "node_modules", ".cache", "__pycache__", ".svn", ".hg", ".idea", ".vscode", "target", "build", "dist", ".next"]
SUPPORTED_EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "txt", "md", "html", "htm", "png", "jpg", "jpeg"]
READABLE_EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "txt", "md", "html", "htm"]
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
}
CATEGORIES = {"Document": ["pdf", "docx"], "Spreadsheet": ["xlsx"], "Presentation": ["pptx"], "Image": ["png", "jpg", "jpeg"], "Text": ["txt", "md", "html", "htm"]}

_PUNCTUATION = "[!-/:-@\\[-`{-~]"


def schema_of(df: DataFrame) -> str:
    """The columns and types of a table, to declare what a mapped one has."""
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def words(c: Column) -> Column:
    """The parts between white space; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def default_tokens(c: Column) -> Column:
    """Words and half the ASCII punctuation signs."""
    t = F.coalesce(c, F.lit(""))
    return (F.size(words(t)) + F.floor(F.regexp_count(t, F.lit(_PUNCTUATION)) / 2)).cast("long")


def byte_tokens(c: Column) -> Column:
    """A quarter of the UTF-8 bytes."""
    return F.floor(F.octet_length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_HEADING = r"(?s)^(#{1,6}) (.*)$"


def heading_level(c: Column) -> Column:
    """1 to 6 if the trimmed text begins as a heading, else null."""
    n = F.length(F.regexp_extract(F.trim(c), _HEADING, 1))
    return F.when(n > 0, n)


def heading_text(c: Column) -> Column:
    """All that follows the signs of a heading, trimmed; null if it is none."""
    return F.when(heading_level(c).isNotNull(), F.trim(F.regexp_extract(F.trim(c), _HEADING, 2)))


def byte_range(c: Column, start: int, end: int) -> Column:
    """The text of bytes [start, end); null where that isn't a proper range of the text or cuts a character."""
    n = F.octet_length(c)
    part = F.try_validate_utf8(F.substring(F.encode(c, "utf-8"), start + 1, end - start).cast("string"))
    return F.when((F.lit(start) < n) & (F.lit(end) <= n) & F.lit(start < end), part)


def last_sentences(c: Column, n: int) -> Column:
    """The last ``n`` sentences that aren't blank, as they stand, without leading space."""
    parts = F.filter(F.split(c, r"(?<=[.!?\n])"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", "")) != "")
    return F.regexp_replace(F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n) if n else F.array().cast("array<string>"), ""), r"(?U)^\s+", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, as it is written; empty if nothing does."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)


def is_hidden(path: Column) -> Column:
    return file_name(path).startswith(".")


def in_ignored_directory(path: Column, names: list[str] | None = None) -> Column:
    parts = F.transform(F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x)
    return F.arrays_overlap(parts, F.array(*[F.lit(n.lower()) for n in (names or IGNORED_DIRECTORIES)]))


def is_supported(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin(SUPPORTED_EXTENSIONS), F.lit(False))


def mime_type(ext: Column) -> Column:
    pairs = [x for e, m in MIME_TYPES.items() for x in (F.lit(e), F.lit(m))]
    return F.coalesce(F.create_map(*pairs)[F.lower(ext)], F.lit("application/octet-stream"))


def category(ext: Column) -> Column:
    e = F.lower(ext)
    return reduce(lambda w, kv: w.when(e.isin(kv[1]), kv[0]), list(CATEGORIES.items())[1:], F.when(e.isin(CATEGORIES["Document"]), "Document")).otherwise("Unknown")


def deterministic_id(path: Column) -> Column:
    return F.sha2(path, 256)


def state_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)
