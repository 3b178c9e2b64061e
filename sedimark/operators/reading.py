"""Parts of documents by selector, outlines, and search within documents, on columns of text.

A text's lines are an array; selectors pick from the array before anything is exploded, so reading a
part of many documents needs no shuffle. Lines count from 0 and end with ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.errors import InvalidSelector
from sedimark.functions import text as T

CONTEXT = 2


def lines(text: Column) -> Column:
    """Array of lines; one empty line after the last line end is none."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _numbered(array: Column) -> Column:
    """Array of (i, text); null stays null."""
    return F.transform(array, lambda x, i: F.struct(i.alias("i"), x.alias("text")))


_ATX = r"^\s*(#{1,6}) +(.*?)\s*$"


def _level(x: Column) -> Column:
    return F.length(F.regexp_extract(x, _ATX, 1))


def _is_heading(x: Column) -> Column:
    return x.rlike(r"^\s*#{1,6} ")


def headings(text: Column) -> Column:
    """Array of (i, level, label) of the Markdown headings."""
    found = F.filter(_numbered(lines(text)), lambda e: _is_heading(e["text"]))
    return F.transform(found, lambda e: F.struct(e["i"].alias("i"), _level(e["text"]).alias("level"), F.regexp_extract(e["text"], _ATX, 2).alias("label")))


def paragraphs(text: Column) -> Column:
    """Array of the Markdown lines that are neither blank nor headings."""
    return F.filter(lines(text), lambda x: (F.trim(x) != "") & ~_is_heading(x))


def paragraph(array: Column, n: int) -> Column:
    """The paragraph with number ``n`` from 0, null where there is none."""
    if n < 0:
        raise InvalidSelector("paragraphs count from 0")
    return F.get(array, F.lit(n))


def part(array: Column, skip: int, take: int) -> Column:
    """``take`` elements after ``skip``, fewer at the end; null where nothing is left, which is no proper part."""
    if skip < 0 or take < 0:
        raise InvalidSelector("skip and take must not be negative")
    return F.when(F.size(array) > skip, F.slice(array, skip + 1, take))


def section(text: Column, heading: str | Column) -> Column:
    """The first heading's line of that name, in any case, and all lines up to the next heading of its level or above; null if there is none."""
    own = lines(text)
    heads = headings(text)
    wanted = F.lit(heading.strip().lower()) if isinstance(heading, str) else F.lower(F.trim(heading))
    start = F.get(F.filter(heads, lambda h: F.lower(h["label"]) == wanted), F.lit(0))
    stop = F.array_min(F.transform(F.filter(heads, lambda h: (h["i"] > start["i"]) & (h["level"] <= start["level"])), lambda h: h["i"]))
    return F.when(start.isNotNull(), F.array_join(F.slice(own, start["i"] + 1, F.coalesce(stop, F.size(own)) - start["i"]), "\n"))


def outline(heads: Column) -> Column:
    """Array of (pos, level, label, parent) of headings; parent is the last earlier one with a smaller level, null for a root."""
    numbered = F.transform(heads, lambda h, i: F.struct(i.alias("pos"), h["level"].alias("level"), h["label"].alias("label")))
    return F.transform(
        numbered,
        lambda h: F.struct(h["pos"].alias("pos"), h["level"].alias("level"), h["label"].alias("label"), F.array_max(F.transform(F.filter(F.slice(numbered, F.lit(1), h["pos"]), lambda o: o["level"] < h["level"]), lambda o: o["pos"])).alias("parent")),
    )


def two_level_outline(heads: Column) -> Column:
    """As ``outline``, but only roots have children: parent is the last root with a smaller level; what has none is a root."""

    def step(acc: Column, h: Column) -> Column:
        roots = F.filter(acc, lambda o: o["parent"].isNull())
        parent = F.when((F.size(roots) > 0) & (F.try_element_at(roots, F.lit(-1))["level"] < h["level"]), F.try_element_at(roots, F.lit(-1))["pos"])
        return F.concat(acc, F.array(F.struct(F.size(acc).alias("pos"), h["level"].alias("level"), h["label"].alias("label"), parent.alias("parent"))))

    return F.aggregate(heads, F.array().cast("array<struct<pos:int,level:int,label:string,parent:int>>"), step)


def matches(text: Column, query: str, context: int = CONTEXT) -> Column:
    """Array of (line, text, context, score) of the lines that contain ``query`` in any case; context joins the lines around."""
    own = lines(text)
    found = F.filter(_numbered(own), lambda e: F.lower(e["text"]).contains(query.lower()))
    around = lambda e: F.array_join(F.slice(own, F.greatest(e["i"] - context, F.lit(0)) + 1, F.least(e["i"], F.lit(context)) + context + 1), "\n")
    return F.transform(found, lambda e: F.struct(e["i"].alias("line"), e["text"].alias("text"), around(e).alias("context"), F.lit(1.0).alias("score")))


def search(documents: DataFrame, key: str, text: str, query: str, context: int = CONTEXT) -> DataFrame:
    """(key, line, text, context, score): the matching lines of all documents. Documents without the text anywhere are left out first."""
    if not query:
        raise InvalidSelector("empty query")
    some = documents.where(F.lower(F.col(text)).contains(query.lower()))
    return some.select(key, F.explode(matches(F.col(text), query, context)).alias("m")).select(key, "m.line", "m.text", "m.context", "m.score")


def grep(documents: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, matches): documents with matching lines and their number."""
    if not query:
        raise InvalidSelector("empty query")
    n = F.size(F.filter(lines(F.col(text)), lambda x: F.lower(x).contains(query.lower())))
    return documents.where(F.lower(F.col(text)).contains(query.lower())).select(key, n.cast("long").alias("matches")).where(F.col("matches") > 0)


def capital_headings(text: Column) -> Column:
    """Array of (level, label) of the lines of a page that are headings by their capitals: level by the number of words."""
    found = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: (F.octet_length(x) > 3) & x.rlike(r"^[\p{Lu}\s\p{Punct}]+$"))
    words = lambda x: F.size(T.words(x))
    return F.transform(found, lambda x: F.struct(F.when(words(x) <= 3, 1).when(words(x) <= 6, 2).otherwise(3).alias("level"), x.alias("label")))


def pages(array: Column, numbers: list[int]) -> Column:
    """The pages with these numbers from 1 that exist, in that order, two line ends between; null if none does."""
    wanted = F.filter(F.transform(F.array(*[F.lit(n) for n in numbers]), lambda n: F.when(n >= 1, F.get(array, n - 1))), lambda p: p.isNotNull())
    return F.when(F.size(wanted) > 0, F.array_join(wanted, "\n\n"))


def cell(rows: Column, reference: str) -> Column:
    """The cell of an A1 reference in an array of rows; empty where the sheet doesn't reach."""
    i, j = cell_position(reference)
    return F.coalesce(F.get(F.get(rows, F.lit(i)), F.lit(j)), F.lit(""))


def cell_position(reference: str) -> tuple[int, int]:
    """(row, column) from 0; letters count A to Z, AA, AB and so on."""
    import re

    m = re.fullmatch(r"\s*([A-Za-z]{1,3})([1-9]\d{0,6})\s*", reference)
    if not m:
        raise InvalidSelector(f"no cell reference: {reference!r}")
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def cell_name(row: Column, column: Column) -> Column:
    """The A1 name of a row and column from 0, up to column ZZ."""
    letter = lambda c: F.char(c + 65)
    return F.concat(F.when(column >= 26, F.concat(letter((column / 26).cast("int") - 1), letter(column % 26))).otherwise(letter(column)), (row + 1).cast("string"))


def table_parts(rows: Column) -> tuple[Column, Column]:
    """(headers, rows): the first row, and the others."""
    return F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")), F.when(F.size(rows) > 1, F.slice(rows, 2, F.size(rows) - 1)).otherwise(F.array().cast("array<array<string>>"))
