"""Queries of scanning, text primitives, reading and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import text as T
from sedimark.operators import chunking, reading
from sedimark.plans.files import _O, contents
from sedimark.sources import formats, scan
from sedimark.sources.tables import table

WORD = "warehouse"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def scan_include(spark, folder):
    return table(spark, folder, "file_meta").select("path").distinct().select("path", scan.include(F.col("path")).alias("included"), T.extension(F.col("path")).alias("ext"), T.is_hidden(F.col("path")).alias("hidden"))


def scan_normalise(spark, folder):
    files = scan.normalise(table(spark, folder, "file_meta").select(F.coalesce(F.lower("extension"), F.lit("")).alias("extension")))
    return files.groupBy("extension", "mime_type", "category").agg(F.count("*").alias("files"))


def scan_ids(spark, folder):
    p = F.col("path")
    return table(spark, folder, "file_meta").select("path").distinct().select("path", T.deterministic_id(p).alias("file_id"), T.state_id(p).alias("state_id"))


def text_hash(spark, folder):
    return _docs(spark, folder).select("doc_id", F.sha2("text", 256).alias("hash"))


def text_tokens(spark, folder):
    return _docs(spark, folder).select("doc_id", T.default_tokens(F.col("text")).alias("tokens"), T.byte_tokens(F.col("text")).alias("quarter_bytes"))


def text_last_sentences(spark, folder):
    return _docs(spark, folder).where(F.col("text").isNotNull()).select("doc_id", T.last_sentences(F.col("text"), 2).alias("last_two"))


def text_lines(spark, folder):
    d = _docs(spark, folder).where(F.col("text").isNotNull())
    return d.select("doc_id", F.posexplode(reading.lines(F.col("text"))).alias("line", "text"))


def text_slice(spark, folder):
    part = reading.part(reading.lines(F.col("text")), 2, 3)
    return _docs(spark, folder).select("doc_id", F.array_join(part, "\n").alias("part"))


def text_range(spark, folder):
    return _docs(spark, folder).select("doc_id", T.byte_range(F.col("text"), 0, 40).alias("part"))


def text_paragraph(spark, folder):
    return _docs(spark, folder).select("doc_id", reading.paragraph(reading.paragraphs(F.col("text")), 1).alias("paragraph"))


def text_headings(spark, folder):
    d = _docs(spark, folder).where(F.col("text").isNotNull())
    return d.select("doc_id", F.inline(reading.headings(F.col("text")))).withColumnRenamed("i", "line")


def text_outline(spark, folder):
    c = table(spark, folder, "html_documents").where(F.col("content").isNotNull()).select("file_id", "content").distinct()
    return c.select("file_id", F.inline(reading.outline(reading.headings(F.col("content")))))


def text_section(spark, folder):
    d = _docs(spark, folder).where(F.col("text").isNotNull())
    first = F.get(reading.headings(F.col("text")), F.lit(0))["label"]
    return d.select("doc_id", first.alias("heading"), reading.section(F.col("text"), first).alias("section")).where(F.col("section").isNotNull())


def text_search(spark, folder):
    return reading.search(_docs(spark, folder), "doc_id", "text", WORD)


def text_grep(spark, folder):
    return reading.grep(_docs(spark, folder), "doc_id", "text", WORD)


def _pdfs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pdf_documents").where(F.col("page_texts").isNotNull()).select("file_id", "title", "page_texts").distinct()


def pdf_pages(spark, folder):
    return _pdfs(spark, folder).select("file_id", reading.pages(F.col("page_texts"), [1, 3, 99]).alias("pages"), F.size("page_texts").alias("page_count"))


def pdf_headings(spark, folder):
    each = _pdfs(spark, folder).select("file_id", F.posexplode("page_texts").alias("page", "text")).where(F.col("text").isNotNull())
    return each.select("file_id", (F.col("page") + 1).alias("page"), F.inline(reading.capital_headings(F.col("text"))))


def pdf_search(spark, folder):
    each = _pdfs(spark, folder).select("file_id", F.posexplode("page_texts").alias("page", "text"))
    return each.where(F.lower("text").contains("tribunal")).select("file_id", (F.col("page") + 1).alias("page"), F.lit(1.0).alias("score"))


def html_elements(spark, folder):
    """Headings, paragraphs, tables and images of the HTML documents, counted."""
    files = table(spark, folder, "html_documents").select("file_id", F.lit("html").alias("extension"), F.encode("content", "utf-8").alias("content")).distinct()
    parsed = formats.parse_files(files)
    return parsed.select("file_id", F.explode("elements").alias("e")).groupBy("file_id", "e.kind").agg(F.count("*").alias("n"))


def chunk_documents(spark, folder):
    """Chunks of all documents."""
    return chunking.chunk(chunking.text_blocks(_docs(spark, folder), "doc_id", "text")).select("chunk_id", "file_id", "content", "heading", "block_type")


def chunk_pages(spark, folder):
    """Chunks of the pages of the PDF documents."""
    page = F.transform("page_texts", lambda t, i: F.struct(F.lit("Page").alias("kind"), t.alias("text"), (i + 1).alias("number"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("string").alias("caption")))
    files = _pdfs(spark, folder).select("file_id", page.alias("blocks"))
    return chunking.chunk(files).select("chunk_id", "file_id", "content", "heading", "page", "block_type")


def chunk_sheets(spark, folder):
    """Groups of at most 20 orders of a customer, as rows of a sheet."""
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("r"))))
    sheets = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg(F.transform(rows, lambda x: x["r"]).alias("rows")).withColumn("name", F.lit("orders"))
    return chunking.sheet_groups(sheets, 20).select("file_id", "part", "content")


def _block(kind: str, **fields) -> F.Column:
    """A block for the chunker; what isn't named is null."""
    types = dict(x.split(" ", 1) for x in chunking.BLOCK.split(", "))
    return F.struct(F.lit(kind).alias("kind"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items() if n != "kind"])


def chunk_sections(spark, folder):
    """Headings, lines, matches, cells and pictures of the orders of each customer, status by status."""
    c = contents(spark, folder)

    def of(p):
        head = F.array(_block("Text", text=F.concat(F.lit("# "), p["label"])))
        pictures = F.array(_block("Image", caption=p["label"]), _block("Image"))
        return F.concat(head, F.transform(p["lines"], lambda x: _block("Text", text=x)), F.array(_block("Match", text=F.lit("found")), _block("Text", text=F.lit("  "))), pictures, F.array(_block("Cell", text=F.lit("42")), _block("Cell", text=F.lit("43")), _block("Metadata")))

    files = c.select("file_id", F.flatten(F.transform("content.parts", of)).alias("blocks"))
    return chunking.chunk(files, chunking.ChunkConfig(include_images=True)).select("chunk_id", "file_id", "content", "heading", "block_type")


def chunk_tables(spark, folder):
    """Tables of the orders of each customer; large ones come with a warning."""
    table_of = _block("Table", headers=F.get("content.rows", F.lit(0)), rows=F.slice("content.rows", 2, 100_000))
    files = contents(spark, folder).select("file_id", F.array(table_of, _block("Image")).alias("blocks"))
    return chunking.chunk(files, chunking.ChunkConfig(min_tokens=10, max_tokens=40)).select("chunk_id", "content", "block_type")


def chunk_page_headings(spark, folder):
    """Pages that begin as headings are headings as a whole."""
    pages = F.transform("content.parts", lambda p, i: _block("Page", number=i + 1, text=F.concat(F.lit("## "), p["label"], F.lit("\n"), F.array_join(p["lines"], "\n"))))
    return chunking.chunk(contents(spark, folder).select("file_id", pages.alias("blocks"))).select("chunk_id", "content", "heading", "page", "block_type")


def chunk_splits(spark, folder):
    """The documents in plain ASCII as slides, cut at the ends of sentences with one sentence of overlap."""
    plain = F.regexp_replace("text", "[^ -~]+", " ")
    files = _docs(spark, folder).where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("file_id"), F.array(_block("Slide", text=plain, number=F.lit(1))).alias("blocks"))
    return chunking.chunk(files, chunking.ChunkConfig(min_tokens=10, max_tokens=50)).select("chunk_id", "content", "slide", "block_type")


QUERIES = {f.__name__: f for f in (chunk_sections, chunk_tables, chunk_page_headings, chunk_splits, scan_include, scan_normalise, scan_ids, text_hash, text_tokens, text_last_sentences, text_lines, text_slice, text_range, text_paragraph, text_headings, text_outline, text_section, text_search, text_grep, pdf_pages, pdf_headings, pdf_search, html_elements, chunk_documents, chunk_pages, chunk_sheets)}

_S = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EXT = "'" + "', '".join(T.SUPPORTED_EXTENSIONS) + "'"
_DIRS = "'" + "', '".join(T.IGNORED_DIRECTORIES) + "'"
_MIME = " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in T.MIME_TYPES.items())
_CATEGORY = " ".join(f"WHEN extension IN ('{"', '".join(es)}') THEN '{c}'" for c, es in T.CATEGORIES.items())
_LINES = r"""
own AS (SELECT %(key)s, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT %(key)s, regexp_split_to_array(%(text)s, '\r?\n') AS l FROM %(table)s WHERE %(text)s IS NOT NULL)),
line AS (SELECT %(key)s, unnest(range(len(l)))::INT AS line, unnest(l) AS text, l FROM own)"""
_DOC_LINES = "WITH" + _LINES % {"key": "doc_id", "text": "text", "table": "documents"}
_HTML_LINES = "WITH" + _LINES % {"key": "file_id", "text": "content", "table": "(SELECT DISTINCT file_id, content FROM html_documents)"}
_IS_HEAD = r"regexp_matches(text, '^\s*#{1,6} ')"
_HEADS = r"SELECT %s, line, length(regexp_extract(text, '^\s*(#{1,6}) +(.*?)\s*$', 1))::INT AS level, regexp_extract(text, '^\s*(#{1,6}) +(.*?)\s*$', 2) AS label FROM line WHERE " + _IS_HEAD
_PAGES = "(SELECT file_id, unnest(range(len(page_texts)))::INT + 1 AS page, unnest(page_texts) AS text FROM (SELECT DISTINCT file_id, title, page_texts FROM pdf_documents WHERE page_texts IS NOT NULL))"
_ID = "file_id || ':' || lpad((%s)::VARCHAR, 6, '0') AS chunk_id"
ORACLE = {
    "chunk_sections": f"""WITH {_O}, x AS (
  SELECT file_id, 5 * n - 5 AS i, label AS content, CASE WHEN n > 1 THEN (SELECT b.label FROM part b WHERE b.file_id = part.file_id AND b.n = part.n - 1) END AS heading, 'Heading' AS block_type FROM part
  UNION ALL SELECT file_id, 5 * n - 4, flat || ' found', label, 'Text' FROM part UNION ALL SELECT file_id, 5 * n - 3, '[Image: ' || label || ']', label, 'Image' FROM part
  UNION ALL SELECT file_id, 5 * n - 2, '[Image]', label, 'Image' FROM part UNION ALL SELECT file_id, 5 * n - 1, '42 43', label, 'Cell' FROM part)
SELECT {_ID % "i"}, file_id, content, heading, block_type FROM x""",
    "chunk_tables": f"""WITH {_O}, x AS (SELECT file_id, grid || chr(10) AS body, strlen(grid || chr(10)) // 4 AS est FROM t)
SELECT {_ID % "0"}, CASE WHEN est > 40 THEN '[WARNING: table exceeds 40 tokens (est. ' || est || ')]' || chr(10) ELSE '' END || body AS content, 'Table' AS block_type FROM x""",
    "chunk_page_headings": f"""WITH {_O}, x AS (SELECT *, label || chr(10) || body AS content FROM part)
SELECT {_ID % "n - 1"}, content, CASE WHEN n > 1 THEN (SELECT b.content FROM x b WHERE b.file_id = x.file_id AND b.n = x.n - 1) END AS heading, n::INT AS page, 'Heading' AS block_type FROM x""",
    "chunk_splits": rf"""
WITH RECURSIVE d AS (SELECT doc_id AS file_id, regexp_replace(text, '[^ -~]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
s(file_id, i, before, part, rest) AS (
  SELECT file_id, -1, '', '', t FROM d
  UNION ALL
  SELECT file_id, i + 1, part, substr(rest, 1, cut), substr(rest, cut + 1) FROM (
    SELECT *, CASE WHEN length(rest) <= 200 THEN length(rest) WHEN regexp_matches(w, '[.!?] ') THEN 99 + length(regexp_extract(w, '^.*?[.!?] ')) WHEN contains(w, ' ') THEN 100 + instr(w, ' ') ELSE 200 END AS cut
    FROM (SELECT *, substr(rest, 101, 100) AS w FROM s WHERE i = -1 OR rest <> '')))
SELECT {_ID % "i"}, CASE WHEN i = 0 THEN part ELSE ltrim(coalesce(list_filter(regexp_extract_all(before, '[^.!?]*[.!?]|[^.!?]+'), lambda x: trim(x) <> '')[-1], '')) || part END AS content, 1::INT AS slide, 'Slide' AS block_type FROM s WHERE i >= 0""",
    "scan_include": rf"""
WITH f AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name FROM file_meta)
SELECT path, lower(regexp_extract(name, '^.+\.([^.]+)$', 1)) IN ({_EXT}) AND NOT starts_with(name, '.') AND NOT list_has_any(string_split(lower(path), '/')[:-2], [{_DIRS}]) AS included,
  regexp_extract(name, '^.+\.([^.]+)$', 1) AS ext, starts_with(name, '.') AS hidden FROM f""",
    "scan_normalise": f"SELECT extension, CASE extension {_MIME} ELSE 'application/octet-stream' END AS mime_type, CASE {_CATEGORY} ELSE 'Unknown' END AS category, count(*) AS files FROM (SELECT coalesce(lower(extension), '') AS extension FROM file_meta) GROUP BY ALL",
    "scan_ids": "SELECT DISTINCT path, sha256(path) AS file_id, substr(sha256(path), 1, 16) AS state_id FROM file_meta",
    "text_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "text_tokens": rf"""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_S}+'), lambda x: x <> '')) + len(regexp_extract_all(coalesce(text, ''), '[!-/:-@\[-`{{-~]')) // 2 AS tokens,
  strlen(coalesce(text, '')) // 4 AS quarter_bytes FROM documents""",
    "text_last_sentences": rf"""SELECT doc_id, regexp_replace(array_to_string(list_filter(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+'), lambda x: regexp_replace(x, '{_S}+', '', 'g') <> '')[-2:], ''), '^{_S}+', '') AS last_two FROM documents WHERE text IS NOT NULL""",
    "text_range": "SELECT doc_id, CASE WHEN strlen(text) >= 40 THEN substr(text, 1, list_filter(range(0, 41), lambda k: strlen(substr(text, 1, k::BIGINT)) = 40)[1]::BIGINT) END AS part FROM documents",
    "text_lines": _DOC_LINES + " SELECT doc_id, line, text FROM line",
    "text_slice": _DOC_LINES + " SELECT d.doc_id, CASE WHEN len(l) > 2 THEN array_to_string(l[3:5], chr(10)) END AS part FROM documents d LEFT JOIN own ON own.doc_id = d.doc_id",
    "text_paragraph": _DOC_LINES + rf", p AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM line WHERE trim(text) <> '' AND NOT {_IS_HEAD}) SELECT d.doc_id, p.text AS paragraph FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND n = 2",
    "text_headings": _DOC_LINES + " " + _HEADS % "doc_id",
    "text_outline": _HTML_LINES + ", h AS (SELECT *, row_number() OVER (PARTITION BY file_id, l ORDER BY line)::INT - 1 AS pos FROM (" + _HEADS.replace("SELECT %s", "SELECT file_id, l") + ")) SELECT file_id, pos, level, label, (SELECT max(o.pos) FROM h o WHERE o.file_id = h.file_id AND o.l = h.l AND o.pos < h.pos AND o.level < h.level) AS parent FROM h",
    "text_section": _DOC_LINES + ", h AS (" + _HEADS % "doc_id" + f"""),
s AS (SELECT doc_id, min(line) AS start FROM h GROUP BY doc_id),
b AS (SELECT s.doc_id, start, level FROM s JOIN h ON h.doc_id = s.doc_id AND h.line = start),
e AS (SELECT b.doc_id, start, min(h.line) AS stop FROM b LEFT JOIN h ON h.doc_id = b.doc_id AND h.line > start AND h.level <= b.level GROUP BY ALL)
SELECT e.doc_id, (SELECT arg_min(label, line) FROM h WHERE h.doc_id = e.doc_id) AS heading, array_to_string(l[start + 1 : coalesce(stop, len(l))], chr(10)) AS section FROM e JOIN own ON own.doc_id = e.doc_id""",
    "text_search": _DOC_LINES + f" SELECT doc_id, line, text, array_to_string(l[greatest(line - 1, 1) : line + 3], chr(10)) AS context, 1.0::DOUBLE AS score FROM line WHERE contains(lower(text), '{WORD}')",
    "text_grep": _DOC_LINES + f" SELECT doc_id, count(*) AS matches FROM line WHERE contains(lower(text), '{WORD}') GROUP BY doc_id",
    "pdf_pages": "SELECT file_id, array_to_string(list_filter([page_texts[1], page_texts[3]], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS pages, len(page_texts)::INT AS page_count FROM (SELECT DISTINCT file_id, title, page_texts FROM pdf_documents WHERE page_texts IS NOT NULL)".replace("array_to_string(", "nullif(CASE WHEN coalesce(page_texts[1], page_texts[3]) IS NULL THEN chr(0) ELSE array_to_string(").replace("chr(10) || chr(10))", "chr(10) || chr(10)) END, chr(0))"),
    "pdf_headings": rf"""
SELECT file_id, page, CASE WHEN n <= 3 THEN 1 WHEN n <= 6 THEN 2 ELSE 3 END::INT AS level, label FROM (
  SELECT *, len(list_filter(regexp_split_to_array(label, '{_S}+'), lambda x: x <> '')) AS n FROM (
    SELECT file_id, page, trim(unnest(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END)) AS label FROM (SELECT file_id, page, regexp_split_to_array(text, '\r?\n') AS l FROM {_PAGES} WHERE text IS NOT NULL))
  WHERE strlen(label) > 3 AND regexp_matches(label, '^[\p{{Lu}}\s\x{{0B}}!-/:-@\[-`{{-~]+$'))""",
    "pdf_search": f"SELECT file_id, page, 1.0::DOUBLE AS score FROM {_PAGES} WHERE contains(lower(text), 'tribunal')",
    "chunk_sheets": """
WITH r AS (SELECT o_custkey AS file_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 20 AS part, o_orderkey, o_orderkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority || chr(10) AS line FROM orders)
SELECT file_id, part::INT AS part, string_agg(line, '' ORDER BY o_orderkey) AS content FROM r GROUP BY file_id, part""",
}
