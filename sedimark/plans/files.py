"""Queries of parsers, selectors, outlines and searches: files of each format are written from the orders of every customer, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark import api
from sedimark.operators import embedding, indexing
from sedimark.operators.chunking import ChunkConfig
from sedimark.operators.store import Store
from sedimark.sources import documents, scan, writers
from sedimark.sources.tables import table
from sedimark.storage_paths import shared_dir, written
from sedimark.streaming import watch

URGENT = "1-urgent"


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, content): a customer's orders as the content of a file, a part for each status."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    line = F.concat(F.lit("Order "), key.cast("string"), F.lit(" is "), F.col("o_orderpriority"), F.lit("."))
    parts = o.groupBy("c_custkey", "c_name", "c_mktsegment", "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("line"), F.array(key.cast("string"), F.col("o_orderpriority")).alias("row")))).alias("x"))
    whole = parts.groupBy("c_custkey", "c_name", "c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "x"))).alias("p"))
    made = F.transform("p", lambda p: F.struct(F.concat(F.lit("STATUS "), p["o_orderstatus"]).alias("label"), F.transform(p["x"], lambda e: e["line"]).alias("lines")))
    rows = F.transform(F.array_sort(F.flatten(F.transform("p", lambda p: p["x"]))), lambda e: e["row"])
    content = F.struct(F.concat(F.lit("Orders of "), "c_name").alias("title"), F.col("c_mktsegment").alias("author"), made.alias("parts"), F.concat(F.array(F.array(F.lit("key"), F.lit("priority"))), rows).alias("rows"), F.col("c_name").alias("picture"))
    return whole.select(F.col("c_custkey").cast("string").alias("file_id"), content.alias("content"))


def _files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    return writers.made(contents(spark, folder), extension)


def _reads(extension: str, **requests: tuple):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return documents.read_parts(_files(spark, folder, extension), requests)

    return query


def _of(extension: str, operator, *columns: str, **options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = operator(_files(spark, folder, extension), **options)
        return found.select(*columns) if columns else found

    return query


def parse_errors(spark, folder):
    """Files of a format that nobody reads, broken ones and sound ones, named by their nation."""
    n = table(spark, folder, "nation")
    ext = F.when(F.col("n_regionkey") == 0, "xyz").when(F.col("n_regionkey") == 1, "docx").when(F.col("n_regionkey") == 2, "pdf").otherwise("TXT")
    files = n.select(F.col("n_name").alias("file_id"), ext.alias("extension"), F.encode("n_name", "utf-8").alias("content"))
    return documents.facts(files).select("file_id", "size", "error")


def _saved(spark: SparkSession, folder: str, files: DataFrame) -> str:
    """The local path of a new folder with the files (name, content)."""
    url = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    writers.saved(files, url)
    return writers.folder_of(spark, url)


def _below(path, root: str):
    return F.substring(path, len(root.rstrip("/")) + 2, 10_000)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a file in the folder of its language; those without one lie where no scan looks."""
    d = table(spark, folder, "documents").where(F.col("text").isNotNull())
    at = F.when(F.col("lang").isNull(), "node_modules").otherwise(F.concat(F.lit("lang_"), F.regexp_replace("lang", r"[^A-Za-z]", "")))
    return d.select(F.concat(at, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "utf-8").alias("content"))


def scan_folder(spark, folder):
    """A scan of the documents' files, each hash checked once more against the file."""
    root = _saved(spark, folder, _texts(spark, folder))
    found = scan.verified(scan.scan(spark, root))
    return found.select(_below(F.col("path"), root).alias("name"), "hash", "size", "extension", "verified")


def scan_predicate(spark, folder):
    root = _saved(spark, folder, _texts(spark, folder))
    found = scan.scan(spark, root, ("lang_d?",), lambda path: "/lang_fr/" not in path, hashed=False)
    return found.select(_below(F.col("path"), root).alias("name"), "hash")


def grep_folder(spark, folder):
    """Matches over a directory with files of two formats."""
    docs = writers.made(contents(spark, folder), "docx").unionByName(writers.made(contents(spark, folder), "txt"))
    root = _saved(spark, folder, docs.select(F.concat("file_id", F.lit("."), "extension").alias("name"), "content"))
    return api.grep_docs(spark, root, URGENT).select(_below(F.col("path"), root).alias("name"), "matches")


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content): a Markdown file for each nation with its suppliers."""
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.concat(F.lit("Office of "), "s_name"))).alias("lines"))
    n = table(spark, folder, "nation").join(s, "n_nationkey", "left")
    part = F.struct(F.lit("Suppliers").alias("label"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    none = F.lit(None).cast("string")
    content = F.struct(F.col("n_name").alias("title"), none.alias("author"), F.array(part).alias("parts"), F.lit(None).cast("array<array<string>>").alias("rows"), none.alias("picture"))
    files = writers.made(n.select(F.col("n_name").alias("file_id"), content.alias("content")), "md")
    return files.select(F.concat("file_id", F.lit(".md")).alias("name"), "content")


def _indexed(spark: SparkSession, folder: str) -> tuple[Store, str, list[indexing.IndexReport]]:
    """A store with the nations' files, indexed twice."""
    root = _saved(spark, folder, _nations(spark, folder))
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    e = embedding.HashingEmbedder(16)
    return store, root, [indexing.index(store, root, e) for _ in range(2)]


def index_folder(spark, folder):
    """The chunks that indexing a directory leaves in the store."""
    store, root, _ = _indexed(spark, folder)
    files = store.files.read().select("file_id", _below(F.col("path"), root).alias("name"))
    return store.chunks.read().join(files, "file_id").select("name", "content", "heading", "block_type", "model", "dimension")


def index_twice(spark, folder):
    """What two runs over the same directory report, and the states after them."""
    store, _, reports = _indexed(spark, folder)
    rows = [(i, r.total, r.indexed, r.skipped, r.failed, r.chunks) for i, r in enumerate([*reports, reports[0].merge(reports[1])])]
    n = store.state.read().where("status = 'Indexed'").count()
    return spark.createDataFrame([*rows, (3, n, n, 0, 0, store.chunks.count())], "run int, total long, indexed long, skipped long, failed long, chunks long")


def watch_folder(spark, folder):
    """A watched directory, read as a stream until nothing is left; the stream's batches are written and read again. Empty files are no events."""
    root = _saved(spark, folder, _texts(spark, folder))
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    handle = lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/batch={n}")
    query = watch.start(watch.watch(spark, "file://" + root, 5000), handle, f"{place}-checkpoint", once=True)
    query.awaitTermination()
    seen = written(spark.read.option("basePath", place).parquet(place).drop("batch"), "seen")
    return seen.select(_below(F.col("path"), root).alias("name"), "hash", "size", "extension").distinct()


_LAYOUT = {
    "docx": dict(whole=(), heading=("heading", "status o"), paragraph=("paragraph", 2), table=("table", 0), image=("image", 0), slice=("slice", (1, 2)), page=("page", 1)),
    "html": dict(whole=(), heading=("heading", "STATUS O"), paragraph=("paragraph", 0), table=("table", 0), image=("image", 0), slice=("slice", (0, 2)), range=("range", (0, 6)), cell=("cell", "A1")),
    "xlsx": dict(whole=(), sheet=("sheet", "table"), cell=("cell", "B2"), far=("cell", "AZ999"), table=("table", 1), slice=("slice", (0, 1)), slide=("slide", 1)),
    "pptx": dict(whole=(), slide=("slide", 2), note=("note", 1), paragraph=("paragraph", 0), image=("image", 0), slice=("slice", (0, 1)), sheet=("sheet", "x")),
    "pdf": dict(whole=(), page=("page", 1), pages=("pages", [3, 1]), heading=("heading", "status o"), range=("range", (0, 6)), slice=("slice", (0, 1)), image=("image", 0)),
    "md": dict(whole=(), heading=("heading", "status o"), paragraph=("paragraph", 0), range=("range", (2, 8)), slice=("slice", (2, 2)), table=("table", 0)),
    "txt": dict(whole=(), paragraph=("paragraph", 0), range=("range", (0, 5)), slice=("slice", (0, 1)), heading=("heading", "x")),
}
QUERIES = {f.__name__: f for f in (parse_errors, scan_folder, scan_predicate, grep_folder, index_folder, index_twice, watch_folder)}
for _e, _requests in _LAYOUT.items():
    QUERIES[f"{_e}_read"] = _reads(_e, **_requests)
    QUERIES[f"{_e}_facts"] = _of(_e, documents.facts, "file_id", "format", "page_count", "title", "author", "error")
    QUERIES[f"{_e}_searched"] = _of(_e, documents.searches, query=URGENT)
    QUERIES[f"{_e}_blocks"] = _of(_e, documents.whole_blocks)
    QUERIES[f"{_e}_chunks"] = _of(_e, documents.document_chunks, config=ChunkConfig(rows_per_chunk=5))
    if _e != "txt":
        QUERIES[f"{_e}_outlined"] = _of(_e, documents.outlines)

_O = """
o AS (SELECT c_custkey::VARCHAR AS file_id, 'Orders of ' || c_name AS title, c_name, c_mktsegment AS author, o_orderkey AS k, o_orderstatus AS s, 'STATUS ' || o_orderstatus AS label, o_orderpriority AS p,
  'Order ' || o_orderkey || ' is ' || o_orderpriority || '.' AS line, dense_rank() OVER (PARTITION BY c_custkey ORDER BY o_orderstatus) AS n, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderstatus, o_orderkey) AS i,
  row_number() OVER (PARTITION BY c_custkey, o_orderstatus ORDER BY o_orderkey) AS j, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey),
part AS (SELECT file_id, title, c_name, author, s, label, n, count(*) AS c, string_agg(line, chr(10) ORDER BY k) AS body, string_agg(line, ' ' ORDER BY k) AS flat FROM o GROUP BY ALL),
f AS (SELECT file_id, title, c_name, author, max(n) AS parts, string_agg(label || chr(10) || body, chr(10) ORDER BY n) AS labelled, string_agg(body, chr(10) ORDER BY n) AS bodies FROM part GROUP BY ALL),
t AS (SELECT file_id, 'key' || chr(9) || 'priority' || chr(10) || string_agg(k || chr(9) || p, chr(10) ORDER BY k) AS grid FROM o GROUP BY ALL),
ff AS (SELECT * FROM f JOIN t USING (file_id))"""
_Q = f"WITH {_O}, x(file_id, request, part, text, error) AS (%s) SELECT file_id, request, part::INT AS part, text, error FROM x"
_ONE = "SELECT file_id, '%s' AS request, 0 AS part, %s AS text, NULL AS error FROM %s"
_NO = "SELECT file_id, '%s' AS request, 0 AS part, NULL AS text, 'InvalidSelector' AS error FROM f"


def _one(name: str, text: str, source: str = "ff") -> str:
    return _ONE % (name, text, source)


def _maybe(name: str, text: str, on: str) -> str:
    """The text of the part where ``on`` holds, and the error of files that have none."""
    return f"SELECT f.file_id, '{name}', 0, {text}, CASE WHEN part.file_id IS NULL THEN 'InvalidSelector' END FROM f LEFT JOIN part ON part.file_id = f.file_id AND {on}"


_PARTS = "SELECT file_id, '%s', n - 1, %s, NULL FROM part"
_IS_O = "part.s = 'O'"
_DOCX_LINES = "(SELECT file_id, title AS x, 0 AS pos FROM f UNION ALL SELECT file_id, label, n + min(i) - 1 FROM o GROUP BY file_id, label, n UNION ALL SELECT file_id, line, n + i FROM o)"
_SLICE = "SELECT file_id, 'slice', pos - %d, x, NULL FROM (%s) WHERE pos >= %d AND pos < %d"
_READ = {
    "docx": [_one("whole", "title || chr(10) || labelled"), _maybe("heading", "body", _IS_O), _one("paragraph", "line", "o WHERE i = 1"), _one("table", "grid"), _one("image", "'image1.png:' || sha256(c_name)"), _SLICE % (1, f"SELECT * FROM {_DOCX_LINES}", 1, 3), _NO % "page"],
    "html": [_one("whole", "title || chr(10) || labelled"), _maybe("heading", "body", _IS_O), _one("paragraph", "line", "o WHERE i = 1"), _one("table", "grid"), _one("image", "c_name || ':' || sha256('')"), _SLICE % (0, "SELECT file_id, line AS x, i - 1 AS pos FROM o", 0, 2), _one("range", "'<html>'"), _NO % "cell"],
    "xlsx": [_one("whole", "grid"), "SELECT file_id, 'whole', n, body, NULL FROM part", _one("sheet", "grid"), _one("cell", "p", "o WHERE r = 1"), _one("far", "''"), _one("table", "body", "part WHERE n = 1"), _one("slice", "grid"), _NO % "slide"],
    "pptx": [_PARTS % ("whole", "label || ' ' || flat"), _maybe("slide", "label || ' ' || flat", "part.n = 2"), _one("note", "label || ' ' || flat", "part WHERE n = 1"), _one("paragraph", "label || ' ' || flat", "part WHERE n = 1"), _one("image", "'image1.png:' || sha256(c_name)"), _one("slice", "label || ' ' || flat", "part WHERE n = 1"), _NO % "sheet"],
    "pdf": [_PARTS % ("whole", "label || chr(10) || body"), _one("page", "label || chr(10) || body", "part WHERE n = 1"), "SELECT file_id, 'pages', 0, string_agg(label || chr(10) || body, chr(10) || chr(10) ORDER BY n DESC), NULL FROM part WHERE n <> 2 GROUP BY file_id", _maybe("heading", "label || chr(10) || body", _IS_O), _one("range", "'STATUS'"), _one("slice", "label || chr(10) || body", "part WHERE n = 1"), _NO % "image"],
    "md": [
        "SELECT file_id, 'whole', 0, '# ' || title || chr(10) || chr(10) || string_agg('## ' || label || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY n), NULL FROM part GROUP BY file_id, title",
        "SELECT f.file_id, 'heading', 0, '## ' || label || chr(10) || chr(10) || body || CASE WHEN n < parts THEN chr(10) ELSE '' END, CASE WHEN part.file_id IS NULL THEN 'InvalidSelector' END FROM f LEFT JOIN part ON part.file_id = f.file_id AND part.s = 'O'",
        _one("paragraph", "line", "o WHERE i = 1"), _one("range", "'Orders'"), "SELECT file_id, 'slice', 0, '## ' || label, NULL FROM part WHERE n = 1", "SELECT file_id, 'slice', 1, '', NULL FROM f", _NO % "table",
    ],
    "txt": [_one("whole", "bodies"), _one("paragraph", "line", "o WHERE i = 1"), _one("range", "'Order'"), _one("slice", "line", "o WHERE i = 1"), _NO % "heading"],
}
_HIT = "contains(lower(%s), '1-urgent')"
_COUNT = {"docx": "CASE WHEN parts > 1 THEN parts END", "pptx": "parts", "pdf": "parts"}
_AUTHOR = {"docx", "pptx", "xlsx", "pdf"}
_PLACE = "SELECT file_id, %s AS place, %s AS text, %s AS context FROM %s WHERE " + _HIT
_SEARCHED = {
    "docx": _PLACE % ("(n + i)::VARCHAR", "line", "''", "o", "line"),
    "html": _PLACE % ("(i - 1)::VARCHAR", "line", "''", "o", "line"),
    "xlsx": _PLACE % ("'B' || (r + 1)", "p", "'Sheet: Table'", "o", "p") + " UNION ALL " + _PLACE % ("'A' || j", "line", "'Sheet: ' || label", "o", "line"),
    "pptx": _PLACE % ("n::VARCHAR", "label || ' ' || flat", "''", "part", "flat"),
    "pdf": _PLACE % ("n::VARCHAR", "label || chr(10) || body", "''", "part", "body"),
    "txt": "SELECT file_id, place, text, context FROM (SELECT file_id, (i - 1)::VARCHAR AS place, line AS text, string_agg(line, chr(10)) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM o) WHERE " + _HIT % "text",
    "md": "SELECT file_id, (pos - 1)::VARCHAR AS place, x AS text, context FROM (SELECT *, string_agg(x, chr(10)) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM (SELECT file_id, x, row_number() OVER (PARTITION BY file_id ORDER BY n, g) AS pos FROM (SELECT file_id, unnest(['# ' || title, '']) AS x, 0 AS n, unnest([0, 1]) AS g FROM f UNION ALL SELECT file_id, unnest(['## ' || label, '']), n, unnest([-2, -1]) FROM part UNION ALL SELECT file_id, line, n, j FROM o UNION ALL SELECT file_id, '', n, 1000000 FROM part JOIN f USING (file_id) WHERE n < parts))) WHERE " + _HIT % "x",
}
_BLOCK = "SELECT file_id, (%s)::INT AS block, '%s' AS kind, (%s)::INT AS number, (%s)::VARCHAR AS title, (%s)::VARCHAR AS name, %s AS text FROM %s"
_BLOCKS = {
    "docx": _BLOCK % ("0", "Text", "NULL", "NULL", "NULL", "title || chr(10) || labelled", "f"),
    "html": _BLOCK % ("0", "Text", "NULL", "NULL", "NULL", "title || chr(10) || labelled", "f"),
    "xlsx": _BLOCK % ("0", "Sheet", "0", "NULL", "'Table'", "grid", "ff") + " UNION ALL " + _BLOCK % ("n", "Sheet", "n", "NULL", "label", "body", "part"),
    "pptx": _BLOCK % ("n - 1", "Slide", "n", "label", "NULL", "label || ' ' || flat", "part"),
    "pdf": _BLOCK % ("n - 1", "Page", "n", "NULL", "NULL", "label || chr(10) || body", "part"),
    "md": "SELECT file_id, 0::INT AS block, 'Text' AS kind, NULL::INT AS number, NULL::VARCHAR AS title, NULL::VARCHAR AS name, '# ' || title || chr(10) || chr(10) || string_agg('## ' || label || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY n) AS text FROM part GROUP BY file_id, part.title",
    "txt": _BLOCK % ("0", "Text", "NULL", "NULL", "NULL", "bodies", "f"),
}
_CHUNK = "SELECT file_id, (%s)::INT AS chunk, %s AS content, (%s)::VARCHAR AS heading, (%s)::INT AS page, (%s)::INT AS slide, (%s)::VARCHAR AS sheet, '%s' AS block_type FROM %s"
_FLAT = "replace(%s, chr(10), ' ')"
_GROUPS = "(SELECT file_id, sheet, n, g, string_agg(x || chr(10), '' ORDER BY pos) AS body FROM (SELECT file_id, 'Table' AS sheet, 0 AS n, r // 5 AS g, k || chr(9) || p AS x, r AS pos FROM o UNION ALL SELECT file_id, 'Table', 0, 0, 'key' || chr(9) || 'priority', 0 FROM f UNION ALL SELECT file_id, label, n, (j - 1) // 5, line, j FROM o) GROUP BY ALL)"
_CHUNKS = {
    "docx": _CHUNK % ("0", _FLAT % "title || chr(10) || labelled", "NULL", "NULL", "NULL", "NULL", "Text", "f"),
    "html": _CHUNK % ("0", _FLAT % "title || chr(10) || labelled", "NULL", "NULL", "NULL", "NULL", "Text", "f"),
    "xlsx": _CHUNK % ("row_number() OVER (PARTITION BY file_id ORDER BY n, g) - 1", "body", "sheet", "NULL", "NULL", "sheet", "Sheet", _GROUPS),
    "pptx": _CHUNK % ("n - 1", "label || ': ' || label || ' ' || flat", "label", "NULL", "n", "NULL", "Slide", "part"),
    "pdf": _CHUNK % ("0", "string_agg(label || chr(10) || body, ' ' ORDER BY n)", "NULL", "max(n)", "NULL", "NULL", "Page", "part GROUP BY file_id"),
    "md": _CHUNK % ("0", "title", "NULL", "NULL", "NULL", "NULL", "Heading", "f") + " UNION ALL " + _CHUNK % ("2 * n - 1", "label", "CASE WHEN n = 1 THEN title ELSE (SELECT b.label FROM part b WHERE b.file_id = part.file_id AND b.n = part.n - 1) END", "NULL", "NULL", "NULL", "Heading", "part") + " UNION ALL " + _CHUNK % ("2 * n", "flat", "label", "NULL", "NULL", "NULL", "Text", "part"),
    "txt": _CHUNK % ("0", _FLAT % "bodies", "NULL", "NULL", "NULL", "NULL", "Text", "f"),
}
_TREE = "SELECT file_id, 0::INT AS pos, 1::INT AS level, title AS label, NULL::INT AS parent FROM f UNION ALL SELECT file_id, n::INT, 2, label, 0 FROM part"
_ROOTS = "SELECT file_id, (n - 1)::INT AS pos, 1::INT AS level, label, NULL::INT AS parent FROM part"
_OUTLINED = {"docx": _TREE, "html": _TREE, "md": _TREE, "pptx": _ROOTS, "pdf": _ROOTS, "xlsx": "SELECT file_id, 0::INT AS pos, 1::INT AS level, 'Table' AS label, NULL::INT AS parent FROM f UNION ALL SELECT file_id, n::INT, 1, label, NULL FROM part"}
_NAME = "CASE WHEN lang IS NULL THEN 'node_modules' ELSE 'lang_' || regexp_replace(lang, '[^A-Za-z]', '', 'g') END || '/' || doc_id || '.txt'"
ORACLE = {
    "parse_errors": "SELECT n_name AS file_id, CASE WHEN n_regionkey > 2 THEN strlen(n_name) END AS size, CASE n_regionkey WHEN 0 THEN 'UnsupportedFormat' WHEN 1 THEN 'CorruptDocument' WHEN 2 THEN 'CorruptDocument' END AS error FROM nation",
    "scan_folder": f"SELECT {_NAME} AS name, sha256(text) AS hash, strlen(text) AS size, 'txt' AS extension, true AS verified FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL",
    "scan_predicate": f"SELECT name, NULL::VARCHAR AS hash FROM (SELECT {_NAME} AS name FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) WHERE NOT starts_with(name, 'lang_fr/') AND NOT regexp_matches(name, '^lang_d./')",
    "grep_folder": f"WITH {_O} SELECT file_id || e AS name, count(*) AS matches FROM o, (VALUES ('.docx'), ('.txt')) v(e) WHERE {_HIT % 'line'} GROUP BY ALL",
    "index_folder": """
WITH s AS (SELECT n_name, string_agg('Office of ' || s_name, ' ' ORDER BY s_name) AS flat FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name),
c AS (SELECT n_name || '.md' AS name, n_name AS content, NULL AS heading, 'Heading' AS block_type FROM s UNION ALL SELECT n_name || '.md', 'Suppliers', n_name, 'Heading' FROM s UNION ALL SELECT n_name || '.md', flat, 'Suppliers', 'Text' FROM s WHERE flat IS NOT NULL)
SELECT *, 'hashing' AS model, 16::BIGINT AS dimension FROM c""",
    "index_twice": """
WITH n AS (SELECT count(*) AS n, (SELECT 2 * count(*) FROM nation) + (SELECT count(DISTINCT s_nationkey) FROM supplier) AS c FROM nation)
SELECT unnest([0, 1, 2, 3])::INT AS run, unnest([n, n, 2 * n, n]) AS total, unnest([n, 0, n, n]) AS indexed, unnest([0, n, n, 0]) AS skipped, 0::BIGINT AS failed, unnest([c, 0, c, c]) AS chunks FROM n""",
    "watch_folder": f"SELECT name, hash, size, 'txt' AS extension FROM (SELECT {_NAME} AS name, sha256(text) AS hash, strlen(text) AS size FROM documents WHERE text <> '' AND lang IS NOT NULL)",
}
for _e in _LAYOUT:
    ORACLE[f"{_e}_read"] = _Q % " UNION ALL ".join(_READ[_e])
    ORACLE[f"{_e}_facts"] = f"WITH {_O} SELECT file_id, '{_e}' AS format, ({_COUNT.get(_e, 'NULL')})::INT AS page_count, {'title' if _e in _AUTHOR else 'NULL'}::VARCHAR AS title, {'author' if _e in _AUTHOR else 'NULL'}::VARCHAR AS author, NULL::VARCHAR AS error FROM f"
    ORACLE[f"{_e}_searched"] = f"WITH {_O} {_SEARCHED[_e]}"
    ORACLE[f"{_e}_blocks"] = f"WITH {_O} {_BLOCKS[_e]}"
    ORACLE[f"{_e}_chunks"] = f"WITH {_O} {_CHUNKS[_e]}"
    if _e != "txt":
        ORACLE[f"{_e}_outlined"] = f"WITH {_O} {_OUTLINED[_e]}"
