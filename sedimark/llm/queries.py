"""Queries of the operators for training data, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import encode, leak, markup, neardup, nearest, rank, scans, subjects
from sedimark.sources.tables import table

SCORES = ["vector_score", "fts_score", "graph_score"]


def _markup(spark: SparkSession, folder: str) -> DataFrame:
    pages = markup.clean(table(spark, folder, "html_documents"), "file_id", "content", markup.host_of("path"))
    chunks = markup.clean(table(spark, folder, "chunks"), "chunk_id", "content")
    return pages.select(F.lit("html_documents").alias("table_name"), "*").unionByName(chunks.select(F.lit("chunks").alias("table_name"), "*"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _markup(spark, folder).select("table_name", F.col("id").alias("record_id"), F.explode("kinds").alias("kind"))
    # of a record with several contents; at most six kinds
    kinds = found.groupBy("table_name", "record_id").agg(F.collect_set("kind").alias("k"))
    return kinds.select("table_name", "record_id", F.explode(F.when(F.size("k") > 1, F.array_remove("k", "other")).otherwise(F.col("k"))).alias("kind"))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every record that holds markup."""
    return _markup(spark, folder).where(F.size("kinds") > 0).select("table_name", F.col("id").alias("record_id"), "text").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest.nearest(table(spark, folder, "chunks"), k=5, min_similarity=0.8)
    return found.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return rank.leximin_top(table(spark, folder, "ranked_chunks"), "query_id", "chunk_id", SCORES, 5).select("query_id", "chunk_id")


def p5_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten candidates with their places and what supports them."""
    r = rank.leximin_top(table(spark, folder, "ranked_chunks"), "query_id", "chunk_id", SCORES, 10)
    return r.select("query_id", "chunk_id", "place", *[F.col("supports")[i].alias(s.replace("_score", "_support")) for i, s in enumerate(SCORES)])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = scans.documents(table(spark, folder, "pdf_documents"))
    return scans.noise(scans.fit(docs)).select(F.col("id").alias("file_id"), "page_no", "line_no", "kind")


def p6_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous text of every document."""
    docs = scans.documents(table(spark, folder, "pdf_documents"))
    return scans.paragraphs(scans.fit(docs)).withColumnRenamed("id", "file_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    members, pairs = neardup.near_duplicates(table(spark, folder, "chunks"), size=3, similarity=0.5, least=40)
    return neardup.duplicate_pairs(members, pairs).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item that leaked, in how many documents, and the longest passage in words."""
    found = leak.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each source when the documents with a leak are removed."""
    docs = table(spark, folder, "documents")
    found = leak.find_leaks(docs, table(spark, folder, "eval_items"))
    return leak.without_leaks(docs, found).groupBy("source").agg(F.count("*").alias("documents"))


def p9_places(spark: SparkSession, folder: str) -> DataFrame:
    """The longest passage of every pair: how many words, and at which word of the document the first such begins."""
    return leak.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    model, occurrences = subjects.fit(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))
    return subjects.assign(model, occurrences).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject."""
    return p10_found(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_text, p4_found, p5_found, p5_order, p6_found, p6_paragraphs, p7_found, p8_ids, p9_found, p9_items, p9_kept, p9_places, p10_found, p10_composition)}

_P5 = """
WITH c AS (
  SELECT query_id, chunk_id, max(CASE WHEN NOT isnan(vector_score) THEN vector_score END)::DOUBLE AS a,
    max(CASE WHEN NOT isnan(fts_score) THEN fts_score END)::DOUBLE AS b, max(CASE WHEN NOT isnan(graph_score) THEN graph_score END)::DOUBLE AS c
  FROM ranked_chunks WHERE chunk_id IS NOT NULL GROUP BY ALL),
s AS (
  SELECT *, count(*) OVER q AS n, CASE WHEN a IS NULL THEN 0 ELSE n - rank() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST) + 1 END AS x,
    CASE WHEN b IS NULL THEN 0 ELSE n - rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) + 1 END AS y,
    CASE WHEN c IS NULL THEN 0 ELSE n - rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST) + 1 END AS z
  FROM c WINDOW q AS (PARTITION BY query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_sort([x, y, z]) DESC, chunk_id) AS place FROM s)
SELECT %s FROM r WHERE place <= %d
"""
_P4 = """
WITH u AS (SELECT DISTINCT chunk_id, model, dimension, embedding::DOUBLE[] AS e FROM chunks WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = dimension AND dimension > 0
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, max(list_cosine_similarity(a.e, b.e)) AS s FROM u a JOIN u b ON a.model IS NOT DISTINCT FROM b.model AND a.dimension = b.dimension AND a.chunk_id <> b.chunk_id GROUP BY ALL),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s WHERE s >= 0.8)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE n <= 5
"""
_WORDS = "regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+')"
_P7 = f"""
WITH t AS (SELECT DISTINCT chunk_id, content, w FROM (SELECT chunk_id, content, {_WORDS % 'content'} AS w FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL) WHERE len(w) >= 40),
g AS (SELECT DISTINCT chunk_id, content, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
n AS (SELECT chunk_id, content, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.chunk_id AS a, a.content AS x, b.chunk_id AS b, b.content AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT DISTINCT a AS chunk_a, b AS chunk_b FROM c JOIN n p ON p.chunk_id = a AND p.content = x JOIN n q ON q.chunk_id = b AND q.content = y WHERE 2 * c >= p.n + q.n - c
"""
_P9 = f"""
WITH d AS (SELECT doc_id, {_WORDS % 'text'} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS % 'text'} AS w FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
y AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (s)
"""
_P9P = f"""
WITH d AS (SELECT doc_id, {_WORDS % 'text'} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS % 'text'} AS w FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT doc_id, k, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
y AS (SELECT item_id, k, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
m AS (SELECT DISTINCT doc_id, item_id, x.k AS a, y.k AS b FROM x JOIN y USING (s)),
g AS (SELECT doc_id, item_id, a, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS run, a - b AS diagonal FROM m),
r AS (SELECT doc_id, item_id, min(a) AS a, count(*) + 11 AS words FROM g GROUP BY doc_id, item_id, diagonal, run),
best AS (SELECT doc_id, item_id, words, a - 1 AS place, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, a) AS n FROM r)
"""
ORACLE = {
    "p9_items": _P9P + "SELECT item_id, count(*) AS documents, max(words) AS longest FROM best WHERE n = 1 GROUP BY item_id",
    "p9_places": _P9P + "SELECT doc_id, item_id, words, place FROM best WHERE n = 1",
    "p9_kept": f"SELECT source, count(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_P9})) GROUP BY source",
    "p4_found": _P4,
    "p7_found": _P7,
    "p9_found": _P9,
    "p5_found": _P5 % ("query_id, chunk_id", 5),
    "p5_order": _P5 % ("query_id, chunk_id, place, x AS vector_support, y AS fts_support, z AS graph_support", 10),
}
