"""Queries of vector and text search, fusion, reranking and context."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import vectors as V
from sedimark.operators import graph, query, search
from sedimark.sources.tables import table
from sedimark.storage_paths import shared_dir, written

ANY, ALL, COMMON = "warehouse pallet tribunal", "court hearing", "the of report"


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").alias("file_id"))


def _vector(spark: SparkSession, folder: str, vec_id: int) -> list[float]:
    return [float(x) for x in _vectors(spark, folder).where(F.col("vec_id") == vec_id).first().embedding]


def vec_topk(spark, folder):
    found = search.vector_search(_vectors(spark, folder), _vector(spark, folder, 0), 10, key="vec_id")
    return found.select("vec_id", F.round("vector_score", 6).alias("score"))


def vec_filtered(spark, folder):
    label = _vectors(spark, folder).where(F.col("vec_id") == 1).first().file_id
    found = search.vector_search(_vectors(spark, folder), _vector(spark, folder, 0), 5, search.SearchFilter(file_id=label), key="vec_id")
    return found.select("vec_id", F.round("vector_score", 6).alias("score"))


def vec_batch(spark, folder):
    """The ten best of every vector whose id is divisible by 20."""
    asked = _vectors(spark, folder).where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return search.batch_vector_search(_vectors(spark, folder), asked, 10, key="vec_id").select("query_id", "vec_id", "rank", F.round("vector_score", 6).alias("score"))


def vec_unit(spark, folder):
    u = V.unit(F.col("embedding"))
    return _vectors(spark, folder).select("vec_id", F.round(V.norm(u), 6).alias("norm"), F.round(F.get(u, F.lit(0)), 6).alias("first"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


_INDEXES: dict[tuple, search.TextIndex] = {}


def _index(spark: SparkSession, folder: str, name: str, rows: Callable[[], DataFrame], key: str, content: str) -> search.TextIndex:
    """The index of a table's texts, written once a session."""
    known = spark.sparkContext.applicationId, folder, name
    if known not in _INDEXES:
        _INDEXES[known] = search.TextIndex.build(rows(), f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}", key, content)
    return _INDEXES[known]


def _document_index(spark: SparkSession, folder: str) -> search.TextIndex:
    return _index(spark, folder, "documents", lambda: _texts(spark, folder), "doc_id", "text")


def fts_all(spark, folder):
    return _document_index(spark, folder).search(ALL, 20).select("doc_id", F.round("fts_score", 6).alias("score"))


def fts_any(spark, folder):
    return _document_index(spark, folder).search(ANY, 20, any_term=True).select("doc_id", F.round("fts_score", 6).alias("score"))


def fts_unindexed(spark, folder):
    """The same on the texts themselves, of the documents of one source only."""
    some = table(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("block_type"))
    first = some.agg(F.min("block_type")).first()[0]
    return search.fts_search(some, COMMON, 20, search.SearchFilter(block_type=first), key="doc_id", content="text", any_term=True).select("doc_id", F.round("fts_score", 6).alias("score"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's latest row."""
    return graph.latest(table(spark, folder, "chunks"), "chunk_id")


def _hybrid(spark: SparkSession, folder: str) -> tuple:
    c = _chunks(spark, folder).select("chunk_id", "file_id", "heading", "block_type", "content", "embedding", "created_at", "model", "dimension")
    ok = c.where((F.col("model") == "tide-embed-l") & (F.size("embedding") == F.col("dimension")) & ~F.exists("embedding", lambda x: F.isnan(x)))
    v = ok.where(F.col("content").isNotNull()).orderBy(~F.col("content").contains("tribunal"), "chunk_id").first()
    return ok, v


def _usable(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    """The chunks of one model with sound vectors, and the vector that is asked for, both written once a session."""
    known = spark.sparkContext.applicationId, folder
    if known not in _ASKED:
        ok, v = _hybrid(spark, folder)
        _ASKED[known] = written(ok, "usable"), [float(x) for x in v.embedding] if v else [1.0]
    return _ASKED[known]


_ASKED: dict[tuple, tuple] = {}


def _found(spark: SparkSession, folder: str, where: search.SearchFilter | None) -> DataFrame:
    ok, v = _usable(spark, folder)
    index = _index(spark, folder, "chunks", lambda: ok, "chunk_id", "content")
    found = search.hybrid_search(ok, "tribunal court", v, 10, where, any_term=True, index=index)
    return found.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("score", "vector_score", "fts_score")])


def hybrid(spark, folder):
    return _found(spark, folder, None)


def hybrid_filtered(spark, folder):
    """The same among the chunks of one type, with a heading that begins with a letter, of a span of time."""
    return _found(spark, folder, _where(spark, folder))


def _where(spark: SparkSession, folder: str) -> search.SearchFilter:
    """A filter on every field but the file: the greatest type, the greatest heading's first letter, all times but the first and the last."""
    ok, _ = _usable(spark, folder)
    r = ok.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.max("block_type").alias("t")).first()
    h = ok.where(F.col("block_type") == r.t).agg(F.max(F.substring("heading", 1, 1))).first()[0]
    return search.SearchFilter(heading_prefix=h or "", block_type=r.t, created_after=r.a, created_before=r.b)


def vec_all_filters(spark, folder):
    """The best chunks under conditions on type, heading and time."""
    ok, v = _usable(spark, folder)
    return search.vector_search(ok, v, 10, _where(spark, folder)).select("chunk_id", F.round("vector_score", 6).alias("score"))


class _Asked:
    """An embedder that knows one vector."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def __call__(self, text: str) -> list[float]:
        return self.vector


def _engine(spark: SparkSession, folder: str) -> query.QueryEngine:
    ok, v = _usable(spark, folder)
    return query.QueryEngine(ok, _Asked(v), graph.latest(table(spark, folder, "graph_nodes"), "id"), graph.latest(table(spark, folder, "graph_edges"), "edge_id"), index=_index(spark, folder, "chunks", lambda: ok, "chunk_id", "content"))


def query_vector(spark, folder):
    """The engine's answer to a short question, twice, the second time from its cache."""
    e, q = _engine(spark, folder), query.Query("court", top_k=10)
    first, again = e.results(q), e.results(q)
    return first.select("chunk_id", "heading", F.round("score", 6).alias("score")).withColumn("hits", F.lit(e.cache.hits)).unionByName(again.select("chunk_id", "heading", F.round("score", 6).alias("score")).withColumn("hits", F.lit(0)))


def query_hybrid(spark, folder):
    """The engine's answer to a longer question, as a stream of rows without diversity."""
    q = query.Query("tribunal court", mode="Hybrid", top_k=10, diversify=False, any_term=True)
    rows = [(r.chunk_id, round(r.score, 6)) for r in _engine(spark, folder).stream(q)]
    return spark.createDataFrame(rows, "chunk_id string, score double")


def query_plans(spark, folder):
    """The steps that the engine plans for every question."""
    asked = [(r.item_id, i, s.name, s.detail) for r in table(spark, folder, "eval_items").select("item_id", "question").collect() for i, s in enumerate(query.build_plan(query.Query(r.question or "")))]
    return spark.createDataFrame(asked, "item_id long, step int, name string, detail string")


def rrf_by_query(spark, folder):
    r = search.fuse_rrf_by(table(spark, folder, "ranked_chunks"), "query_id", "chunk_id", ["vector_score", "fts_score"], 10)
    return r.select("query_id", "chunk_id", "place", F.round("score", 6).alias("score"))


def first_scores(spark, folder):
    r = table(spark, folder, "ranked_chunks").select("query_id", "chunk_id", "vector_score", "fts_score", "graph_score").distinct()
    return search.first_score(r).select("query_id", "chunk_id", F.round(F.col("score").cast("double"), 4).alias("score"))


def rerank(spark, folder):
    """The first ten of every query by fusion, with repeated headings and files set back."""
    top = search.fuse_rrf_by(table(spark, folder, "ranked_chunks"), "query_id", "chunk_id", ["vector_score", "fts_score"], 10)
    names = table(spark, folder, "ranked_chunks").groupBy("query_id", "chunk_id").agg(F.max("heading").alias("heading"), F.max("file_id").alias("file_id"))
    met = top.join(names, ["query_id", "chunk_id"])
    done = query.rerank_by_file(query.rerank_by_heading(met, ("query_id",)), ("query_id",))
    return done.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def context_windows(spark, folder):
    """Windows around the best candidate of every query."""
    best = search.fuse_rrf_by(table(spark, folder, "ranked_chunks"), "query_id", "chunk_id", ["vector_score", "fts_score"], 1).select("chunk_id")
    c = _chunks(spark, folder).select("chunk_id", "file_id", "heading", "content")
    return query.context_windows(c, best, 4).select("anchor_id", "chunk_id", "distance", "tokens")


def query_modes(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", query.mode_column(F.col("question")).alias("mode"))


QUERIES = {f.__name__: f for f in (fts_unindexed, hybrid_filtered, vec_all_filters, query_vector, query_hybrid, query_plans, vec_topk, vec_filtered, vec_batch, vec_unit, fts_all, fts_any, hybrid, rrf_by_query, first_scores, rerank, context_windows, query_modes)}

_COS = "list_cosine_similarity(%s::DOUBLE[], %s::DOUBLE[])"


def _bm25(table: str, key: str, text: str, terms: list[str], any_term: bool, k: int) -> str:
    f = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    idf = ", ".join(f"ln(1 + (count(*) - count(*) FILTER (f{i} > 0) + 0.5) / (count(*) FILTER (f{i} > 0) + 0.5)) AS w{i}" for i in range(len(terms)))
    score = " + ".join(f"w{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    met = (" OR " if any_term else " AND ").join(f"f{i} > 0" for i in range(len(terms)))
    return f"""SELECT {key}, {score} AS s FROM (SELECT {key}, len(t) AS n, {f} FROM (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {table})) c,
  (SELECT avg(n) AS mean, {idf} FROM (SELECT len(t) AS n, {f} FROM (SELECT regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {table}))) g
  WHERE {met} ORDER BY s DESC, {key} LIMIT {k}"""


_RRF = """
WITH c AS (SELECT query_id, chunk_id, max(CASE WHEN NOT isnan(vector_score) THEN vector_score END)::DOUBLE AS v, max(CASE WHEN NOT isnan(fts_score) THEN fts_score END)::DOUBLE AS f FROM ranked_chunks WHERE chunk_id IS NOT NULL GROUP BY ALL),
r AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST, chunk_id) END), 0) + coalesce(1.0 / (60 + CASE WHEN f IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST, chunk_id) END), 0) AS s FROM c),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS place FROM r)
"""
_LATEST = "latest AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id, created_at DESC NULLS LAST)"
_OK = f"""{_LATEST}, ok AS (SELECT * FROM latest WHERE model = 'tide-embed-l' AND len(embedding) = dimension AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))),
q AS (SELECT embedding FROM ok WHERE content IS NOT NULL ORDER BY NOT contains(content, 'tribunal'), chunk_id LIMIT 1)"""
_FITS = "starts_with(heading, (SELECT max(left(heading, 1)) FROM ok WHERE block_type = (SELECT max(block_type) FROM ok))) AND block_type = (SELECT max(block_type) FROM ok) AND created_at > (SELECT min(created_at) FROM ok) AND created_at < (SELECT max(created_at) FROM ok)"
_HYBRID = f"""
WITH {_OK},
v AS (SELECT chunk_id, s, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM (SELECT chunk_id, {_COS % ('embedding', '(SELECT embedding FROM q)')} AS s FROM ok WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0)) AND %s ORDER BY s DESC, chunk_id LIMIT 10)),
f AS (SELECT chunk_id, s, row_number() OVER (ORDER BY s DESC, chunk_id) AS r FROM (SELECT b.* FROM ({_bm25('ok', 'chunk_id', 'content', ['tribunal', 'court'], True, 1_000_000_000)}) b JOIN ok USING (chunk_id) WHERE %s ORDER BY s DESC, chunk_id LIMIT 10))
SELECT chunk_id, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + f.r), 0), 6) AS score, round(v.s, 6) AS vector_score, round(f.s, 6) AS fts_score
FROM v FULL JOIN f USING (chunk_id) ORDER BY coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + f.r), 0) DESC, chunk_id LIMIT 10"""
ORACLE = {
    "vec_topk": f"SELECT vec_id, round({_COS % ('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings ORDER BY {_COS % ('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} DESC, vec_id LIMIT 10",
    "vec_filtered": f"SELECT vec_id, round({_COS % ('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 1) ORDER BY score DESC, vec_id LIMIT 5",
    "vec_batch": f"SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS % ('e.embedding', 'q.embedding')} DESC, e.vec_id)::INT AS rank, round({_COS % ('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10",
    "vec_unit": "SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings",
    "fts_all": f"SELECT doc_id, round(s, 6) AS score FROM ({_bm25('documents', 'doc_id', 'text', ALL.split(), False, 20)})",
    "fts_any": f"SELECT doc_id, round(s, 6) AS score FROM ({_bm25('documents', 'doc_id', 'text', ANY.split(), True, 20)})",
    "fts_unindexed": f"WITH one AS (SELECT * FROM documents WHERE source = (SELECT min(source) FROM documents)) SELECT doc_id, round(s, 6) AS score FROM ({_bm25('one', 'doc_id', 'text', COMMON.split(), True, 20)})",
    "hybrid": _HYBRID % ("true", "true"),
    "hybrid_filtered": _HYBRID % (_FITS, _FITS),
    "vec_all_filters": f"WITH {_OK} SELECT chunk_id, round(s, 6) AS score FROM (SELECT chunk_id, {_COS % ('embedding', '(SELECT embedding FROM q)')} AS s FROM ok WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0)) AND {_FITS} ORDER BY s DESC, chunk_id LIMIT 10)",
    "query_vector": f"""WITH {_OK}, v AS (SELECT chunk_id, file_id, heading, {_COS % ('embedding', '(SELECT embedding FROM q)')} AS s FROM ok WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0)) ORDER BY s DESC, chunk_id LIMIT 10)
SELECT chunk_id, heading, score, hits FROM (SELECT chunk_id, heading, round(s / (1 + 0.15 * (count(*) OVER (PARTITION BY heading) - 1)) / (1 + 0.1 * (count(*) OVER (PARTITION BY file_id) - 1)), 6) AS score FROM v), (VALUES (0), (1)) h(hits)""",
    "query_hybrid": f"SELECT chunk_id, score FROM ({_HYBRID % ('true', 'true')})",
    "query_plans": """WITH m AS (SELECT item_id, CASE WHEN n = 0 THEN 'Hybrid' WHEN contains(q, 'related to') OR contains(q, 'connected to') OR contains(q, 'reference') OR contains(q, 'associated with') THEN 'Expand' WHEN n < 3 THEN 'Vector' ELSE 'Hybrid' END AS mode FROM (SELECT item_id, lower(coalesce(question, '')) AS q, len(list_filter(regexp_split_to_array(coalesce(question, ''), '\\s+'), lambda x: x <> '')) AS n FROM eval_items)),
s AS (SELECT item_id, [{'n': 'vector', 'd': 'top 10'}] || CASE WHEN mode <> 'Vector' THEN [{'n': 'fts', 'd': 'top 10'}, {'n': 'fuse', 'd': 'k=60'}] ELSE [] END || CASE WHEN mode = 'Expand' THEN [{'n': 'expand', 'd': 'depth 0'}] ELSE [] END || [{'n': 'rerank', 'd': 'heading'}, {'n': 'rerank', 'd': 'file'}] AS steps FROM m)
SELECT item_id, unnest(range(len(steps)))::INT AS step, unnest(steps).n AS name, unnest(steps).d AS detail FROM s""",
    "rrf_by_query": _RRF + "SELECT query_id, chunk_id, place::INT AS place, round(s, 6) AS score FROM top WHERE place <= 10",
    "first_scores": "SELECT DISTINCT query_id, chunk_id, round(s::DOUBLE, 4) AS score FROM (SELECT query_id, chunk_id, coalesce(vector_score, fts_score, graph_score, 0) AS s, vector_score, fts_score, graph_score FROM ranked_chunks)",
    "rerank": _RRF + """, n AS (SELECT query_id, chunk_id, max(heading) AS heading, max(file_id) AS file_id FROM ranked_chunks GROUP BY ALL), m AS (SELECT * FROM top JOIN n USING (query_id, chunk_id) WHERE place <= 10)
SELECT query_id, chunk_id, round(s / (1 + 0.15 * (count(*) OVER (PARTITION BY query_id, heading) - 1)) / (1 + 0.1 * (count(*) OVER (PARTITION BY query_id, file_id) - 1)), 6) AS score FROM m""",
    "context_windows": _RRF + f""", {_LATEST}, n AS (SELECT chunk_id, file_id, heading, content, row_number() OVER (PARTITION BY file_id, heading ORDER BY chunk_id) AS r FROM latest)
SELECT a.chunk_id AS anchor_id, n.chunk_id, (n.r - a.r)::INT AS distance, strlen(coalesce(n.content, '')) // 4 AS tokens
FROM n a JOIN n ON a.file_id IS NOT DISTINCT FROM n.file_id AND a.heading IS NOT DISTINCT FROM n.heading AND abs(n.r - a.r) <= 2 WHERE a.chunk_id IN (SELECT chunk_id FROM top WHERE place = 1)""",
    "query_modes": "SELECT item_id, CASE WHEN n = 0 THEN 'Hybrid' WHEN contains(q, 'related to') OR contains(q, 'connected to') OR contains(q, 'reference') OR contains(q, 'associated with') THEN 'Expand' WHEN n < 3 THEN 'Vector' ELSE 'Hybrid' END AS mode FROM (SELECT item_id, lower(question) AS q, len(list_filter(regexp_split_to_array(coalesce(question, ''), '\\s+'), lambda x: x <> '')) AS n FROM eval_items)",
}
