"""Vector search, full-text search, filters and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimark.errors import DimensionMismatch, InvalidQuery
from sedimark.functions import text as T
from sedimark.functions import vectors as V
from sedimark.storage_paths import written

MOST = 100
K1, B = 1.2, 0.75
RRF_K = 60.0


def clamp(k: int) -> int:
    """Between 1 and 100; fewer than one result can't be asked for."""
    if k < 1:
        raise InvalidQuery("top_k must be at least 1")
    return min(k, MOST)


@dataclass(frozen=True)
class SearchFilter:
    """Conditions that must all hold; times are exclusive."""

    file_id: object = None
    heading_prefix: str | None = None
    block_type: str | None = None
    created_after: datetime | int | None = None
    created_before: datetime | int | None = None

    def condition(self) -> Column | None:
        ms = lambda t: int(t.timestamp() * 1000) if isinstance(t, datetime) else t
        found = [
            F.col("file_id") == self.file_id if self.file_id is not None else None,
            F.col("heading").startswith(self.heading_prefix) if self.heading_prefix is not None else None,
            F.col("block_type") == self.block_type if self.block_type is not None else None,
            F.col("created_at") > ms(self.created_after) if self.created_after is not None else None,
            F.col("created_at") < ms(self.created_before) if self.created_before is not None else None,
        ]
        found = [c for c in found if c is not None]
        return reduce(lambda a, b: a & b, found) if found else None

    def apply(self, df: DataFrame) -> DataFrame:
        c = self.condition()
        return df if c is None else df.where(c)


def vector_search(chunks: DataFrame, query: Sequence[float], k: int = 10, where: SearchFilter | None = None, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``chunks`` without the vector, with ``vector_score``: the ``k`` rows with the highest cosine, ties by key.

    The query is a literal, so there is no join; each task keeps its own ``k`` rows.
    """
    if not len(query):
        raise DimensionMismatch("empty query vector")
    rows = (where.apply(chunks) if where else chunks).withColumn("vector_score", V.cosine(F.col(vector), V.literal(query)))
    return rows.where(F.col("vector_score").isNotNull()).drop(vector).orderBy(F.desc("vector_score"), F.asc(key)).limit(clamp(k))


#: Queries that meet all rows in one pass.
QUERY_BLOCK = 4096


def batch_vector_search(chunks: DataFrame, queries: dict | DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_id, key, vector_score, rank): the ``k`` best rows of each query, ties by key.

    ``queries`` is a short dict of vectors, or a table (query_key, vector) of any size, of which the
    driver holds one block at a time; each block meets all rows in a pass of its own, whose result is
    written. Each task sends on only its own ``k`` rows a query. Null vectors, and those of another
    length, are not among the queries of a block.
    """
    k, spark = clamp(k), chunks.sparkSession
    kind = dict(chunks.dtypes)[key]
    rows = chunks.select(key, F.col(vector).cast("array<float>"))
    if isinstance(queries, dict):
        found = _pass(rows, list(queries), [list(v) for v in queries.values()], k, kind) if queries else None
        names = {i: n for i, n in enumerate(queries)}
        if found is None:
            return spark.createDataFrame([], f"query_id string, {key} {kind}, vector_score double, rank int")
        ids = F.create_map(*[x for i, n in names.items() for x in (F.lit(i).cast("long"), F.lit(n))])
        return _ranked(found, k).select(ids[F.col("q")].alias("query_id"), F.col("key").alias(key), "vector_score", "rank")
    asked = queries.select(F.col(query_key).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.size("v") > 0)
    id_kind, every, block = dict(asked.dtypes)["id"], None, []

    def passed(block: list) -> DataFrame:
        out = None
        for size in {len(v) for _, v in block}:  # vectors of one length at a time
            own = [(n, v) for n, v in block if len(v) == size]
            names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(own)], f"q long, id {id_kind}")
            part = written(_ranked(_pass(rows, [n for n, _ in own], [v for _, v in own], k, kind), k), "best").join(F.broadcast(names), "q")
            out = part if out is None else out.unionByName(part)
        return out

    for r in asked.toLocalIterator():
        block.append((r.id, list(r.v)))
        if len(block) == QUERY_BLOCK:
            part, block = passed(block), []
            every = part if every is None else every.unionByName(part)
    if block:
        part = passed(block)
        every = part if every is None else every.unionByName(part)
    if every is None:
        return spark.createDataFrame([], f"query_id {id_kind}, {key} {kind}, vector_score double, rank int")
    return every.select(F.col("id").alias("query_id"), F.col("key").alias(key), "vector_score", "rank")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("vector_score"), F.asc("key")))).where(F.col("rank") <= k)


def _pass(rows: DataFrame, names: list, vectors: list, k: int, kind: str) -> DataFrame:
    """(q, key, vector_score): of each task's rows the ``k`` best of each query."""
    matrix = np.array(vectors, np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = rows.sparkSession.sparkContext.broadcast(matrix)

    def best(q: np.ndarray, keys: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (query, key, score) the first ``k`` of each query."""
        place = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
        order = np.lexsort((place, -score, q))
        q, keys, score = q[order], keys[order], score[order]
        start = np.searchsorted(q, q)
        kept = np.arange(len(q)) - start < k
        return q[kept], keys[kept], score[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        for b in batches:
            lists = b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            ok = np.flatnonzero(np.asarray(lists.is_valid()) & (lengths == m.shape[1]))
            if not len(ok):
                continue
            x = lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), -1)
            n = np.linalg.norm(x, axis=1)
            good = n > 0
            keys = np.array(b.column(0).take(pa.array(ok)).to_pylist(), dtype=object)[good]
            s = m @ (x[good] / n[good, None]).T
            if not s.shape[1]:
                continue
            least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            q, at = np.nonzero(s >= least[:, None])
            held = best(*(np.concatenate(z) for z in zip(held, (q, keys[at], s[q, at]))))
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1].tolist()), pa.array(held[2])], names=["q", "key", "vector_score"])

    return rows.mapInArrow(run, f"q long, key {kind}, vector_score double")


def fts_search(chunks: DataFrame, query: str, k: int = 10, where: SearchFilter | None = None, key: str = "chunk_id", content: str = "content", any_term: bool = False) -> DataFrame:
    """``chunks`` with ``fts_score``: the ``k`` best rows by BM25, ties by key; all terms are required unless ``any_term``.

    One pass for the number and mean length of rows and the terms' document frequencies, which is a
    single row, and one for the scores; no row is exploded and nothing but the best rows is shuffled.
    """
    wanted = list(dict.fromkeys(_query_terms(query)))
    if not wanted:
        raise InvalidQuery("no search terms")
    rows = where.apply(chunks) if where else chunks
    own = T.terms(F.col(content))
    counted = rows.withColumn("_t", own).withColumns({"_n": F.size("_t"), **{f"_f{i}": F.size(F.filter("_t", _is(w))) for i, w in enumerate(wanted)}}).drop("_t")
    stats = counted.agg(F.count("*").alias("n"), F.avg("_n").alias("mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(wanted))]).first()
    if not stats.n or not stats.mean:
        return rows.withColumn("fts_score", F.lit(0.0)).limit(0)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = float(np.log(1 + (stats.n - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
        f = F.col(f"_f{i}").cast("double")
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(stats.mean)))
    hits = [F.col(f"_f{i}") > 0 for i in range(len(wanted))]
    met = reduce(lambda a, b: a | b, hits) if any_term else reduce(lambda a, b: a & b, hits)
    return counted.where(met).withColumn("fts_score", score).drop("_n", *[f"_f{i}" for i in range(len(wanted))]).orderBy(F.desc("fts_score"), F.asc(key)).limit(clamp(k))


@dataclass(frozen=True)
class TextIndex:
    """A table of texts by term, for searches that read no text: (term, key, f, n) with how often a term is in a text of n terms, and the number and mean length of all texts.

    The table is sorted by term, so that files and row groups without a wanted term aren't read.
    """

    postings: DataFrame
    key: str
    texts: int
    mean: float

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str = "chunk_id", content: str = "content") -> TextIndex:
        """Writes the index of ``rows`` to a folder. Null and empty texts count as texts of no terms; of a key in several rows each counts."""
        own = rows.select(F.col(key).alias("key"), T.terms(F.col(content)).alias("t")).select("key", F.size("t").alias("n"), "t")
        each = own.select("key", "n", F.explode("t").alias("term")).groupBy("term", "key", "n").agg(F.count("*").cast("int").alias("f"))
        each.repartitionByRange(F.col("term")).sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{folder}/postings")
        own.agg(F.count("*").alias("texts"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean")).write.mode("errorifexists").parquet(f"{folder}/lengths")
        return cls.open(rows.sparkSession, folder, key)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, key: str = "chunk_id") -> TextIndex:
        r = spark.read.parquet(f"{folder}/lengths").first()
        return cls(spark.read.parquet(f"{folder}/postings"), key, r.texts, r.mean)

    def search(self, query: str, k: int = 10, any_term: bool = False, among: DataFrame | None = None) -> DataFrame:
        """(key, fts_score): the ``k`` best texts by BM25, ties by key; all terms are required unless ``any_term``. ``among`` has the keys that may come out."""
        wanted = list(dict.fromkeys(_query_terms(query)))
        if not wanted:
            raise InvalidQuery("no search terms")
        rows = self.postings.where(F.col("term").isin(wanted))
        found = {r[0]: r[1] for r in rows.groupBy("term").count().collect()}
        if not found or not any_term and len(found) < len(wanted):
            return rows.select(F.col("key").alias(self.key), F.lit(0.0).alias("fts_score")).limit(0)
        if among is not None:
            rows = rows.join(among.select(F.col(self.key).alias("key")).distinct(), "key", "left_semi")
        idf = F.create_map(*[x for w, d in found.items() for x in (F.lit(w), F.lit(float(np.log(1 + (self.texts - d + 0.5) / (d + 0.5)))))])
        f = F.col("f").cast("double")
        gain = idf[F.col("term")] * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(self.mean)))
        # added up in the order of the query's terms
        parts = [F.coalesce(F.max(F.when(F.col("term") == w, gain)), F.lit(0.0)) for w in wanted]
        scored = rows.groupBy("key", "n").agg(reduce(lambda a, b: a + b, parts).alias("fts_score"), F.count("*").alias("met"))
        kept = scored if any_term else scored.where(F.col("met") == len(wanted))
        return kept.select(F.col("key").alias(self.key), "fts_score").orderBy(F.desc("fts_score"), F.asc(self.key)).limit(clamp(k))


def _is(word: str):
    return lambda x: x == F.lit(word)


def _query_terms(query: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", query.lower())


def fuse_rrf(lists: dict[str, DataFrame], k: int = 10, rank_constant: float = RRF_K, key: str = "chunk_id") -> DataFrame:
    """(key, score, one column a list): reciprocal rank fusion of short ranked lists, each of (key, its score column), ties by key.

    A list is cut to at most 100 rows before it is ranked, so ranking in one task is bounded.
    """
    parts = None
    for name, df in lists.items():
        top = df.select(key, F.col(name).cast("double").alias("s")).orderBy(F.desc("s"), F.asc(key)).limit(MOST)
        rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("s"), F.asc(key)))
        part = top.select(key, (1.0 / (rank_constant + rank)).alias("gain"), *[(F.col("s") if n == name else F.lit(None).cast("double")).alias(n) for n in lists])
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy(key).agg(F.sum("gain").alias("score"), *[F.max(n).alias(n) for n in lists])
    return fused.orderBy(F.desc("score"), F.asc(key)).limit(clamp(k))


def fuse_rrf_by(rows: DataFrame, group: str, key: str, scores: list[str], k: int = 10, rank_constant: float = RRF_K) -> DataFrame:
    """(group, key, score, place): the fusion of several scores for every group at once; a null or NaN score gives nothing.

    Ranks need a group's rows in order, so groups are meant to be lists of candidates.
    """
    clean = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(*[F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(s) for s in scores])
    ranked = clean.withColumns({f"_r{i}": F.when(F.col(s).isNotNull(), F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last(s), F.asc(key)))) for i, s in enumerate(scores)})
    total = sum((F.coalesce(1.0 / (rank_constant + F.col(f"_r{i}")), F.lit(0.0)) for i in range(len(scores))), F.lit(0.0))
    placed = ranked.withColumn("score", total).withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), F.asc(key))))
    return placed.where(F.col("place") <= clamp(k)).select(group, key, "score", "place")


def hybrid_search(chunks: DataFrame, query: str, vector: Sequence[float], k: int = 10, where: SearchFilter | None = None, key: str = "chunk_id", content: str = "content", any_term: bool = False, index: TextIndex | None = None) -> DataFrame:
    """Both searches with the same filter, fused: (key, score, vector_score, fts_score). With an ``index`` of the texts these aren't read.

    Statistics of terms are those of all indexed texts, and without an index those of the texts that pass the filter.
    """
    by_vector = vector_search(chunks, vector, k, where, key).select(key, "vector_score")
    if index is not None:
        by_text = index.search(query, k, any_term, where.apply(chunks) if where else None)
    else:
        by_text = fts_search(chunks, query, k, where, key, content, any_term).select(key, "fts_score")
    return fuse_rrf({"vector_score": by_vector, "fts_score": by_text}, k, key=key)


def first_score(df: DataFrame) -> DataFrame:
    """``score``: the first score that is there, else 0."""
    return df.withColumn("score", F.coalesce(*[F.col(c) for c in ("vector_score", "fts_score", "graph_score") if c in df.columns], F.lit(0.0)))
