"""The query engine: choice of mode, plans, diversity, context windows, request cache."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from time import monotonic

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimark.errors import InvalidQuery
from sedimark.functions import text as T
from sedimark.operators import graph, search
from sedimark.operators.search import SearchFilter
from sedimark.storage_paths import written

# Phrases that ask for related records.
RELATED = ["related to", "connected to", "reference", "associated with"]
MODES = ("Auto", "Vector", "Hybrid", "Expand")
#: Rows of a result that the cache keeps.
KEPT = 1000


def select_mode(text: str, depth: int = 0) -> str:
    t = text.lower()
    if depth > 0:
        return "Expand"
    if not t.strip():
        return "Hybrid"
    if any(p in t for p in RELATED):
        return "Expand"
    return "Vector" if len(t.split()) < 3 else "Hybrid"


def mode_column(text: Column, depth: Column | int = 0) -> Column:
    """The same for a column of queries."""
    t = F.lower(text)
    related = F.lit(False)
    for p in RELATED:
        related = related | t.contains(p)
    d = F.lit(depth) if isinstance(depth, int) else depth
    n = F.size(T.words(t))
    return F.when(d > 0, "Expand").when(n == 0, "Hybrid").when(related, "Expand").when(n < 3, "Vector").otherwise("Hybrid")


@dataclass(frozen=True)
class Query:
    text: str
    mode: str = "Auto"
    top_k: int = 10
    depth: int = 0
    where: SearchFilter | None = None
    context: bool = False
    context_chunks: int = 3
    diversify: bool = True
    any_term: bool = False


def penalise(df: DataFrame, column: str, weight: float, within: tuple[str, ...] = ()) -> DataFrame:
    """Scores divided by 1 + weight for each further row of the result with the same value; null is a value. ``within`` names several results in one table."""
    n = F.count("*").over(W.partitionBy(*within, column))
    return df.withColumn("score", F.col("score") / (1 + weight * (n - 1)))


def rerank_by_heading(df: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    return penalise(df, "heading", 0.15, within)


def rerank_by_file(df: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    return penalise(df, "file_id", 0.1, within)


def context_windows(chunks: DataFrame, anchors: DataFrame, n: int = 3, key: str = "chunk_id") -> DataFrame:
    """(anchor_id, key, content, heading, distance, tokens): the chunks around each anchor.

    Neighbours are of the same file and heading (null matches null), in the order of keys, up to half
    of ``n`` (1 to 10) on each side. Positions are numbered only among chunks that share file and
    heading with an anchor; an anchor that isn't among ``chunks`` has no row. Chunks are sorted by
    ranges of (file, heading, key), so one file and heading may lie in any number of tasks, and
    neighbours are found by their numbers in the whole order.
    """
    half = max(1, min(n, 10)) // 2
    same = anchors.select(key).distinct()
    groups = chunks.join(same, key, "left_semi").select(F.col("file_id").alias("_f"), F.col("heading").alias("_h")).distinct()
    own = chunks.join(groups, F.col("file_id").eqNullSafe(F.col("_f")) & F.col("heading").eqNullSafe(F.col("_h")), "left_semi").select(key, "file_id", "heading", "content")
    order = ["file_id", "heading", key]
    # the number within the task and the task's own
    placed = written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # one row a task
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return placed.select(F.col(key).alias("anchor_id"), key, "content", "heading", F.lit(0).alias("distance"), T.byte_tokens(F.col("content")).alias("tokens"))
    start = F.create_map(*[x for p, s in starts.items() for x in (F.lit(p).cast("long"), F.lit(s).cast("long"))])
    rows = placed.withColumn("_pos", start[part] + within)
    mine = rows.join(same, key, "left_semi").select(F.col(key).alias("anchor_id"), F.col("file_id").alias("_f"), F.col("heading").alias("_h"), "_pos")
    near = mine.select("anchor_id", "_f", "_h", "_pos", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("distance")).withColumn("_pos", F.col("_pos") + F.col("distance"))
    met = near.join(rows, "_pos").where(F.col("file_id").eqNullSafe(F.col("_f")) & F.col("heading").eqNullSafe(F.col("_h")))
    return met.select("anchor_id", key, "content", "heading", "distance", T.byte_tokens(F.col("content")).alias("tokens"))


@dataclass(frozen=True)
class Step:
    name: str
    detail: str = ""


def build_plan(q: Query) -> list[Step]:
    """The steps of a query, in order."""
    mode = select_mode(q.text, q.depth) if q.mode == "Auto" else q.mode
    steps = [Step("vector", f"top {q.top_k}")]
    if mode in ("Hybrid", "Expand"):
        steps += [Step("fts", f"top {q.top_k}"), Step("fuse", f"k={search.RRF_K:g}")]
    if mode == "Expand":
        steps.append(Step("expand", f"depth {q.depth}"))
    if q.diversify:
        steps += [Step("rerank", "heading"), Step("rerank", "file")]
    return steps


class QueryCache:
    """The last results by whole request, for a time."""

    def __init__(self, size: int = 100, seconds: float = 60.0):
        self.size, self.seconds = size, seconds
        self.held: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def get(self, request):
        found = self.held.get(request)
        if found is None or monotonic() - found[0] > self.seconds:
            self.held.pop(request, None)
            self.misses += 1
            return None
        self.held.move_to_end(request)
        self.hits += 1
        return found[1]

    def put(self, request, value) -> None:
        if self.size <= 0:
            return
        self.held[request] = (monotonic(), value)
        self.held.move_to_end(request)
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def invalidate(self) -> None:
        self.held.clear()


class QueryEngine:
    """Queries over ``chunks`` (with embeddings) and, for expansion, the graph's nodes and edges."""

    def __init__(self, chunks: DataFrame, embed, nodes: DataFrame | None = None, edges: DataFrame | None = None, cache: QueryCache | None = None, index: search.TextIndex | None = None):
        self.chunks, self.embed, self.nodes, self.edges, self.index = chunks, embed, nodes, edges, index
        self.cache = cache or QueryCache()
        self._vectors: dict[str, Sequence[float]] = {}

    def vector_of(self, text: str) -> Sequence[float]:
        if text not in self._vectors:
            self._vectors[text] = self.embed(text)
        return self._vectors[text]

    def results(self, q: Query) -> DataFrame:
        """(chunk_id, file_id, heading, content, block_type, score, ...), best first.

        The rows are kept for as long as the cache holds the request: the searches' at most 100 and those
        that expansion reaches, if they are no more than ``KEPT``; larger results are searched again.
        """
        if not q.text.strip():
            raise InvalidQuery("blank query")
        if q.mode not in MODES:
            raise InvalidQuery(f"no such mode: {q.mode}")
        q = replace(q, mode=select_mode(q.text, q.depth)) if q.mode == "Auto" else q
        if (held := self.cache.get(q)) is not None:
            return self.chunks.sparkSession.createDataFrame(*held)
        vector = self.vector_of(q.text)
        if q.mode == "Vector":
            found = search.vector_search(self.chunks, vector, q.top_k, q.where).select("chunk_id", F.col("vector_score").alias("score"), "vector_score", F.lit(None).cast("double").alias("fts_score"))
        else:
            found = search.hybrid_search(self.chunks, q.text, vector, q.top_k, q.where, any_term=q.any_term, index=self.index)
        if q.mode == "Expand" and q.depth > 0 and self.edges is not None and self.nodes is not None:
            found = graph.expand_results(found, self.nodes, self.edges, q.depth)
        # what expansion has reached must meet the filter, too
        rows = (q.where.apply(self.chunks) if q.where else self.chunks).select("chunk_id", "file_id", "heading", "content", "block_type")
        full = rows.join(found, "chunk_id")
        if q.diversify:
            full = rerank_by_file(rerank_by_heading(full))
        full = full.orderBy(F.desc("score"), F.asc("chunk_id"))
        first = full.limit(KEPT + 1).collect()
        if len(first) > KEPT:
            return full
        self.cache.put(q, (first, full.schema))
        return full.sparkSession.createDataFrame(first, full.schema)

    def stream(self, q: Query) -> Iterator[Row]:
        return self.results(q).toLocalIterator()

    def windows(self, q: Query) -> DataFrame:
        return context_windows(self.chunks, self.results(q).select("chunk_id"), q.context_chunks)


def preview(rows: list[Row], width: int = 120) -> str:
    """Results as lines of text."""
    out = []
    for i, r in enumerate(rows, 1):
        body = " ".join((r["content"] or "").split())
        out.append(f"{i}. [{r['score']:.4f}] {r['chunk_id']} {r['heading'] or ''}\n   {body[:width]}{'...' if len(body) > width else ''}")
    return "\n".join(out)
