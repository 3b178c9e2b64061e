"""The library in one place: documents, directories, an index and its queries."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sedimark.config import Config
from sedimark.errors import InvalidQuery
from sedimark.operators import embedding, graph, indexing, query, search
from sedimark.operators.caching import CacheManager
from sedimark.operators.store import Store
from sedimark.session import ship
from sedimark.sources import formats, scan
from sedimark.sources.documents import Document
from sedimark.storage_paths import filesystem, written
from sedimark.streaming import watch


def open_doc(path: str) -> Document:
    return Document(path)


def grep_docs(spark: SparkSession, root: str, text: str) -> DataFrame:
    """(path, matches): files of a directory with matching lines, paragraphs, slides, cells or pages; broken files are skipped."""
    if not text:
        raise InvalidQuery("empty query")
    ship(spark)
    files = spark.createDataFrame([(p, os.path.splitext(p)[1][1:].lower()) for p in scan.readable_files(root)], "file_id string, extension string")

    def load(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                try:
                    with open(b.column(0)[i].as_py(), "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([data], pa.binary())], names=["file_id", "extension", "content"])

    n = max(1, min(files.count(), spark.sparkContext.defaultParallelism * 4))
    parsed = formats.parse_files(files.repartition(n).mapInArrow(load, "file_id string, extension string, content binary"))
    e = parsed.select("file_id", "extension", F.inline("elements"))
    unit = F.when(F.col("extension").isin("html", "htm", "docx"), "paragraph").when(F.col("extension") == "pdf", "page").when(F.col("extension") == "pptx", "slide").when(F.col("extension") == "xlsx", "sheet").otherwise("line")
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    cells = F.size(F.filter(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), has))
    hits = F.when(F.col("kind") == "sheet", cells).when(has(F.col("text")) | ((F.col("kind") == "slide") & has(F.col("label"))), 1).otherwise(0)
    return e.where(F.col("kind") == unit).groupBy(F.col("file_id").alias("path")).agg(F.sum(hits).alias("matches")).where(F.col("matches") > 0)


def watch_directory(spark: SparkSession, root: str, once: bool = False, seconds: float = 1.0, before: DataFrame | None = None) -> Iterator[dict]:
    """Events of a directory, Created, Modified, Deleted or Renamed, from one scan to the next; what is there at first is Created. With ``once`` it ends after the first scan. It doesn't index."""
    ship(spark)
    seen = before if before is not None else spark.createDataFrame([], scan.FILES)
    while True:
        now = written(scan.scan(spark, root), "watched")
        for r in scan.changes(seen.select("path", "hash"), now.select("path", "hash")).orderBy("path").toLocalIterator():
            yield r.asDict()
        if once:
            return
        seen = now
        time.sleep(seconds)


class Index:
    """A store, an embedder and what they answer."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = Config(), embedder: embedding.Embedder | None = None):
        ship(spark)
        self.spark, self.config = spark, config
        self.store = Store(spark, folder if "://" in folder else "file://" + os.path.abspath(folder), config.storage.read_only)
        c = config.embedding
        self.embedder = embedder or embedding.create_embedder(c.provider, c.model, c.url, None, c.dimension)
        self.caches = CacheManager()

    def add(self, root: str, mode: str = "Incremental", progress: Callable[[str, int], None] = lambda *_: None) -> indexing.IndexReport:
        report = indexing.index(self.store, root, self.embedder, indexing.IndexConfig(mode, batch=self.config.embedding.batch), progress)
        self.caches.invalidate()
        return report

    def watch(self, root: str, checkpoint: str, once: bool = False, done: Callable[[indexing.IndexReport], None] = lambda r: None):
        """A stream that indexes new files; its ``stop()`` ends the watch."""

        def after(report: indexing.IndexReport) -> None:
            self.caches.invalidate()
            done(report)

        return watch.index_changes(self.store, root, self.embedder, checkpoint, done=after, once=once)

    def _chunks(self) -> DataFrame:
        return self.store.chunks.read().where(F.col("embedding").isNotNull())

    def text_index(self) -> search.TextIndex:
        """The index of the chunks' texts in the store's version, written when it is first asked for."""
        folder = f"{self.store.folder}/terms-{self.store.versions.current()}"
        fs, done = filesystem(self.spark, f"{folder}/lengths/_SUCCESS")
        if not fs.exists(done):
            fs.delete(filesystem(self.spark, folder)[1], True)  # of a run that died
            return search.TextIndex.build(self._chunks(), folder)
        return search.TextIndex.open(self.spark, folder)

    def engine(self) -> query.QueryEngine:
        return query.QueryEngine(self._chunks(), self.embedder, self.store.nodes.read(), self.store.edges.read(), self.caches.queries, self.text_index())

    def query(self, text: str, **options) -> DataFrame:
        """``options`` are those of ``query.Query``."""
        return self.engine().results(query.Query(text, **{"top_k": self.config.query.top_k, "mode": self.config.query.mode, **options}))

    def stream(self, text: str, **options) -> Iterator[Row]:
        return self.query(text, **options).toLocalIterator()

    def vector_search(self, text: str, k: int = 10, where: search.SearchFilter | None = None, hybrid: bool = False, expand: int = 0) -> DataFrame:
        """The best chunks by vector, or with ``hybrid`` by vector and text, and with ``expand`` those that they reach in so many steps; all of them meet the filter."""
        chunks, vector = self._chunks(), self.embedder.embed_batch([text])[0]
        if hybrid:
            found = search.hybrid_search(chunks, text, vector, k, where, any_term=True, index=self.text_index())
        else:
            found = search.vector_search(chunks, vector, k, where).select("chunk_id", F.col("vector_score").alias("score"), "vector_score")
        if expand:
            found = graph.expand_results(found, self.store.nodes.read(), self.store.edges.read(), expand)
        rows = (where.apply(chunks) if where else chunks).drop("embedding")
        return rows.join(found, "chunk_id").orderBy(F.desc("score"), "chunk_id")

    def vector_searches(self, texts: list[str], k: int = 10) -> DataFrame:
        """Many queries in one pass over the vectors."""
        chunks = self.store.chunks.read().where(F.col("embedding").isNotNull())
        return search.batch_vector_search(chunks, dict(zip(texts, self.embedder.embed_batch(texts))), k)

    def expand(self, node: str, depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        return graph.expand(node, self.store.nodes.read(), self.store.edges.read(), depth, direction)

    def path(self, start: str, goal: str, direction: str = "both") -> list[str] | None:
        return graph.find_path(start, goal, self.store.nodes.read(), self.store.edges.read(), direction=direction)

    def graph_info(self, file_id: str) -> dict:
        nodes, edges = graph.file_graph(self.store.nodes.read(), self.store.edges.read(), file_id)
        return {"nodes": nodes.count(), "edges": edges.count(), "types": {r.node_type: r["count"] for r in nodes.groupBy("node_type").count().collect()}}

    def stats(self) -> dict:
        types = {r.node_type: r.n for r in graph.type_counts(self.store.nodes.read()).collect()}
        return {**self.store.counts(), "types": types, **self.caches.stats()}

    def status(self) -> dict:
        probe = self.embedder.embed_batch(["probe"])[0]
        n = self.store.chunks.read().where(F.col("embedding").isNotNull()).count()
        return {"vectors": n, "model": self.embedder.model, "dimension": len(probe)}
