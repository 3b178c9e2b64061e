"""What is kept between calls: small results on the driver, vectors as a table, the graph's arcs in memory."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.graph import arcs
from sedimark.operators.query import QueryCache
from sedimark.operators.store import upserted


class LruCache:
    """The last ``size`` values that were used; a size of 0 keeps none."""

    def __init__(self, size: int):
        self.size = size
        self._held: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key, default=None):
        if key in self._held:
            self._held.move_to_end(key)
            self.hits += 1
            return self._held[key]
        self.misses += 1
        return default

    def put(self, key, value) -> None:
        if self.size < 1:
            return
        self._held[key] = value
        self._held.move_to_end(key)
        if len(self._held) > self.size:
            self._held.popitem(last=False)

    def remove(self, key) -> None:
        self._held.pop(key, None)

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


class EmbeddingCache:
    """Vectors by content hash and model, as a DataFrame that joins take; looking up many is one join."""

    SCHEMA = "content_hash string, model string, embedding array<float>"

    def __init__(self, table: DataFrame):
        self.table = table.select("content_hash", "model", "embedding")

    def get_batch(self, wanted: DataFrame, model: str) -> DataFrame:
        """(content_hash, embedding) of those hashes of ``wanted`` that are there."""
        return self.table.where(F.col("model") == model).join(wanted.select("content_hash").distinct(), "content_hash", "left_semi").select("content_hash", "embedding")

    def with_vectors(self, new: DataFrame) -> EmbeddingCache:
        """This and the new vectors, which win."""
        key = F.concat_ws("\u0000", "model", "content_hash").alias("_k")
        both = upserted(self.table.select(key, "*"), new.select(key, "content_hash", "model", "embedding"), "_k")
        return EmbeddingCache(both.drop("_k"))


class GraphCache:
    """The arcs of a graph by direction, held in memory and on disk until they are dropped; for many walks over one graph."""

    def __init__(self, edges: DataFrame):
        self.edges = edges
        self._held: dict[str, DataFrame] = {}

    def arcs(self, direction: str = "both") -> DataFrame:
        if direction not in self._held:
            self._held[direction] = arcs(self.edges, direction).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
        return self._held[direction]

    def neighbours(self, ids: list[str], direction: str = "both") -> DataFrame:
        return self.arcs(direction).where(F.col("src").isin(ids)).groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))

    def invalidate(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()


class CacheManager:
    """The caches of one engine; after a write all of them are dropped."""

    def __init__(self, queries: int = 100, vectors: int = 1000, seconds: float = 60.0):
        self.queries, self.vectors = QueryCache(queries, seconds), LruCache(vectors)
        self.graphs: list[GraphCache] = []

    def graph(self, edges: DataFrame) -> GraphCache:
        self.graphs.append(GraphCache(edges))
        return self.graphs[-1]

    def invalidate(self) -> None:
        self.queries.invalidate()
        self.vectors.clear()
        for g in self.graphs:
            g.invalidate()
        self.graphs.clear()

    def stats(self) -> dict[str, int]:
        return {"query_hits": self.queries.hits, "query_misses": self.queries.misses, "vector_hits": self.vectors.hits, "vector_misses": self.vectors.misses}
