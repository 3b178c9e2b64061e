"""The indexing run: scan, select, parse, chunk, embed, build the graph, store, record state."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.errors import IndexingError
from sedimark.operators import chunking, embedding, graph
from sedimark.operators.incremental import clean_hash, last_success
from sedimark.operators.store import Store
from sedimark.sources import formats, scan
from sedimark.storage_paths import written


@dataclass(frozen=True)
class IndexConfig:
    """``mode``: Incremental leaves indexed files alone, Full takes all, Watch is Incremental over what a stream has seen."""

    mode: str = "Incremental"
    chunking: chunking.ChunkConfig = chunking.ChunkConfig()
    batch: int = 10
    references: bool = True
    entities: bool = True
    entity_least: int = 3


@dataclass
class IndexReport:
    total: int = 0
    indexed: int = 0
    skipped: int = 0
    failed: int = 0
    chunks: int = 0
    seconds: float = 0.0
    errors: list[str] = field(default_factory=list)

    def merge(self, other: IndexReport) -> IndexReport:
        return IndexReport(self.total + other.total, self.indexed + other.indexed, self.skipped + other.skipped, self.failed + other.failed, self.chunks + other.chunks, self.seconds + other.seconds, self.errors + other.errors)


def report(states: DataFrame) -> DataFrame:
    """One row from (status, chunks) of files: total, indexed, skipped, failed, chunks."""
    s = F.lower(F.trim("status"))
    return states.agg(F.count("*").alias("total"), *[F.count_if(s == k).alias(k) for k in ("indexed", "skipped", "failed")], F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def to_process(files: DataFrame, state: DataFrame, mode: str = "Incremental") -> DataFrame:
    """Files whose present hash isn't that of their last success; all of them in mode Full.

    Hashes and statuses are compared as ``pending_files`` does, so a file that went back to an older content is due again.
    """
    if mode == "Full":
        return files
    done = last_success(state, "file_id", "hash", "last_indexed", "status", "Indexed")
    met = files.join(done.withColumnsRenamed({"key": "file_id", "hash": "_done"}), "file_id", "left")
    return met.where(~clean_hash(F.col("hash")).eqNullSafe(F.col("_done"))).drop("_done")


def index(store: Store, root: str, embedder: embedding.Embedder, config: IndexConfig = IndexConfig(), progress: Callable[[str, int], None] = lambda *_: None, files: DataFrame | None = None) -> IndexReport:
    """Indexes a directory into the store, or only ``files`` of it as a scan has them. Rows of a file that is indexed again are replaced.

    All tables change in one transaction at the end, so a run that fails leaves the store as it was
    and its files are due again.
    """
    store.check_writable()
    began, spark = time.time(), store.spark
    if config.mode not in ("Full", "Incremental", "Watch"):
        raise IndexingError(f"no such mode: {config.mode}")
    progress("started", 0)
    files = written(scan.scan(spark, root) if files is None else files, "scan")
    due = written(to_process(files, store.state.read(), config.mode), "due")
    total, n = files.count(), due.count()
    progress("scanned", total)
    progress("skipped", total - n)
    if not n:
        progress("done", 0)
        return IndexReport(total=total, skipped=total, seconds=time.time() - began)

    def load(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                try:
                    with open(b.column(1)[i].as_py(), "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([data], pa.binary())], names=["file_id", "extension", "content"])

    raw = due.select("file_id", "path", "extension").mapInArrow(load, "file_id string, extension string, content binary")
    parsed = written(formats.parse_files(raw), "parsed")
    progress("parsed", n)
    chunks = chunking.chunk(formats.blocks(parsed), config.chunking)
    now = int(time.time() * 1000)
    progress("chunking", n)
    indexed = written(embedding.index_chunks(chunks, store.chunks.read(), embedder, batch=config.batch).withColumn("created_at", F.lit(now)), "indexed")
    progress("embedded", indexed.count())
    progress("graph", 0)
    nodes, edges = graph.build(indexed, config.references, config.entities, config.entity_least)
    counts = indexed.groupBy("file_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "failed").alias("bad"))
    outcome = written(due.join(parsed.select("file_id", "error"), "file_id", "left").join(counts, "file_id", "left").select("file_id", "path", "hash", "size", "modified", "extension", F.coalesce("chunks", F.lit(0)).alias("chunks"), "error", F.when(F.col("error").isNotNull() | (F.coalesce("bad", F.lit(0)) > 0), "Failed").otherwise("Indexed").alias("status")), "outcome")
    progress("storing", n)
    with store:
        gone = due.select("file_id")
        for name, rows in (("chunks", indexed), ("nodes", nodes.withColumn("created_at", F.lit(now))), ("edges", edges.withColumn("created_at", F.lit(now)))):
            t = store.tables[name]
            t.upsert(rows, t.read().join(gone, "file_id", "left_semi"))
        store.files.upsert(outcome.select("file_id", "path", "hash", "size", "modified", "extension", F.lit(now).alias("last_indexed")))
        store.state.upsert(outcome.select("file_id", "hash", F.lit(now).alias("last_indexed"), "status"))
    r = report(outcome).first()
    errors = [x.error for x in outcome.where(F.col("error").isNotNull()).select("error").limit(100).collect()]
    if r.failed:
        progress("failed", r.failed)
    progress("done", n)
    return IndexReport(total, r.indexed, total - n, r.failed, r.chunks, time.time() - began, errors)
