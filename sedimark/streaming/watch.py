"""Watching a directory as a stream, and keeping an index up to date with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimark.functions import text as T
from sedimark.operators.embedding import Embedder
from sedimark.operators.indexing import IndexConfig, IndexReport, index
from sedimark.operators.store import Store
from sedimark.sources.scan import changes, include

SEEN = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, files_per_batch: int = 100) -> DataFrame:
    """New files under a directory as they come: (path, modified, size, hash, extension). Empty files don't come."""
    raw = spark.readStream.format("binaryFile").schema(SEEN).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    found = raw.select(path.alias("path"), F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))
    return found.where(include(F.col("path"))).withColumn("extension", F.lower(T.extension(F.col("path"))))


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "100 milliseconds", once: bool = False) -> StreamingQuery:
    """Runs ``handle`` on every batch. After a failure the stream goes on at its checkpoint; a batch may come again with the same number."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def index_changes(store: Store, root: str, embedder: Embedder, checkpoint: str, config: IndexConfig = IndexConfig(), done: Callable[[IndexReport], None] = lambda r: None, interval: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Indexes the files of each batch of the stream; what is indexed already with its present hash is left alone, so a batch that comes again does nothing."""

    def handle(batch: DataFrame, _: int) -> None:
        files = batch.select(F.sha2("path", 256).alias("file_id"), "path", "hash", "size", "modified", "extension")
        # of a file that changed twice within a batch the last
        last = files.groupBy("file_id").agg(F.max(F.struct("modified", "path", "hash", "size", "extension")).alias("m")).select("file_id", "m.path", "m.hash", "m.size", "m.modified", "m.extension")
        report = index(store, root, embedder, config, files=last)
        if report.total:
            done(report)

    return start(watch(store.spark, root), handle, checkpoint, interval, once)


def events(before: DataFrame, after: DataFrame) -> DataFrame:
    """File events between two scans."""
    return changes(before, after)


def debounced(stream: DataFrame, seconds: int = 1, late: str = "10 minutes") -> DataFrame:
    """(path, window_start, events, last): events (path, ts) taken together by path and time; what comes later than ``late`` is left out."""
    w = F.window("ts", f"{seconds} seconds")
    return stream.withWatermark("ts", late).groupBy(w, "path").agg(F.count("*").alias("events"), F.max("ts").alias("last")).select("path", F.col("window.start").alias("window_start"), "events", "last")


def in_last_minute(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """``events`` with the number of the key's events in the time up to each, itself among them: what a sliding rate limit sees."""
    from pyspark.sql import Window as W

    micros = F.unix_micros(ts)
    w = W.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("recent", F.count("*").over(w))
