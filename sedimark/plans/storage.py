"""Queries of stores, incremental indexing, change detection and the event stream."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimark.errors import DuplicateKey, ReadOnlyError, StorageError
from sedimark.operators import caching, embedding, graph, indexing, queueing, store
from sedimark.plans.general import _CLEAN
from sedimark.sources import scan
from sedimark.sources.tables import table
from sedimark.storage_paths import shared_dir
from sedimark.streaming import watch


def _scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last scan of every path."""
    f = table(spark, folder, "file_meta").where(F.col("path").isNotNull())
    keys = F.struct(F.coalesce("modified", F.lit(-1)).alias("m"), F.coalesce("last_indexed", F.lit(-1)).alias("l"), F.coalesce("hash", F.lit("")).alias("h"))
    both = f.groupBy("path").agg(F.min(keys).alias("a"), F.max(keys).alias("b"))
    return both.select("path", F.col("a.h").alias("hash"), F.col("a.m").alias("modified"), F.col("a.l").alias("last_indexed")), both.select("path", F.col("b.h").alias("hash"), F.col("b.m").alias("modified"))


def _store(spark: SparkSession) -> store.Store:
    """A new and empty store."""
    return store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _in(spark: SparkSession, folder: str, *names: str) -> store.Store:
    """A store with the latest rows of these tables."""
    s, source = _store(spark), {"files": ("file_meta", "modified"), "chunks": ("chunks", "created_at"), "nodes": ("graph_nodes", "created_at"), "edges": ("graph_edges", "created_at"), "state": ("index_state", "last_indexed")}
    with s:
        for n in names:
            s.tables[n].upsert(graph.latest(table(spark, folder, source[n][0]), s.tables[n].key, source[n][1]))
    return s


def store_latest_files(spark, folder):
    """The earliest and then the latest scans of all files, upserted into a store."""
    s, f = _store(spark), table(spark, folder, "file_meta")
    s.files.upsert(f.where(F.col("file_id").isNotNull()))
    s.files.upsert(graph.latest(f, "file_id", "modified"))
    return s.files.read().select("file_id", "path", "size", "modified")


def store_lookups(spark, folder):
    """What the store's lookups find, each for the least value that there is."""
    s = _in(spark, folder, "files", "chunks", "nodes", "edges", "state")
    first = {n: s.tables[t].read().agg(F.min(c)).first()[0] for n, t, c in (("path", "files", "path"), ("file", "files", "file_id"), ("chunk", "chunks", "chunk_id"), ("ref", "nodes", "ref_id"), ("from", "edges", "from_id"), ("node", "nodes", "id"), ("to", "edges", "to_id"))}
    found = {
        "file by path": s.files.where(path=first["path"]).select(F.col("file_id").alias("id")), "file": s.files.get(first["file"]).select(F.col("file_id").alias("id")),
        "chunk": s.chunks.get(first["chunk"]).select(F.col("chunk_id").alias("id")), "chunks without heading": s.chunks.where(heading=None).select(F.col("chunk_id").alias("id")),
        "node": s.nodes.get(first["node"]).select("id"), "node by ref": s.nodes.where(ref_id=first["ref"]).select("id"), "headings": s.nodes.where(node_type="Heading").select("id"),
        "forward": s.edges_of(first["from"], "forward").select(F.col("edge_id").alias("id")), "backward": s.edges_of(first["to"], "backward").select(F.col("edge_id").alias("id")), "both": s.edges_of(first["from"]).select(F.col("edge_id").alias("id")),
        "references": s.edges.where(relation="References").select(F.col("edge_id").alias("id")), "state": s.state.get(first["file"]).select(F.col("file_id").alias("id")),
    }
    parts = [df.select(F.lit(n).alias("lookup"), "id") for n, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def store_in_order(spark, folder):
    """Files by path and pending states by file, with their places."""
    s = _in(spark, folder, "files", "state")
    numbered = lambda df, name, *by: df.select(F.lit(name).alias("list"), "file_id", F.row_number().over(W.partitionBy(F.lit(name)).orderBy(*by)).alias("place"))
    return numbered(s.files_in_order(), "files", F.asc_nulls_first("path"), "file_id").unionByName(numbered(s.pending(), "pending", "file_id"))


def store_delete_file(spark, folder):
    """What each table has before and after everything of the file with the most edges is deleted, and what the deletion reports."""
    s = _in(spark, folder, "files", "chunks", "nodes", "edges", "state")
    f = s.edges.read().where(F.col("file_id").isNotNull()).groupBy("file_id").count().orderBy(F.desc("count"), "file_id").first()[0]
    before = s.counts()
    gone = s.delete_file(f)
    after = s.counts()
    return spark.createDataFrame([(n, before[n], gone[n], after[n]) for n in before], "name string, before long, gone long, after long")


def store_transactions(spark, folder):
    """Rows of files and states after each step: a rolled back transaction, one within another, a duplicate, a deletion, a conflict of two writers, a read-only store, and clearing."""
    s = _in(spark, folder, "files")
    files, seen = s.files.read(), []
    note = lambda step, ok=True: seen.append((step, s.files.count(), s.state.count(), ok))
    states = files.select("file_id", "hash", "last_indexed", F.lit("Indexed").alias("status"))
    note("begin")
    s.begin()
    s.files.clear()
    s.state.append(states)
    note("within")
    s.rollback()
    note("rolled back")
    with s, s:
        s.state.append(states)
    note("committed")

    def refused(step: str, kind: type[Exception], f) -> None:
        try:
            f()
            note(step, False)
        except kind:
            note(step)

    refused("duplicate", DuplicateKey, lambda: s.state.append(states))
    refused("read only", ReadOnlyError, lambda: store.Store(spark, s.folder, True).files.clear())

    def conflict() -> None:
        with s:
            s.files.clear()
            store.Store(spark, s.folder).state.delete(F.col("hash").isNull())

    refused("conflict", StorageError, conflict)
    s.state.clear()
    note("cleared")
    return spark.createDataFrame(seen, "step string, files long, states long, ok boolean")


def store_vectors(spark, folder):
    """Chunks whose vectors are stored again for one model, and those of the file with the most chunks deleted, by file and model."""
    s = _in(spark, folder, "chunks")
    c = s.chunks.read()
    f = c.where(F.col("file_id").isNotNull()).groupBy("file_id").count().orderBy(F.desc("count"), "file_id").first()[0]
    s.chunks.upsert(c.where(F.col("embedding").isNull()).withColumns({"embedding": F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"), "dimension": F.lit(2).cast("long"), "model": F.lit("flat")}))
    s.chunks.delete(F.col("file_id") == f)
    return s.chunks.read().groupBy("file_id", "model").agg(F.count("*").alias("chunks"), F.sum(F.col("dimension").cast("long")).alias("dimensions"))


def moves_resolved(spark, folder):
    """Where files that were scanned at several times are by the moves that a store has recorded, and how often each was moved."""
    s, m = _store(spark), table(spark, folder, "file_meta").where(F.col("file_id").isNotNull() & F.col("modified").isNotNull()).select("file_id", F.concat(F.lit("/old"), "path").alias("old_path"), F.concat("path", F.lit("#"), F.col("modified").cast("string")).alias("new_path"), F.col("modified").alias("timestamp")).distinct()
    s.moves.append(m)
    s.record_move("new", "/a", "/b", 1)
    one = s.moves.read().agg(F.min("file_id")).first()[0]
    n = scan.move_history(s.moves.read(), one).count()
    times = s.moves.read().groupBy("file_id").agg(F.count("*").alias("moves"))
    return scan.resolved_paths(s.moves.read()).join(times, "file_id").withColumn("history", F.when(F.col("file_id") == one, n))


def store_needs_update(spark, folder):
    stored, scanned = _scans(spark, folder)
    return store.needs_update(scanned, stored).select("path", "hash")


def store_pending(spark, folder):
    """Each file's latest state that isn't Indexed."""
    s = _in(spark, folder, "state").pending().where(F.col("status").isNotNull())
    return s.select("file_id", F.lower(F.trim(F.regexp_replace("status", "\t", " "))).alias("status"))


def store_known_contents(spark, folder):
    """Chunks whose content and model another chunk has too."""
    c = table(spark, folder, "chunks").select("chunk_id", F.sha2("content", 256).alias("h"), "model").distinct()
    twin = c.groupBy("h", "model").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return c.join(twin, ["h", "model"], "left_semi").select("chunk_id")


def store_by_heading(spark, folder):
    """Chunks by file and heading, null too, in the order of keys."""
    s = _in(spark, folder, "chunks")
    wanted = s.chunks.read().select("file_id", "heading").distinct()
    return s.chunks.among(wanted).groupBy("file_id", "heading").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first"))


def store_delete(spark, folder):
    """What is left of the chunks when files that were never scanned are deleted."""
    s, c = _store(spark), table(spark, folder, "chunks").where(F.col("chunk_id").isNotNull())
    s.chunks.upsert(graph.latest(c, "chunk_id"))
    known = table(spark, folder, "file_meta").select("file_id").where(F.col("file_id").isNotNull()).distinct()
    s.chunks.replace(s.chunks.among(known))
    return s.chunks.read().groupBy("file_id").agg(F.count("*").alias("chunks"))


def store_edges(spark, folder):
    """Edges of each node by direction and relation."""
    e = _in(spark, folder, "edges").edges.read()
    ends = F.array(F.struct(F.col("from_id").alias("id"), F.lit("Forward").alias("direction")), F.struct(F.col("to_id").alias("id"), F.lit("Backward").alias("direction")))
    return e.select("relation", F.explode(ends).alias("x")).where(F.col("x.id").isNotNull()).groupBy("x.id", "x.direction", "relation").agg(F.count("*").alias("n"))


def store_counts(spark, folder):
    s = _in(spark, folder, "files", "chunks", "nodes", "edges")
    return store.count_all(*(s.tables[n].read() for n in ("files", "chunks", "nodes", "edges")))


def embed_missing(spark, folder):
    """Chunks without a vector whose content no stored vector of the model has."""
    c = graph.latest(table(spark, folder, "chunks"), "chunk_id").select("chunk_id", "content", "embedding", "model")
    stored = c.where(F.col("embedding").isNotNull()).select(F.sha2("content", 256).alias("content_hash"), "model")
    return embedding.missing(c.where(F.col("embedding").isNull()), stored, "tide-embed-l").select("chunk_id")


def embed_report(spark, folder):
    """An embedding run over all documents against those that share their text with an earlier one."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    twins = d.where(F.col("content").isNotNull()).groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    e = embedding.HashingEmbedder(8)
    stored = twins.select("content_hash", F.lit(e.model).alias("model"), F.array(*[F.lit(0.0)] * 8).cast("array<float>").alias("embedding"))
    return embedding.index_report(embedding.index_chunks(d, stored, e))


def index_due(spark, folder):
    """Scans whose hash isn't that of the file's last success."""
    s = table(spark, folder, "index_state")
    return indexing.to_process(table(spark, folder, "file_meta").select("file_id", "hash").distinct(), s).select("file_id", "hash")


def index_report(spark, folder):
    s = table(spark, folder, "index_state").select(F.regexp_replace("status", "\t", " ").alias("status"), F.lit(1).alias("chunks"))
    return indexing.report(s)


def watch_changes(spark, folder):
    """Events between the first and the last scan of every file, when boards' files weren't there at first and those of 2023 outside ops are gone at last."""
    a, b = _scans(spark, folder)
    before = a.where(~F.col("path").contains("/board/"))
    after = b.where(~F.col("path").contains("/2023/") | F.col("path").contains("/ops/"))
    return scan.changes(before.select("path", F.nullif("hash", F.lit("")).alias("hash")), after.select("path", F.nullif("hash", F.lit("")).alias("hash")))


def watch_batches(spark, folder):
    """Events of each kind by second."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.debounced(e, 3600).select("path", F.unix_millis("window_start").alias("window_ms"), "events")


def watch_rate(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return watch.in_last_minute(e, "user_id", "ts", 86_400).select("event_id", "recent")


def embed_fixed(spark, folder):
    """Each distinct text of the documents, embedded one by one; the vectors come out at unit length."""
    d = table(spark, folder, "documents").select(F.col("text").alias("content"))
    e = embedding.embed_texts(d, embedding.FixedEmbedder(), 1)
    return e.select("content_hash", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.size("embedding").alias("size"), "model", "dimension", "error")


class _Short(embedding.FixedEmbedder):
    """An embedder that forgets a dimension for long texts."""

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [v[1:] if len(t) > 500 else v for t, v in zip(texts, super().embed_batch(texts))]


def embed_checked(spark, folder):
    """How many distinct texts fail the check of dimensions, and how many don't."""
    d = table(spark, folder, "documents").select(F.col("text").alias("content"))
    return embedding.embed_texts(d, _Short(), 1).groupBy(F.regexp_extract("error", "^[A-Za-z]+", 0).alias("error"), F.col("embedding").isNotNull().alias("ok")).agg(F.count("*").alias("texts"))


def embed_dimensions(spark, folder):
    """Dimensions by what is asked for, configured, known of the model, or usual with the provider."""
    cases = [("ollama", "nomic-embed-text", None, None), ("openai", "text-embedding-3-large", None, None), ("openai", "other", None, None), ("gemini", "gemini-embedding-001", 256, None), ("anthropic", "other", None, 99), ("nobody", "other", None, None)]
    return spark.createDataFrame([(p, m, embedding.resolve_dimension(p, m, a, c)) for p, m, a, c in cases], "provider string, model string, dimension int")


def retry_delays(spark, folder):
    """The delay before each further try, in milliseconds."""
    p = embedding.RetryPolicy()
    return spark.createDataFrame([(n, round(1000 * p.delay(n))) for n in range(12)], "n int, ms long")


def queue_order(spark, folder):
    """The places of the events as jobs by type of event, in a queue that holds half of them."""
    names = {"click": "high", "view": "normal"}
    rows = table(spark, folder, "events").select("event_id", "event_type").orderBy("event_id")
    q = queueing.JobQueue((rows.count() + 1) // 2)
    for r in rows.toLocalIterator():  # the queue lives in one process
        q.put(r.event_id, names.get(r.event_type, "low"))
    taken = list(iter(lambda: q.take_under_pressure(lambda: False), None))
    return spark.createDataFrame([(e, i) for i, e in enumerate(taken)], "event_id long, place int")


def lru_hits(spark, folder):
    """Hits and misses of a cache of eight users over the events in order, by type of event."""
    cache, seen = caching.LruCache(8), {}
    for r in table(spark, folder, "events").select("event_id", "event_type", "user_id").orderBy("event_id").toLocalIterator():
        hit = cache.get(r.user_id) is not None
        cache.put(r.user_id, r.event_id)
        n = seen.setdefault(r.event_type, [0, 0])
        n[not hit] += 1
    return spark.createDataFrame([(k, *v) for k, v in seen.items()], "event_type string, hits long, misses long")


QUERIES = {f.__name__: f for f in (embed_fixed, embed_checked, embed_dimensions, retry_delays, queue_order, lru_hits, store_lookups, store_in_order, store_delete_file, store_transactions, store_vectors, moves_resolved, store_latest_files, store_needs_update, store_pending, store_known_contents, store_by_heading, store_delete, store_edges, store_counts, embed_missing, embed_report, index_due, index_report, watch_changes, watch_batches, watch_rate)}

_SCANS = "scans AS (SELECT path, min((coalesce(modified, -1), coalesce(last_indexed, -1), coalesce(hash, ''))) AS a, max((coalesce(modified, -1), coalesce(last_indexed, -1), coalesce(hash, ''))) AS b FROM file_meta WHERE path IS NOT NULL GROUP BY path)"
_CHUNK = "chunk AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id, created_at DESC NULLS LAST)"
_STATUS = r"lower(regexp_replace(status, '^\s+|\s+$', '', 'g'))"
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY %s ORDER BY %s DESC NULLS LAST, %s) AS _r FROM %s WHERE %s IS NOT NULL) WHERE _r = 1"
_down = lambda *cols: ", ".join(f"{c} DESC NULLS LAST" for c in cols)
_TABLES = f"""
files AS ({_LAST % ("file_id", "modified", _down("path", "hash", "size"), "file_meta", "file_id")}),
chunk AS ({_LAST % ("chunk_id", "created_at", _down("file_id", "content", "heading", "page", "slide", "sheet", "block_type", "content_hash"), "chunks", "chunk_id")}),
node AS ({_LAST % ("id", "created_at", _down("node_type", "ref_id", "label", "file_id"), "graph_nodes", "id")}),
edge AS ({_LAST % ("edge_id", "created_at", _down("from_id", "to_id", "relation", "weight"), "graph_edges", "edge_id")}),
state AS ({_LAST % ("file_id", "last_indexed", _down("hash", "status"), "index_state", "file_id")})"""
_HOT = "hot AS (SELECT file_id FROM %s WHERE file_id IS NOT NULL GROUP BY file_id ORDER BY count(*) DESC, file_id LIMIT 1)"
ORACLE = {
    "embed_fixed": "SELECT DISTINCT sha256(text) AS content_hash, CASE WHEN regexp_matches(text, '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS first, 4::INT AS size, 'fixed' AS model, 4::BIGINT AS dimension, NULL::VARCHAR AS error FROM documents WHERE text IS NOT NULL",
    "embed_checked": "SELECT CASE WHEN length(text) > 500 THEN 'DimensionMismatch' END AS error, length(text) <= 500 AS ok, count(DISTINCT text) AS texts FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "embed_dimensions": "SELECT * FROM (VALUES ('ollama', 'nomic-embed-text', 768), ('openai', 'text-embedding-3-large', 3072), ('openai', 'other', 1536), ('gemini', 'gemini-embedding-001', 256), ('anthropic', 'other', 99), ('nobody', 'other', 768)) v(provider, model, dimension)",
    "retry_delays": "SELECT n::INT AS n, least(30000, 100 * 2 ** n)::BIGINT AS ms FROM range(12) r(n)",
    "queue_order": "WITH held AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS n FROM events) SELECT event_id, (row_number() OVER (ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, event_id) - 1)::INT AS place FROM held WHERE r <= (n + 1) // 2",
    "lru_hits": """WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events), b AS (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY i) AS p FROM e),
d AS (SELECT b.event_type, b.i, b.p, (SELECT count(*) FROM b o WHERE o.i > b.p AND o.i < b.i AND (o.p IS NULL OR o.p <= b.p)) AS between_them FROM b)
SELECT event_type, count(*) FILTER (p IS NOT NULL AND between_them < 8) AS hits, count(*) FILTER (p IS NULL OR between_them >= 8) AS misses FROM d GROUP BY event_type""",
    "store_lookups": f"""WITH {_TABLES}
SELECT 'file by path' AS lookup, file_id AS id FROM files WHERE path = (SELECT min(path) FROM files) UNION ALL SELECT 'file', min(file_id) FROM files UNION ALL SELECT 'chunk', min(chunk_id) FROM chunk
UNION ALL SELECT 'chunks without heading', chunk_id FROM chunk WHERE heading IS NULL UNION ALL SELECT 'node', min(id) FROM node UNION ALL SELECT 'node by ref', id FROM node WHERE ref_id = (SELECT min(ref_id) FROM node)
UNION ALL SELECT 'headings', id FROM node WHERE node_type = 'Heading' UNION ALL SELECT 'forward', edge_id FROM edge WHERE from_id = (SELECT min(from_id) FROM edge) UNION ALL SELECT 'backward', edge_id FROM edge WHERE to_id = (SELECT min(to_id) FROM edge)
UNION ALL SELECT 'both', edge_id FROM edge WHERE from_id = (SELECT min(from_id) FROM edge) OR to_id = (SELECT min(from_id) FROM edge) UNION ALL SELECT 'references', edge_id FROM edge WHERE relation = 'References'
UNION ALL SELECT 'state', file_id FROM state WHERE file_id = (SELECT min(file_id) FROM files)""",
    "store_in_order": f"""WITH {_TABLES}
SELECT 'files' AS list, file_id, row_number() OVER (ORDER BY path NULLS FIRST, file_id)::INT AS place FROM files
UNION ALL SELECT 'pending', file_id, row_number() OVER (ORDER BY file_id)::INT FROM state WHERE coalesce({_STATUS}, '') <> 'indexed'""",
    "store_delete_file": f"""WITH {_TABLES}, {_HOT % "edge"}
SELECT name, count(*) AS before, count(*) FILTER (hit) AS gone, count(*) FILTER (NOT hit) AS after FROM (
  SELECT unnest(['files', 'chunks', 'nodes', 'edges']) AS name, NULL AS hit UNION ALL SELECT 'files', file_id = (FROM hot) FROM files UNION ALL SELECT 'chunks', coalesce(file_id = (FROM hot), false) FROM chunk
  UNION ALL SELECT 'nodes', coalesce(file_id = (FROM hot), false) FROM node UNION ALL SELECT 'edges', coalesce(file_id = (FROM hot), false) FROM edge) WHERE hit IS NOT NULL GROUP BY name""",
    "store_transactions": f"""WITH {_TABLES}, n AS (SELECT count(*) AS n FROM files), h AS (SELECT count(*) AS h FROM files WHERE hash IS NOT NULL)
SELECT s.*, true AS ok FROM n, h, LATERAL (VALUES ('begin', n, 0), ('within', 0, n), ('rolled back', n, 0), ('committed', n, n), ('duplicate', n, n), ('read only', n, n), ('conflict', n, h), ('cleared', n, 0)) s(step, files, states)""",
    "store_vectors": f"""WITH {_TABLES}, {_HOT % "chunk"}
SELECT file_id, CASE WHEN embedding IS NULL THEN 'flat' ELSE model END AS model, count(*) AS chunks, sum(CASE WHEN embedding IS NULL THEN 2 ELSE dimension END)::BIGINT AS dimensions FROM chunk WHERE file_id IS DISTINCT FROM (FROM hot) GROUP BY ALL""",
    "moves_resolved": """WITH m AS (SELECT DISTINCT file_id, path || '#' || modified AS new_path, '/old' || path AS old_path, modified AS t FROM file_meta WHERE file_id IS NOT NULL AND modified IS NOT NULL UNION ALL SELECT 'new', '/b', '/a', 1)
SELECT file_id, max((t, new_path))[2] AS path, count(*) AS moves, CASE WHEN file_id = (SELECT min(file_id) FROM m) THEN count(*)::INT END AS history FROM m GROUP BY file_id""",
    "store_latest_files": "SELECT file_id, path, size, modified FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY modified DESC NULLS LAST, path DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST) AS r FROM file_meta WHERE file_id IS NOT NULL) WHERE r = 1",
    "store_needs_update": f"WITH {_SCANS} SELECT path, b[3] AS hash FROM scans WHERE a[3] <> b[3] OR a[1] <> b[1]",
    "store_pending": f"SELECT file_id, {_STATUS} AS status FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY last_indexed DESC NULLS LAST, hash DESC NULLS LAST, status DESC NULLS LAST) AS r FROM index_state WHERE file_id IS NOT NULL) WHERE r = 1 AND {_STATUS} <> 'indexed'",
    "store_known_contents": "WITH c AS (SELECT DISTINCT chunk_id, sha256(content) AS h, model FROM chunks) SELECT chunk_id FROM c WHERE (h, model) IN (SELECT (h, model) FROM c WHERE h IS NOT NULL AND model IS NOT NULL GROUP BY h, model HAVING count(*) > 1)",
    "store_by_heading": f"WITH {_CHUNK} SELECT file_id, heading, count(*) AS chunks, min(chunk_id) AS first FROM chunk GROUP BY ALL",
    "store_delete": "SELECT file_id, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE file_id IN (SELECT file_id FROM file_meta) GROUP BY ALL",
    "store_edges": "WITH e AS (SELECT DISTINCT ON (edge_id) * FROM graph_edges WHERE edge_id IS NOT NULL ORDER BY edge_id, created_at DESC NULLS LAST, from_id DESC NULLS LAST, to_id DESC NULLS LAST, relation DESC NULLS LAST) SELECT id, direction, relation, count(*) AS n FROM (SELECT from_id AS id, 'Forward' AS direction, relation FROM e UNION ALL SELECT to_id, 'Backward', relation FROM e) WHERE id IS NOT NULL GROUP BY ALL",
    "store_counts": "SELECT (SELECT count(DISTINCT file_id) FROM file_meta) AS files, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks, (SELECT count(DISTINCT id) FROM graph_nodes) AS nodes, (SELECT count(DISTINCT edge_id) FROM graph_edges) AS edges",
    "embed_missing": f"WITH {_CHUNK} SELECT chunk_id FROM chunk WHERE embedding IS NULL AND NOT EXISTS (SELECT 1 FROM chunk o WHERE o.embedding IS NOT NULL AND o.model = 'tide-embed-l' AND sha256(o.content) = sha256(chunk.content))",
    "embed_report": "SELECT count(*) AS total, count(*) FILTER (n = 1) AS embedded, count(*) FILTER (n > 1) AS skipped, 0::BIGINT AS failed FROM (SELECT count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL)",
    "index_due": f"""WITH ok AS (SELECT file_id, {_CLEAN} AS h, row_number() OVER (PARTITION BY file_id ORDER BY last_indexed DESC NULLS LAST, {_CLEAN} DESC) AS r FROM index_state WHERE file_id IS NOT NULL AND {_STATUS} = 'indexed' AND {_CLEAN} IS NOT NULL)
SELECT file_id, hash FROM (SELECT DISTINCT file_id, hash FROM file_meta) f LEFT JOIN (SELECT file_id, h FROM ok WHERE r = 1) USING (file_id) WHERE {_CLEAN} IS DISTINCT FROM h""",
    "index_report": f"SELECT count(*) AS total, count(*) FILTER ({_STATUS} = 'indexed') AS indexed, count(*) FILTER ({_STATUS} = 'skipped') AS skipped, count(*) FILTER ({_STATUS} = 'failed') AS failed, count(*)::BIGINT AS chunks FROM index_state",
    "watch_changes": f"""
WITH {_SCANS}, a AS (SELECT path, nullif(a[3], '') AS h FROM scans WHERE NOT contains(path, '/board/')), b AS (SELECT path, nullif(b[3], '') AS h FROM scans WHERE NOT contains(path, '/2023/') OR contains(path, '/ops/')),
gone AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM a WHERE path NOT IN (SELECT path FROM b)), new AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM a))
SELECT 'Modified' AS event_type, b.path, NULL AS old_path, b.h AS hash FROM a JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h
UNION ALL SELECT CASE WHEN g.path IS NULL THEN 'Created' WHEN w.path IS NULL THEN 'Deleted' ELSE 'Renamed' END, coalesce(w.path, g.path), CASE WHEN w.path IS NOT NULL THEN g.path END, coalesce(g.h, w.h) FROM gone g FULL JOIN new w ON g.h = w.h AND g.n = w.n""",
    "watch_batches": "SELECT event_type AS path, epoch_ms(date_trunc('hour', ts)) AS window_ms, count(*) AS events FROM events GROUP BY ALL",
    "watch_rate": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
}
