"""Queries of the general data operators: records to process, and references without target."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.errors import StorageError
from sedimark.operators.incremental import current_rows, indexed_state
from sedimark.operators.references import ForeignKey, Keyed, cascade, direct, records
from sedimark.sources.tables import table
from sedimark.storage_paths import shared_dir


def _state(spark: SparkSession, folder: str):
    """The state that the log of past runs amounts to, and the files as they are now."""
    state = indexed_state(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}", table(spark, folder, "index_state"))
    return state, current_rows(table(spark, folder, "file_meta"), "file_id", "hash", "modified")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    state, now = _state(spark, folder)
    return state.select(now).select(F.col("key").alias("file_id"))


def p1_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What two runs record, the first of which is lost before it commits: the hash of each file that was due, and whether it is new or changed.

    The lost run's records come again; a run that commits on its base afterwards is turned away.
    """
    state, now = _state(spark, folder)
    base = state.version()
    lost = state.select(now)
    state.commit(state.select(now), base)
    try:
        state.commit(lost, base)
    except StorageError:
        pass
    before, after = state.read(base), state.read()
    old = before.select("key", F.col("hash").alias("old"))
    done = after.join(old, "key", "left").where(~F.col("hash").eqNullSafe(F.col("old")))
    return done.select(F.col("key").alias("file_id"), "hash", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("change"))


def _cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Files are the targets of chunks, chunks of their nodes, nodes of the edges."""
    chunk = F.when(F.col("node_type") == "Chunk", F.col("ref_id"))
    tables = {
        "chunks": Keyed(table(spark, folder, "chunks"), "chunk_id", "created_at"),
        "file_meta": Keyed(table(spark, folder, "file_meta"), "file_id"),
        "graph_edges": Keyed(table(spark, folder, "graph_edges"), "edge_id", "created_at"),
        "graph_nodes": Keyed(table(spark, folder, "graph_nodes").withColumn("chunk_ref", chunk), "id", "created_at"),
    }
    keys = [ForeignKey("chunks", "file_id", "file_meta"), ForeignKey("graph_nodes", "chunk_ref", "chunks"), ForeignKey("graph_edges", "from_id", "graph_nodes", True), ForeignKey("graph_edges", "to_id", "graph_nodes", True)]
    return cascade(tables, keys)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The direct orphans of the cascade among the references that are stored as such; a node's chunk is one by its type only."""
    return direct(_cascade(spark, folder)).where(F.col("table_name") != "graph_nodes").select("table_name", "field_name", "record_id", "period", "reason")


def p2_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans per table, month and depth, from the chunks by their nodes down to the edges."""
    return records(_cascade(spark, folder)).groupBy("table_name", "period", "origin", "depth").agg(F.count("*").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_changes": p1_changes, "p2_found": p2_found, "p2_cascade": p2_cascade}

_CLEAN = r"nullif(regexp_replace(lower(regexp_replace(hash, '^\s+|\s+$', '', 'g')), '^sha256:\s*', ''), '')"
_P1 = rf"""
WITH now AS (
  SELECT file_id, h FROM (
    SELECT file_id, {_CLEAN} AS h, row_number() OVER (PARTITION BY file_id ORDER BY modified DESC NULLS LAST, {_CLEAN} DESC NULLS LAST) AS r
    FROM file_meta WHERE file_id IS NOT NULL) WHERE r = 1),
ok AS (
  SELECT file_id, h FROM (
    SELECT file_id, {_CLEAN} AS h, row_number() OVER (PARTITION BY file_id ORDER BY last_indexed DESC NULLS LAST, {_CLEAN} DESC) AS r
    FROM index_state WHERE file_id IS NOT NULL AND lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) = 'indexed' AND {_CLEAN} IS NOT NULL) WHERE r = 1)
SELECT %s FROM now LEFT JOIN ok USING (file_id) WHERE now.h IS NOT NULL AND (ok.h IS NULL OR ok.h <> now.h)
"""
_MONTH = "coalesce(strftime(make_timestamp(seen * 1000), '%Y-%m'), 'unknown')"
_P2 = f"""
WITH node AS (SELECT id, min(created_at) AS t FROM graph_nodes WHERE id IS NOT NULL GROUP BY id),
edge_at AS (SELECT edge_id, min(created_at) AS seen FROM graph_edges GROUP BY edge_id),
edge AS (
  SELECT DISTINCT e.edge_id, f AS field_name, ref, seen FROM (
    SELECT edge_id, 'from_id' AS f, from_id AS ref FROM graph_edges UNION ALL SELECT edge_id, 'to_id', to_id FROM graph_edges) e
  JOIN edge_at a ON e.edge_id IS NOT DISTINCT FROM a.edge_id WHERE ref IS NOT NULL AND ref <> ''),
chunk_at AS (SELECT chunk_id, min(created_at) AS seen FROM chunks GROUP BY chunk_id)
SELECT DISTINCT 'graph_edges' AS table_name, field_name, edge_id AS record_id, {_MONTH} AS period,
  CASE WHEN node.id IS NULL THEN 'absent' ELSE 'late' END AS reason
FROM edge LEFT JOIN node ON node.id = ref WHERE node.id IS NULL OR t > seen
UNION ALL
SELECT DISTINCT 'chunks', 'file_id', c.chunk_id, {_MONTH}, 'absent'
FROM chunks c JOIN chunk_at a ON c.chunk_id IS NOT DISTINCT FROM a.chunk_id
WHERE c.file_id IS NOT NULL AND c.file_id <> '' AND NOT EXISTS (SELECT 1 FROM file_meta f WHERE f.file_id = c.file_id)
"""
_P2O = f"""
WITH found AS ({_P2}),
bad AS (SELECT DISTINCT record_id AS id FROM found WHERE table_name = 'chunks'),
node AS (
  SELECT id, min(CASE WHEN c.chunk_id IS NULL THEN 0 ELSE 1 END) AS depth
  FROM (SELECT id, ref_id FROM graph_nodes WHERE node_type = 'Chunk' AND ref_id IS NOT NULL AND ref_id <> '') n
  LEFT JOIN (SELECT DISTINCT chunk_id FROM chunks) c ON c.chunk_id = n.ref_id
  WHERE c.chunk_id IS NULL OR n.ref_id IN (SELECT id FROM bad WHERE id IS NOT NULL) GROUP BY id),
edge AS (
  SELECT id, min(depth) AS depth FROM (
    SELECT record_id AS id, 0 AS depth FROM found WHERE table_name = 'graph_edges'
    UNION ALL SELECT e.edge_id, n.depth + 1 FROM graph_edges e JOIN node n ON n.id = e.from_id WHERE e.from_id <> ''
    UNION ALL SELECT e.edge_id, n.depth + 1 FROM graph_edges e JOIN node n ON n.id = e.to_id WHERE e.to_id <> '') GROUP BY id),
dated AS (
  SELECT 'chunks' AS table_name, depth, seen FROM (SELECT id, 0 AS depth FROM bad) b JOIN (SELECT chunk_id, min(created_at) AS seen FROM chunks GROUP BY chunk_id) a ON a.chunk_id IS NOT DISTINCT FROM b.id
  UNION ALL SELECT 'graph_nodes', depth, seen FROM node b JOIN (SELECT id, min(created_at) AS seen FROM graph_nodes GROUP BY id) a ON a.id IS NOT DISTINCT FROM b.id
  UNION ALL SELECT 'graph_edges', depth, seen FROM edge b JOIN (SELECT edge_id, min(created_at) AS seen FROM graph_edges GROUP BY edge_id) a ON a.edge_id IS NOT DISTINCT FROM b.id)
SELECT table_name, {_MONTH} AS period, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END AS origin, depth, count(*) AS n FROM dated GROUP BY ALL
"""
ORACLE = {"p1_found": _P1 % "file_id", "p1_changes": _P1 % "file_id, now.h AS hash, CASE WHEN ok.h IS NULL THEN 'new' ELSE 'changed' END AS change", "p2_found": _P2, "p2_cascade": _P2O}
