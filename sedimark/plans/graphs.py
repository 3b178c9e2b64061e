"""Queries of building and walking the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark import api
from sedimark.operators import graph, store
from sedimark.sources.tables import table
from sedimark.storage_paths import shared_dir


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return graph.latest(table(spark, folder, "chunks"), "chunk_id").select("chunk_id", "file_id", "heading", "content")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.latest(table(spark, folder, "graph_nodes"), "id")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.latest(table(spark, folder, "graph_edges"), "edge_id")


def graph_nodes_built(spark, folder):
    return graph.structural_nodes(_chunks(spark, folder)).select("id", "node_type", "ref_id", "file_id")


def graph_edges_built(spark, folder):
    return graph.structural_edges(_chunks(spark, folder)).select("edge_id", "from_id", "to_id", "relation", "weight", "file_id")


def graph_references(spark, folder):
    return graph.reference_matches(_chunks(spark, folder)).groupBy("chunk_id", "pattern", "matched").agg(F.count("*").alias("n"))


def graph_reference_edges(spark, folder):
    c = _chunks(spark, folder)
    return graph.reference_edges(c, graph.structural_nodes(c)).select("from_id", "to_id", "relation", "metadata").distinct()


def graph_repeated_words(spark, folder):
    return graph.repeated_words(_chunks(spark, folder), 3)


def graph_capitalised(spark, folder):
    c = _chunks(spark, folder)
    return c.select("chunk_id", F.explode(graph.capitalised_runs(F.col("content"))).alias("run")).groupBy("chunk_id", "run").agg(F.count("*").alias("n"))


def graph_mentions(spark, folder):
    c = _chunks(spark, folder)
    return graph.mention_edges(c, graph.entities(c, 3)).groupBy("file_id").agg(F.count("*").alias("mentions"))


def graph_neighbours(spark, folder):
    return graph.neighbours(_edges(spark, folder), _nodes(spark, folder))


def graph_entities_of_texts(spark, folder):
    """The entities of each chunk's text by itself."""
    return _chunks(spark, folder).select("chunk_id", F.explode(graph.entities_of_text(F.col("content"), 2)).alias("name"))


def graph_of_file(spark, folder):
    """The nodes and edges of the file with the most edges."""
    n, e = _nodes(spark, folder), _edges(spark, folder)
    f = e.where(F.col("file_id").isNotNull()).groupBy("file_id").count().orderBy(F.desc("count"), "file_id").first()[0]
    nodes, edges = graph.file_graph(n, e, f)
    return nodes.select(F.lit("node").alias("what"), "id").unionByName(edges.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")))


def graph_expanded(spark, folder):
    """The subgraph two steps around the smallest file node that has edges, by the index's interface."""
    s = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    with s:
        s.nodes.upsert(_nodes(spark, folder))
        s.edges.upsert(_edges(spark, folder))
    index = api.Index(spark, s.folder)
    seed = index.store.edges.read().where("weight > 0").join(index.store.nodes.read().where("node_type = 'File'").select(F.col("id").alias("from_id")), "from_id").agg(F.min("from_id")).first()[0]
    nodes, edges = index.expand(seed or "", 1)
    info = index.graph_info(nodes.agg(F.min("file_id")).first()[0] or "")
    total = spark.createDataFrame([("nodes of file", str(info["nodes"])), ("edges of file", str(info["edges"]))], "what string, id string")
    return nodes.select(F.lit("node").alias("what"), "id").unionByName(edges.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id"))).unionByName(total)


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    """The first file node of every extension's files."""
    n = _nodes(spark, folder).where(F.col("node_type") == "File").select(F.col("ref_id").alias("file_id"), "id")
    f = table(spark, folder, "file_meta").select("file_id", F.lower("extension").alias("e")).distinct()
    return n.join(f, "file_id").groupBy("e").agg(F.min("id").alias("seed")).select("seed").distinct()


def graph_reach(spark, folder):
    r = graph.reach(_seeds(spark, folder), _nodes(spark, folder), _edges(spark, folder), 3)
    return r.select("seed", "id", "depth", "edge_id")


def graph_forward(spark, folder):
    r = graph.reach(_seeds(spark, folder), _nodes(spark, folder), _edges(spark, folder), 2, "forward")
    return r.select("seed", "id", "depth")


def graph_path(spark, folder):
    """A shortest path from the seed that sorts first to the last of the nodes furthest from it within three steps, edge by edge."""
    n, e = _nodes(spark, folder), _edges(spark, folder)
    seed = _seeds(spark, folder).agg(F.min("seed").alias("seed"))
    far = graph.reach(seed, n, e, 3).orderBy(F.desc("depth"), F.desc("id")).first()
    path = graph.find_path(far.seed, far.id, n, e) if far else None
    return spark.createDataFrame([(i, x) for i, x in enumerate(path or [])], "step long, edge_id string")


def graph_expand_results(spark, folder):
    """The candidates of the queries by vector score, each query's best one, with the chunks that they reach."""
    r = table(spark, folder, "ranked_chunks").where(F.col("vector_score").isNotNull() & ~F.isnan("vector_score"))
    hits = r.groupBy("chunk_id").agg(F.max(F.col("vector_score").cast("double")).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(20)
    out = graph.expand_results(hits, _nodes(spark, folder), _edges(spark, folder), 2)
    return out.select("chunk_id", F.round("score", 6).alias("score"))


def graph_type_counts(spark, folder):
    return graph.type_counts(_nodes(spark, folder))


def graph_stats(spark, folder):
    n, e = _nodes(spark, folder).agg(F.count("*").alias("nodes")), _edges(spark, folder).agg(F.count("*").alias("edges"))
    return n.crossJoin(F.broadcast(e))  # single rows


def graph_by_file(spark, folder):
    """Nodes of every file by type, and its edges by relation."""
    n = _nodes(spark, folder).groupBy("file_id", F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(_edges(spark, folder).groupBy("file_id", F.col("relation").alias("kind")).agg(F.count("*").alias("n")))


QUERIES = {f.__name__: f for f in (graph_entities_of_texts, graph_of_file, graph_expanded, graph_nodes_built, graph_edges_built, graph_references, graph_reference_edges, graph_repeated_words, graph_capitalised, graph_mentions, graph_neighbours, graph_reach, graph_forward, graph_path, graph_expand_results, graph_type_counts, graph_stats, graph_by_file)}

_S = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CHUNK = "chunk AS (SELECT DISTINCT ON (chunk_id) chunk_id, file_id, heading, content FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id, created_at DESC NULLS LAST)"
_OWN = f"WITH {_CHUNK}, own AS (SELECT * FROM chunk WHERE file_id IS NOT NULL)"
_NODE = "node AS (SELECT DISTINCT ON (id) * FROM graph_nodes WHERE id IS NOT NULL ORDER BY id, created_at DESC NULLS LAST, node_type DESC NULLS LAST, ref_id DESC NULLS LAST, label DESC NULLS LAST, file_id DESC NULLS LAST)"
_EDGE = "edge AS (SELECT DISTINCT ON (edge_id) * FROM graph_edges WHERE edge_id IS NOT NULL ORDER BY edge_id, created_at DESC NULLS LAST, from_id DESC NULLS LAST, to_id DESC NULLS LAST, relation DESC NULLS LAST, weight DESC NULLS LAST)"
_ARCS = "arc AS (SELECT from_id AS src, to_id AS dst, edge_id FROM edge WHERE weight > 0 AND from_id IS NOT NULL AND to_id IS NOT NULL %s), step AS (SELECT src, dst, min(edge_id) AS edge_id FROM arc WHERE dst IN (SELECT id FROM node) GROUP BY ALL)"
_BOTH = _ARCS % "UNION ALL SELECT to_id, from_id, edge_id FROM edge WHERE weight > 0 AND from_id IS NOT NULL AND to_id IS NOT NULL"
_SEED = "seed AS (SELECT DISTINCT seed FROM (SELECT lower(f.extension) AS e, min(n.id) AS seed FROM node n JOIN file_meta f ON f.file_id = n.ref_id WHERE node_type = 'File' GROUP BY ALL))"
_PATTERNS = [p.replace("(?iu)", "(?i)").replace("'", "''") for p in graph.REFERENCE_PATTERNS]
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT chunk_id, file_id, {i} AS pattern, trim(unnest(regexp_extract_all(content, '{p}', 1))) AS matched FROM own" for i, p in enumerate(_PATTERNS)) + "), hit AS (SELECT * FROM found WHERE matched <> '')"
_STRUCT = """snode AS (
  SELECT DISTINCT 'file:' || file_id AS id, 'File' AS node_type, file_id AS ref_id, NULL AS label, file_id FROM own
  UNION ALL SELECT 'chunk:' || chunk_id, 'Chunk', chunk_id, substr(content, 1, 40), file_id FROM own
  UNION ALL SELECT DISTINCT 'heading:' || file_id || ':' || substr(sha256(heading), 1, 16), 'Heading', heading, heading, file_id FROM own WHERE heading IS NOT NULL)"""
_WORDS = rf"""word AS (SELECT file_id, word, count(*) AS chunks FROM (
  SELECT DISTINCT file_id, chunk_id, lower(regexp_replace(unnest(regexp_split_to_array(content, '{_S}')), '[^\p{{L}}]', '', 'g')) AS word FROM own WHERE content IS NOT NULL) WHERE strlen(word) > 3 GROUP BY ALL HAVING count(*) >= 3)"""
_RUNS = rf"""token AS (SELECT chunk_id, file_id, pos, w, strlen(w) > 1 AND regexp_matches(w, '^\p{{Lu}}') AS cap FROM (
  SELECT chunk_id, file_id, unnest(range(len(l))) AS pos, regexp_replace(unnest(l), '[^\p{{L}}\p{{N}}-]', '', 'g') AS w FROM (SELECT chunk_id, file_id, regexp_split_to_array(content, '{_S}') AS l FROM %s)) WHERE w <> ''),
island AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) - row_number() OVER (PARTITION BY chunk_id, cap ORDER BY pos) AS g FROM token),
run AS (SELECT chunk_id, file_id, string_agg(w, ' ' ORDER BY pos) AS run FROM island WHERE cap GROUP BY chunk_id, file_id, g HAVING count(*) >= 3)"""
_REACH = """d0 AS (SELECT seed, seed AS id, NULL::VARCHAR AS edge_id FROM seed WHERE seed IN (SELECT id FROM node)),
d1 AS (SELECT seed, dst AS id, min(step.edge_id) AS edge_id FROM d0 JOIN step ON src = id WHERE (seed, dst) NOT IN (SELECT (seed, id) FROM d0) GROUP BY ALL),
d2 AS (SELECT seed, dst AS id, min(step.edge_id) AS edge_id FROM d1 JOIN step ON src = id WHERE (seed, dst) NOT IN (SELECT (seed, id) FROM d0 UNION ALL SELECT (seed, id) FROM d1) GROUP BY ALL)"""
ORACLE = {
    "graph_entities_of_texts": rf"""WITH {_CHUNK}, {_RUNS % 'chunk'},
w AS (SELECT chunk_id, unnest(list_transform(regexp_split_to_array(content, '{_S}+'), lambda w: lower(regexp_replace(w, '[^\p{{L}}]', '', 'g')))) AS word FROM chunk WHERE content IS NOT NULL)
SELECT chunk_id, word AS name FROM w WHERE strlen(word) > 3 GROUP BY ALL HAVING count(*) >= 2 UNION SELECT chunk_id, lower(run) FROM run""",
    "graph_of_file": f"""WITH {_NODE}, {_EDGE}, hot AS (SELECT file_id FROM edge WHERE file_id IS NOT NULL GROUP BY file_id ORDER BY count(*) DESC, file_id LIMIT 1)
SELECT 'node' AS what, id FROM node WHERE file_id = (FROM hot) UNION ALL SELECT 'edge', edge_id FROM edge WHERE file_id = (FROM hot)""",
    "graph_expanded": f"""WITH {_NODE}, {_EDGE}, {_BOTH}, s AS (SELECT min(from_id) AS seed FROM edge WHERE weight > 0 AND from_id IN (SELECT id FROM node WHERE node_type = 'File')),
near AS (SELECT dst, edge_id FROM step WHERE src = (FROM s)), n AS (SELECT id, file_id FROM node WHERE id = (FROM s) OR id IN (SELECT dst FROM near)), f AS (SELECT min(file_id) AS f FROM n)
SELECT 'node' AS what, id FROM n UNION ALL SELECT DISTINCT 'edge', edge_id FROM near
UNION ALL SELECT 'nodes of file', count(*)::VARCHAR FROM node WHERE file_id = (FROM f) UNION ALL SELECT 'edges of file', count(*)::VARCHAR FROM edge WHERE file_id = (FROM f)""",
    "graph_nodes_built": f"{_OWN}, {_STRUCT} SELECT id, node_type, ref_id, file_id FROM snode",
    "graph_edges_built": f"""{_OWN} SELECT a || '_' || b || '_' || r AS edge_id, a AS from_id, b AS to_id, r AS relation, 1.0::DOUBLE AS weight, file_id FROM (
  SELECT 'file:' || file_id AS a, 'chunk:' || chunk_id AS b, 'Contains' AS r, file_id FROM own UNION ALL SELECT 'chunk:' || chunk_id, 'file:' || file_id, 'BelongsTo', file_id FROM own
  UNION ALL SELECT 'chunk:' || chunk_id, 'heading:' || file_id || ':' || substr(sha256(heading), 1, 16), 'BelongsTo', file_id FROM own WHERE heading IS NOT NULL)""",
    "graph_references": f"{_OWN}, {_FOUND} SELECT chunk_id, pattern::INT AS pattern, matched, count(*) AS n FROM hit GROUP BY ALL",
    "graph_reference_edges": f"""{_OWN}, {_FOUND}, {_STRUCT},
name AS (SELECT file_id, id, CASE node_type WHEN 'File' THEN 0 WHEN 'Chunk' THEN 1 ELSE 2 END AS rank, lower(id || ' ' || coalesce(label, '') || ' ' || ref_id) AS text FROM snode),
best AS (SELECT h.file_id, matched, arg_min(id, (rank, id)) AS target FROM (SELECT DISTINCT file_id, matched FROM hit) h JOIN name n ON n.file_id = h.file_id AND contains(text, lower(matched)) GROUP BY ALL)
SELECT DISTINCT 'chunk:' || chunk_id AS from_id, coalesce(target, 'unknown:' || h.matched) AS to_id, 'References' AS relation, 'matched: ' || h.matched AS metadata FROM hit h LEFT JOIN best b ON b.file_id = h.file_id AND b.matched = h.matched""",
    "graph_repeated_words": f"{_OWN}, {_WORDS} SELECT file_id, word, chunks FROM word",
    "graph_capitalised": f"WITH {_CHUNK}, {_RUNS % 'chunk'} SELECT chunk_id, run, count(*) AS n FROM run GROUP BY ALL",
    "graph_mentions": f"""{_OWN}, {_WORDS}, {_RUNS % 'own'}, name AS (SELECT file_id, word AS name FROM word UNION SELECT file_id, lower(run) FROM run)
SELECT own.file_id, count(*) AS mentions FROM own JOIN name ON name.file_id = own.file_id AND contains(lower(content), name) GROUP BY ALL""",
    "graph_neighbours": f"WITH {_NODE}, {_EDGE}, {_BOTH} SELECT src AS id, dst AS neighbour, edge_id FROM step",
    "graph_reach": f"""WITH {_NODE}, {_EDGE}, {_BOTH}, {_SEED}, {_REACH},
d3 AS (SELECT seed, dst AS id, min(step.edge_id) AS edge_id FROM d2 JOIN step ON src = id WHERE (seed, dst) NOT IN (SELECT (seed, id) FROM d0 UNION ALL SELECT (seed, id) FROM d1 UNION ALL SELECT (seed, id) FROM d2) GROUP BY ALL)
SELECT seed, id, 0 AS depth, edge_id FROM d0 UNION ALL SELECT seed, id, 1, edge_id FROM d1 UNION ALL SELECT seed, id, 2, edge_id FROM d2 UNION ALL SELECT seed, id, 3, edge_id FROM d3""",
    "graph_forward": f"WITH {_NODE}, {_EDGE}, {_ARCS % ''}, {_SEED}, {_REACH} SELECT seed, id, 0 AS depth FROM d0 UNION ALL SELECT seed, id, 1 FROM d1 UNION ALL SELECT seed, id, 2 FROM d2",
    "graph_path": f"""
WITH {_NODE}, {_EDGE}, {_BOTH}, {_SEED}, s0 AS (SELECT min(seed) AS id FROM seed), hop AS (SELECT * FROM arc WHERE dst IN (SELECT id FROM node)),
a1 AS (SELECT dst AS id, min({{'edge_id': edge_id, 'src': src}}) AS m FROM hop WHERE src = (SELECT id FROM s0) AND dst <> src GROUP BY dst),
a2 AS (SELECT dst AS id, min({{'edge_id': edge_id, 'src': src}}) AS m FROM hop WHERE src IN (SELECT id FROM a1) AND dst NOT IN (SELECT id FROM s0 UNION ALL SELECT id FROM a1) GROUP BY dst),
a3 AS (SELECT dst AS id, min({{'edge_id': edge_id, 'src': src}}) AS m FROM hop WHERE src IN (SELECT id FROM a2) AND dst NOT IN (SELECT id FROM s0 UNION ALL SELECT id FROM a1 UNION ALL SELECT id FROM a2) GROUP BY dst),
far AS (SELECT * FROM (SELECT 3 AS d, id, m FROM a3 UNION ALL SELECT 2, id, m FROM a2 UNION ALL SELECT 1, id, m FROM a1) ORDER BY d DESC, id DESC LIMIT 1),
q3 AS (SELECT m FROM far WHERE d = 3), q2 AS (SELECT m FROM a2 WHERE id = (SELECT m.src FROM q3) UNION ALL SELECT m FROM far WHERE d = 2), q1 AS (SELECT m FROM a1 WHERE id = (SELECT m.src FROM q2) UNION ALL SELECT m FROM far WHERE d = 1)
SELECT 0::BIGINT AS step, m.edge_id AS edge_id FROM q1 UNION ALL SELECT 1, m.edge_id FROM q2 UNION ALL SELECT 2, m.edge_id FROM q3""",
    "graph_expand_results": f"""
WITH {_NODE}, {_EDGE}, {_BOTH},
hit AS (SELECT chunk_id, max(vector_score::DOUBLE) AS score FROM ranked_chunks WHERE vector_score IS NOT NULL AND NOT isnan(vector_score) GROUP BY ALL ORDER BY score DESC, chunk_id LIMIT 20),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM hit), seed AS (SELECT 'chunk:' || chunk_id AS seed FROM hit), {_REACH},
met AS (SELECT ref_id AS chunk_id, min(r) AS r FROM (SELECT seed, id FROM d1 UNION ALL SELECT seed, id FROM d2) d JOIN node USING (id) JOIN ranked ON seed = 'chunk:' || chunk_id WHERE node_type = 'Chunk' GROUP BY ALL)
SELECT chunk_id, round(score, 6) AS score FROM hit UNION ALL SELECT m.chunk_id, round(0.7 * score + 0.15, 6) FROM met m JOIN ranked USING (r) WHERE m.chunk_id NOT IN (SELECT chunk_id FROM hit)""",
    "graph_type_counts": f"WITH {_NODE} SELECT t AS node_type, count(id) AS n FROM (SELECT unnest(['File', 'Chunk', 'Heading', 'Entity', 'Folder']) AS t) LEFT JOIN node ON node_type = t GROUP BY ALL",
    "graph_stats": "SELECT (SELECT count(DISTINCT id) FROM graph_nodes) AS nodes, (SELECT count(DISTINCT edge_id) FROM graph_edges) AS edges",
    "graph_by_file": f"WITH {_NODE}, {_EDGE} SELECT file_id, node_type AS kind, count(*) AS n FROM node GROUP BY ALL UNION ALL SELECT file_id, relation, count(*) FROM edge GROUP BY ALL",
}
