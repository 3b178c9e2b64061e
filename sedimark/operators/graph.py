"""The knowledge graph: building it from chunks, walking it, and searching with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimark.errors import GraphError, InvalidDepth
from sedimark.operators.containment import containing
from sedimark.operators.skew import hot_keys, join_spread
from sedimark.storage_paths import written

# Node and relation names, weights, and the patterns of references.
NODE_TYPES = ["File", "Chunk", "Heading", "Entity", "Folder"]
RELATIONS = ["Contains", "References", "Mentions", "BelongsTo", "DerivedFrom", "SimilarTo", "CrossReference"]
REFERENCE_PATTERNS = [
    "(?iu)see\\s+['“]?([A-Z][A-Za-z0-9 ]{2,50})",
    "(?iu)refer\\s+to\\s+['“]?([A-Z][A-Za-z0-9 ]{2,50})",
    "(?iu)as\\s+per\\s+['“]?([A-Z][A-Za-z0-9 ]{2,50})",
    "(?iu)per\\s+['“]?([A-Z][A-Za-z0-9 ]{2,50})",
    "['“]([A-Z][A-Za-z0-9 ]{3,60})['”]",
]
WEIGHTS = {"Contains": 1.0, "BelongsTo": 1.0, "References": 0.7, "Mentions": 0.5}

MAX_DEPTH, MAX_HOPS = 5, 10


def _digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def heading_id(file_id: Column, text: Column) -> Column:
    return F.concat(F.lit("heading:"), file_id, F.lit(":"), _digest(text))


def entity_id(file_id: Column, name: Column) -> Column:
    return F.concat(F.lit("entity:"), _digest(F.concat(file_id, name)))


def edge(from_id: Column, to_id: Column, relation: str, file_id: Column, metadata: Column | None = None) -> list[Column]:
    return [
        F.concat(from_id, F.lit("_"), to_id, F.lit(f"_{relation}")).alias("edge_id"), from_id.alias("from_id"), to_id.alias("to_id"), F.lit(relation).alias("relation"),
        F.lit(WEIGHTS[relation]).alias("weight"), (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"), file_id.alias("file_id"),
    ]


def _usable(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("chunk_id").isNotNull() & F.col("file_id").isNotNull())


def structural_nodes(chunks: DataFrame) -> DataFrame:
    """(id, node_type, ref_id, label, file_id): files, chunks and distinct headings of a file, each once."""
    c = _usable(chunks)
    files = c.select(F.concat(F.lit("file:"), "file_id").alias("id"), F.lit("File").alias("node_type"), F.col("file_id").alias("ref_id"), F.lit(None).cast("string").alias("label"), "file_id").distinct()
    own = c.groupBy("chunk_id", "file_id").agg(F.min(F.substring("content", 1, 40)).alias("label"))
    parts = own.select(F.concat(F.lit("chunk:"), "chunk_id").alias("id"), F.lit("Chunk").alias("node_type"), F.col("chunk_id").alias("ref_id"), "label", "file_id")
    heads = c.where(F.col("heading").isNotNull()).select("file_id", "heading").distinct()
    named = heads.select(heading_id(F.col("file_id"), F.col("heading")).alias("id"), F.lit("Heading").alias("node_type"), F.col("heading").alias("ref_id"), F.col("heading").alias("label"), "file_id")
    return files.unionByName(parts).unionByName(named)


def structural_edges(chunks: DataFrame) -> DataFrame:
    """Contains from file to chunk, BelongsTo back, and BelongsTo from a chunk to its heading; each once."""
    c = _usable(chunks).select("chunk_id", "file_id", "heading").distinct()
    file_node, chunk_node = F.concat(F.lit("file:"), "file_id"), F.concat(F.lit("chunk:"), "chunk_id")
    pairs = c.select("chunk_id", "file_id").distinct()
    down = pairs.select(*edge(file_node, chunk_node, "Contains", F.col("file_id")))
    up = pairs.select(*edge(chunk_node, file_node, "BelongsTo", F.col("file_id")))
    heads = c.where(F.col("heading").isNotNull()).select(*edge(chunk_node, heading_id(F.col("file_id"), F.col("heading")), "BelongsTo", F.col("file_id")))
    return down.unionByName(up).unionByName(heads)


def reference_matches(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, matched): what each pattern captures, trimmed; a text that two patterns capture comes out twice."""

    def named(number: int):
        return lambda x: F.struct(F.lit(number).alias("pattern"), F.trim(x).alias("matched"))

    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), named(i)) for i, p in enumerate(REFERENCE_PATTERNS)]))
    return _usable(chunks).where(F.col("content").isNotNull()).select("chunk_id", "file_id", F.explode(found).alias("m")).select("chunk_id", "file_id", "m.pattern", "m.matched").where(F.col("matched") != "")


def reference_edges(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """References edges to the first node of the chunk's file that names the match, else to ``unknown:``.

    Each distinct match of a file is looked for in the texts of its nodes, all matches in one pass
    over a text. The first is the one with the smallest (type, id).
    """
    found = reference_matches(chunks)
    order = F.when(F.col("node_type") == "File", 0).when(F.col("node_type") == "Chunk", 1).when(F.col("node_type") == "Heading", 2).otherwise(3)
    names = nodes.select(F.col("file_id").alias("grp"), "id", order.alias("rank"), F.lower(F.concat_ws(" ", "id", F.coalesce("label", F.lit("")), "ref_id")).alias("text"))
    texts = found.select("file_id", "matched", F.lower("matched").alias("needle")).distinct()
    met = containing(names, texts.select(F.col("file_id").alias("grp"), "needle"))
    firsts = met.join(names.select("grp", "id", "rank"), ["grp", "id"]).groupBy(F.col("grp").alias("file_id"), "needle").agg(F.min_by("id", F.struct("rank", "id")).alias("target"))
    hits = texts.join(firsts, ["file_id", "needle"]).select("file_id", "matched", "target")
    met = found.join(hits, ["file_id", "matched"], "left")
    target = F.coalesce("target", F.concat(F.lit("unknown:"), "matched"))
    return met.select(*edge(F.concat(F.lit("chunk:"), "chunk_id"), target, "References", F.col("file_id"), F.concat(F.lit("matched: "), "matched")))


def capitalised_runs(text: Column, least: int = 3) -> Column:
    """Array of runs of at least ``least`` capitalised words; signs other than letters, digits and hyphens are left out of words, and words without any other are skipped."""
    cleaned = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}-]", "")), lambda w: w != "")
    cap = lambda w: w.rlike(r"^\p{Lu}") & (F.octet_length(w) > 1)
    # words joined by a blank, other words as a line break between runs
    line = F.array_join(F.transform(cleaned, lambda w: F.when(cap(w), F.concat(w, F.lit(" "))).otherwise(F.lit("\n"))), "")
    runs = F.transform(F.split(line, "\n+"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: F.size(F.split(r, " ")) >= least)


def repeated_words(chunks: DataFrame, least: int = 3) -> DataFrame:
    """(file_id, word, chunks): lower-case words of more than three bytes in at least ``least`` chunks of a file."""
    words = F.array_distinct(F.transform(F.split("content", r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))))
    each = _usable(chunks).where(F.col("content").isNotNull()).select("file_id", "chunk_id", F.explode(F.filter(words, lambda w: F.octet_length(w) > 3)).alias("word"))
    return each.groupBy("file_id", "word").agg(F.count("*").alias("chunks")).where(F.col("chunks") >= least)


def entities_of_text(text: Column, least: int = 3) -> Column:
    """The entities of one text: its capitalised runs, and its words of more than three bytes that occur at least ``least`` times in it; lower case, sorted, each once. Null has none."""
    words = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))), lambda w: F.octet_length(w) > 3)
    often = F.filter(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)) >= least)
    return F.array_sort(F.array_union(often, F.transform(capitalised_runs(text), lambda r: F.lower(r))))


def entities(chunks: DataFrame, least: int = 3) -> DataFrame:
    """(file_id, name): repeated words and capitalised runs in lower case, each once a file."""
    runs = _usable(chunks).select("file_id", F.explode(capitalised_runs(F.col("content"))).alias("r")).select("file_id", F.lower("r").alias("name"))
    return repeated_words(chunks, least).select("file_id", F.col("word").alias("name")).unionByName(runs).distinct()


def entity_nodes(names: DataFrame) -> DataFrame:
    return names.select(entity_id(F.col("file_id"), F.col("name")).alias("id"), F.lit("Entity").alias("node_type"), F.col("name").alias("ref_id"), F.col("name").alias("label"), "file_id")


def mention_edges(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions edges from each chunk to the entities of its file whose name its lower-case text contains, also within words."""
    c = _usable(chunks).select(F.col("file_id").alias("grp"), F.col("chunk_id").alias("id"), F.lower("content").alias("text"))
    met = containing(c, names.select(F.col("file_id").alias("grp"), F.col("name").alias("needle")))
    return met.select(*edge(F.concat(F.lit("chunk:"), "id"), entity_id(F.col("grp"), F.col("needle")), "Mentions", F.col("grp")))


def build(chunks: DataFrame, references: bool = True, with_entities: bool = True, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the chunks' graph, each id once."""
    nodes, edges = structural_nodes(chunks), structural_edges(chunks)
    if references:
        edges = edges.unionByName(reference_edges(chunks, nodes))
    if with_entities:
        names = entities(chunks, least)
        nodes, edges = nodes.unionByName(entity_nodes(names)), edges.unionByName(mention_edges(chunks, names))
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["edge_id"])


def latest(rows: DataFrame, key: str, order: str = "created_at") -> DataFrame:
    """Upserts taken together: of each key the row with the greatest ``order``, null lowest; ties by the whole row."""
    rest = [c for c in rows.columns if c != key]
    first = F.max(F.struct(F.coalesce(F.col(order), F.lit(-(2**63))).alias("_at"), *rest)).alias("m")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


# --- walking -----------------------------------------------------------------------------------


def arcs(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(src, dst, edge_id, weight): the steps that ``direction`` allows; edges of no or negative weight allow none."""
    e = edges.where((F.col("weight") > 0) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    ahead = e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_id", "weight")
    back = e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "edge_id", "weight")
    match direction.lower():
        case "forward":
            return ahead
        case "backward":
            return back
        case "both":
            return ahead.unionByName(back)
    raise GraphError(f"no such direction: {direction}")


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(id, neighbour, edge_id): each neighbour that exists once, by its smallest edge."""
    a = arcs(edges, direction).groupBy(F.col("src").alias("id"), F.col("dst").alias("neighbour")).agg(F.min("edge_id").alias("edge_id"))
    return a.join(nodes.select(F.col("id").alias("neighbour")).distinct(), "neighbour", "left_semi").select("id", "neighbour", "edge_id")


def reach(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(seed, id, depth, edge_id): breadth first from each ``seed`` (column ``seed``), the seeds themselves at depth 0.

    Each step joins only the newest nodes with the arcs and drops those already reached; its result
    is written to the shared folder, so a step's plan doesn't hold those before it.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise InvalidDepth(f"depth must be 1 to {MAX_DEPTH}")
    there = written(nodes.select("id").where(F.col("id").isNotNull()).distinct(), "there")
    front = written(seeds.select("seed", F.col("seed").alias("id")).distinct().join(there, "id", "left_semi").select("seed", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_id")), "reach")
    known = front
    # steps to nodes that exist, each once
    steps = arcs(edges, direction).groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    steps = written(steps.join(there.withColumnRenamed("id", "dst"), "dst", "left_semi"), "steps")
    hubs = hot_keys(steps, "src")
    for d in range(1, depth + 1):
        met = join_spread(front.select("seed", F.col("id").alias("src")), steps, "src", "dst", hubs).groupBy("seed", F.col("dst").alias("id")).agg(F.min("edge_id").alias("edge_id"))
        new = met.join(known.select("seed", "id"), ["seed", "id"], "left_anti")
        front = written(new.select("seed", "id", F.lit(d).alias("depth"), "edge_id"), "reach")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def expand(seed: str, nodes: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """The subgraph around a node: its nodes, and the edges by which neighbours of those within ``depth`` were seen."""
    spark = nodes.sparkSession
    found = reach(spark.createDataFrame([(seed,)], "seed string"), nodes, edges, depth, direction)
    inner = found.where(F.col("depth") < depth).select("id")
    seen = neighbours(edges, nodes, direction).join(inner, "id", "left_semi").select("edge_id").distinct()
    return nodes.join(found.select("id"), "id", "left_semi"), edges.join(seen, "edge_id", "left_semi")


def find_path(start: str, goal: str, nodes: DataFrame, edges: DataFrame, hops: int = MAX_HOPS, direction: str = "both") -> list[str] | None:
    """The edge ids of a shortest path; [] from a node to itself, None if there is none within ``hops``. Of equal ones the smallest edges."""
    if nodes.where(F.col("id").isin(start, goal)).select("id").distinct().count() < len({start, goal}):
        return None
    if start == goal:
        return []
    spark = nodes.sparkSession
    there = nodes.select("id").distinct()
    steps = arcs(edges, direction)
    levels = [spark.createDataFrame([(start, None, None)], "id string, src string, edge_id string")]
    known = levels[0].select("id")
    for _ in range(hops):
        best = F.min(F.struct("edge_id", "src")).alias("m")
        met = levels[-1].select(F.col("id").alias("src")).join(steps, "src").groupBy(F.col("dst").alias("id")).agg(best).select("id", "m.src", "m.edge_id")
        level = written(met.join(known, "id", "left_anti").join(there, "id", "left_semi"), "path")
        levels.append(level)
        known = known.unionByName(level.select("id"))
        if (hit := level.where(F.col("id") == goal).first()) is not None:
            path = [hit.edge_id]
            for before in levels[-2:0:-1]:
                hit = before.where(F.col("id") == hit.src).first()
                path.append(hit.edge_id)
            return path[::-1]
        if level.isEmpty():
            return None
    return None


def expand_results(hits: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1, normalise: bool = False) -> DataFrame:
    """``hits`` (chunk_id, score, ...) and the chunks that they reach, at 0.7 times the score plus 0.15.

    A chunk that several hits reach is credited to the best of them. With ``normalise`` scores are
    first divided by the greatest. Hits without a node, or a depth out of range, add nothing.
    """
    if not 1 <= depth <= MAX_DEPTH:
        return hits
    few = written(hits, "hits")
    if normalise:
        top = few.agg(F.max("score")).first()[0]
        few = few.withColumn("score", F.col("score") / F.lit(top)) if top else few
    ranked = few.withColumn("_rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.asc("chunk_id"))))
    found = reach(ranked.select(F.concat(F.lit("chunk:"), "chunk_id").alias("seed")), nodes, edges, depth)
    chunk_of = nodes.where(F.col("node_type") == "Chunk").select("id", F.col("ref_id").alias("new_id")).distinct()
    by = found.where(F.col("depth") > 0).join(chunk_of, "id").join(ranked.select(F.concat(F.lit("chunk:"), "chunk_id").alias("seed"), "_rank"), "seed").groupBy("new_id").agg(F.min("_rank").alias("_rank"))
    fresh = by.join(few.select(F.col("chunk_id").alias("new_id")), "new_id", "left_anti").join(ranked, "_rank")
    rest = [c for c in few.columns if c not in ("chunk_id", "score")]
    added = fresh.select(F.col("new_id").alias("chunk_id"), (0.7 * F.col("score") + 0.15).alias("score"), *rest)
    return few.select("chunk_id", "score", *rest).unionByName(added)


def file_graph(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("file_id") == file_id), edges.where(F.col("file_id") == file_id)


def type_counts(nodes: DataFrame) -> DataFrame:
    """(node_type, n) for each of the known types, also those without nodes."""
    kinds = nodes.sparkSession.createDataFrame([(k,) for k in NODE_TYPES], "node_type string")
    return F.broadcast(kinds).join(nodes.groupBy("node_type").agg(F.count("*").alias("n")), "node_type", "left").select("node_type", F.coalesce("n", F.lit(0)).alias("n"))
