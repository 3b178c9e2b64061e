import pytest
from pyspark.sql import functions as F

from sedimark.errors import GraphError, InvalidDepth
from sedimark.operators import graph as G
from sedimark.operators.containment import containing

CHUNK = "chunk_id string, file_id string, heading string, content string"
NODE = "id string, node_type string, ref_id string, label string, file_id string"
EDGE = "edge_id string, from_id string, to_id string, relation string, weight double, metadata string, file_id string"


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("file:f1", "File", "f1", None, "f1"), *[(f"chunk:c{i}", "Chunk", f"c{i}", None, "f1") for i in (1, 2, 3)], ("heading:h1", "Heading", "h1", "h1", "f1")]
    pairs = [("file:f1", "chunk:c1", "Contains", 1.0), ("file:f1", "chunk:c2", "Contains", 1.0), ("file:f1", "chunk:c3", "Contains", 1.0), ("chunk:c1", "heading:h1", "BelongsTo", 1.0), ("chunk:c2", "heading:h1", "BelongsTo", 1.0), ("chunk:c1", "chunk:c2", "References", 0.7)]
    edges = [(f"{a}_{b}_{r}", a, b, r, w, None, "f1") for a, b, r, w in pairs]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_one_chunk_with_heading(spark):
    c = spark.createDataFrame([("c1", "f1", "Head", "some text"), ("c1", "f1", "Head", "some text"), (None, "f1", None, "x"), ("c9", None, None, "x")], CHUNK)
    nodes, edges = G.build(c)
    assert sorted(r.node_type for r in nodes.collect()) == ["Chunk", "File", "Heading"]
    assert sorted((r.relation, r.weight) for r in edges.collect()) == [("BelongsTo", 1.0), ("BelongsTo", 1.0), ("Contains", 1.0)]


def test_references(spark):
    c = spark.createDataFrame([("c1", "f1", None, "See Document X for details. Refer to 'Annex B'. as per Rule 7, foresee no harm"), ("c2", "f1", "Document X for details", "plain"), ("c3", "f1", None, None)], CHUNK)
    got = {(r.pattern, r.matched) for r in G.reference_matches(c).collect()}
    assert {(0, "Document X for details"), (1, "Annex B"), (2, "Rule 7"), (3, "Rule 7"), (0, "no harm")} <= got
    to = {r.metadata: r.to_id for r in G.reference_edges(c, G.structural_nodes(c)).collect()}
    assert to["matched: Document X for details"] == "chunk:c1" and to["matched: Rule 7"] == "unknown:Rule 7"


RUNS = [("Ask The Human Resources Department now", ["The Human Resources Department"]), ("New York is big", []), ("A Big Red Fox", []), ("Alpha Beta, Gamma! delta Echo Foxtrot-X Golf9", ["Alpha Beta Gamma", "Echo Foxtrot-X Golf9"]), ("Alpha -- Beta ... Gamma", []), ("Ärger Öfen Über", ["Ärger Öfen Über"]), ("", []), (None, [])]


def brute_runs(text):
    out, run = [], []
    for w in (text or "").split():
        w = "".join(ch for ch in w if ch.isalnum() or ch == "-")
        if not w:
            continue
        if w[0].isupper() and len(w.encode()) > 1:
            run.append(w)
        else:
            out += [" ".join(run)] if len(run) >= 3 else []
            run = []
    return out + ([" ".join(run)] if len(run) >= 3 else [])


@pytest.mark.parametrize("text", [t for t, _ in RUNS])
def test_capitalised_runs(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(G.capitalised_runs(F.col("t"))).first()[0] == brute_runs(text)


def test_entities_and_mentions(spark):
    c = spark.createDataFrame([("c1", "f", None, "budget budget The Big Red Fox"), ("c2", "f", None, "Budget, category cat"), ("c3", "f", None, "the budgets"), ("c4", "g", None, "budget"), ("c5", "f", None, "(budget)")], CHUNK)
    assert {(r.file_id, r.word, r.chunks) for r in G.repeated_words(c, 3).collect()} == {("f", "budget", 3)}
    names = G.entities(c, 3)
    assert {(r.file_id, r["name"]) for r in names.collect()} == {("f", "budget"), ("f", "the big red fox")}
    assert sorted(r.from_id for r in G.mention_edges(c, names).collect()) == ["chunk:c1", "chunk:c1", "chunk:c2", "chunk:c3", "chunk:c5"]
    assert {r.label for r in G.entity_nodes(names).collect()} == {"budget", "the big red fox"}


def test_expand(small):
    nodes, edges = G.expand("file:f1", *small, 1)
    assert nodes.count() == 4 and edges.count() == 3
    nodes, edges = G.expand("file:f1", *small, 2)
    assert nodes.count() == 5 and edges.count() == 6
    assert {r.id for r in G.expand("heading:h1", *small, 5, "forward")[0].collect()} == {"heading:h1"}
    assert {r.id for r in G.expand("heading:h1", *small, 1, "backward")[0].collect()} == {"heading:h1", "chunk:c1", "chunk:c2"}
    assert G.expand("gone", *small, 2)[0].count() == 0
    for d in (0, 6):
        with pytest.raises(InvalidDepth):
            G.expand("file:f1", *small, d)
    with pytest.raises(GraphError):
        G.expand("file:f1", *small, 1, "sideways")


def test_deeper_holds_shallower(small, spark):
    seeds = spark.createDataFrame([("file:f1",), ("chunk:c3",), ("gone",)], "seed string")
    sets = [{(r.seed, r.id, r.depth) for r in G.reach(seeds, *small, d).collect()} for d in (1, 2, 3)]
    assert sets[0] <= sets[1] <= sets[2] and ("chunk:c3", "heading:h1", 3) in sets[2]


def test_cycle_and_weights(spark):
    nodes = spark.createDataFrame([(x, "Chunk", x, None, "f") for x in "abc"], NODE)
    edges = spark.createDataFrame([("1", "a", "b", "References", 1.0, None, "f"), ("2", "b", "c", "References", 1.0, None, "f"), ("3", "c", "a", "References", 1.0, None, "f"), ("4", "a", "zz", "References", 1.0, None, "f"), ("5", "a", None, "References", 1.0, None, "f")], EDGE)
    assert G.expand("a", nodes, edges, 3)[0].count() == 3
    cut = edges.withColumn("weight", F.when(F.col("edge_id") == "1", 0.0).otherwise(1.0))
    assert {r.id: r.depth for r in G.reach(spark.createDataFrame([("a",)], "seed string"), nodes, cut, 2).collect()} == {"a": 0, "c": 1, "b": 2}


def test_paths(small):
    assert G.find_path("file:f1", "heading:h1", *small) == ["file:f1_chunk:c1_Contains", "chunk:c1_heading:h1_BelongsTo"]
    assert G.find_path("file:f1", "file:f1", *small) == []
    assert G.find_path("file:f1", "gone", *small) is None
    assert G.find_path("heading:h1", "file:f1", *small, direction="forward") is None
    assert G.find_path("chunk:c3", "heading:h1", *small, hops=1) is None


def test_expanded_results(small, spark):
    hits = spark.createDataFrame([("c1", 0.8, 0.5), ("c9", 0.9, 0.4)], "chunk_id string, score double, vector_score double")
    got = {r.chunk_id: (round(r.score, 6), r.vector_score) for r in G.expand_results(hits, *small, 1).collect()}
    assert got == {"c1": (0.8, 0.5), "c9": (0.9, 0.4), "c2": (0.71, 0.5)}
    assert G.expand_results(hits, *small, 0).count() == 2
    scaled = {r.chunk_id: round(r.score, 6) for r in G.expand_results(hits, *small, 1, normalise=True).collect()}
    assert scaled["c9"] == 1.0


def test_neighbours_and_counts(small, spark):
    n = {(r.id, r.neighbour): r.edge_id for r in G.neighbours(small[1], small[0]).collect()}
    assert n["chunk:c2", "chunk:c1"] == "chunk:c1_chunk:c2_References" and len(n) == 12
    assert {r.node_type: r.n for r in G.type_counts(small[0]).collect()} == {"File": 1, "Chunk": 3, "Heading": 1, "Entity": 0, "Folder": 0}
    a, b = G.file_graph(*small, "f1")
    assert a.count() == 5 and b.count() == 6
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, 1, "n")], "id string, created_at long, v string")
    assert [(r.id, r.v) for r in G.latest(rows, "id").collect()] == [("a", "y")]


def test_containment_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr("sedimark.operators.containment.TEXTS", 7)
    monkeypatch.setattr("sedimark.operators.containment.NEEDLES", 2)
    texts = [("g", str(i), f"text {i} ab{'c' * (i % 3)}") for i in range(50)] + [("h", "x", "abc"), ("h", "y", None), (None, "z", "abc")]
    needles = [("g", "abc"), ("g", "abcc"), ("g", "zz"), ("h", "b"), ("h", ""), ("h", None), ("i", "a"), ("g", "abc")]
    got = {tuple(r) for r in containing(spark.createDataFrame(texts, "grp string, id string, text string"), spark.createDataFrame(needles, "grp string, needle string")).collect()}
    assert got == {(g, i, n) for g, i, t in texts for h, n in needles if g == h and g and t and n and n in t}
