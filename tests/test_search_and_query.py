import math

import pytest
from pyspark.sql import functions as F

from sedimark.errors import InvalidQuery
from sedimark.functions import vectors as V
from sedimark.operators import query as Q
from sedimark.operators import search as S
from sedimark.operators.embedding import HashingEmbedder

KIND = "chunk_id string, file_id string, heading string, content string, block_type string, created_at long, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    e = HashingEmbedder(256)
    texts = ["the court heard the case", "a case of fresh pastry", "the oven and the pastry dough", "court and tribunal of appeal", "", None]
    rows = [(f"c{i}", f"f{i % 2}", "H" if i % 3 else None, t, "Text", i * 1000, e(t) if t else [0.0] * 256) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.96) and got[1:] == [None, None, None]
    assert df.select(V.unit(F.col("a"))).collect()[0][0] == pytest.approx([0.6, 0.8])
    assert df.select(V.unit(F.col("a"))).collect()[1][0] == [0.0, 0.0]


def test_vector_search(chunks):
    e = HashingEmbedder(256)
    got = S.vector_search(chunks, e("court case"), 2).select("chunk_id").collect()
    assert got[0][0] == "c0"
    assert S.vector_search(chunks, e("court"), 3, S.SearchFilter(file_id="f1")).where("file_id <> 'f1'").count() == 0
    many = S.batch_vector_search(chunks, {"x": e("court case"), "y": e("pastry")}, 2).collect()
    assert [(r.query_id, r.rank) for r in many if r.chunk_id == "c0"][0] == ("x", 1)
    assert len(many) == 4
    with pytest.raises(InvalidQuery):
        S.vector_search(chunks, [1.0], 0)


def test_filters(chunks):
    keep = lambda **k: {r[0] for r in S.SearchFilter(**k).apply(chunks).select("chunk_id").collect()}
    assert keep() == {f"c{i}" for i in range(6)}
    assert keep(heading_prefix="H", file_id="f1") == {"c1", "c5"}
    assert keep(created_after=1000, created_before=4000) == {"c2", "c3"}


def test_bm25_by_hand(chunks):
    got = {r.chunk_id: r.fts_score for r in S.fts_search(chunks, "Court case").collect()}
    assert set(got) == {"c0"}
    docs = [["the", "court", "heard", "the", "case"], ["a", "case", "of", "fresh", "pastry"], ["the", "oven", "and", "the", "pastry", "dough"], ["court", "and", "tribunal", "of", "appeal"], [], []]
    mean = sum(map(len, docs)) / 6
    idf = math.log(1 + (6 - 2 + 0.5) / 2.5)
    assert got["c0"] == pytest.approx(2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / mean)))
    assert {r.chunk_id for r in S.fts_search(chunks, "court pastry", any_term=True).collect()} == {"c0", "c1", "c2", "c3"}
    with pytest.raises(InvalidQuery):
        S.fts_search(chunks, " ?! ")
    assert S.fts_search(chunks.limit(0), "court").count() == 0


def test_rrf_numbers(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7)], "chunk_id string, vector_score double")
    f = spark.createDataFrame([("b", 0.95), ("d", 0.85)], "chunk_id string, fts_score double")
    got = S.fuse_rrf({"vector_score": v, "fts_score": f}).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("b", 0.032522), ("a", 0.016393), ("d", 0.016129), ("c", 0.015873)]
    assert got[0].vector_score == 0.8 and got[0].fts_score == 0.95 and got[1].fts_score is None
    assert len(S.fuse_rrf({"vector_score": v, "fts_score": f}, 2).collect()) == 2
    back = S.fuse_rrf({"fts_score": f, "vector_score": v}).collect()
    assert [(r.chunk_id, r.score) for r in back] == [(r.chunk_id, r.score) for r in got]


def test_grouped_rrf_is_the_same(spark):
    rows = [("q", "a", 0.9, None), ("q", "b", 0.8, 0.95), ("q", "c", 0.7, float("nan")), ("q", "d", None, 0.85), ("r", "a", None, None), ("q", None, 1.0, 1.0)]
    got = S.fuse_rrf_by(spark.createDataFrame(rows, "q string, k string, v double, f double"), "q", "k", ["v", "f"]).orderBy("q", "place").collect()
    assert [(r.k, round(r.score, 6)) for r in got] == [("b", 0.032522), ("a", 0.016393), ("d", 0.016129), ("c", 0.015873), ("a", 0.0)]


def test_modes(spark):
    cases = {("hello", 0): "Vector", ("hello world", 0): "Vector", ("how does this work", 0): "Hybrid", ("x", 2): "Expand", ("things Related To y", 0): "Expand", ("reference", 0): "Expand", ("", 0): "Hybrid", ("  ", 0): "Hybrid"}
    for (t, d), want in cases.items():
        assert Q.select_mode(t, d) == want
    got = spark.createDataFrame([(t, d, w) for (t, d), w in cases.items()], "t string, d int, w string").withColumn("g", Q.mode_column(F.col("t"), F.col("d")))
    assert got.where("g <> w").count() == 0
    assert [s.name for s in Q.build_plan(Q.Query("a related to b"))] == ["vector", "fts", "fuse", "expand", "rerank", "rerank"]


def test_rerank(spark):
    df = spark.createDataFrame([("a", "f", "H", 1.0), ("b", "f", "H", 1.0), ("c", "g", None, 1.0), ("d", "f", None, 1.0)], "chunk_id string, file_id string, heading string, score double")
    got = {r.chunk_id: r.score for r in Q.rerank_by_file(Q.rerank_by_heading(df)).collect()}
    assert got == {k: pytest.approx(v) for k, v in {"a": 1 / 1.15 / 1.2, "b": 1 / 1.15 / 1.2, "c": 1 / 1.15, "d": 1 / 1.15 / 1.2}.items()}


def test_context(spark):
    rows = [(f"k{i}", "f", "H" if i != 3 else None, "x" * 8) for i in range(6)] + [("n1", "f", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, file_id string, heading string, content string")
    anchors = spark.createDataFrame([("k2",), ("k0",), ("k3",), ("gone",)], "chunk_id string")
    got = {}
    for r in Q.context_windows(df, anchors, 3).collect():
        got.setdefault(r.anchor_id, set()).add((r.chunk_id, r.distance, r.tokens))
    assert got == {"k2": {("k1", -1, 2), ("k2", 0, 2), ("k4", 1, 2)}, "k0": {("k0", 0, 2), ("k1", 1, 2)}, "k3": {("k3", 0, 2), ("n1", 1, 0)}}


def test_engine(chunks, spark):
    nodes = spark.createDataFrame([(f"chunk:c{i}", "Chunk", f"c{i}", "f") for i in range(5)], "id string, node_type string, ref_id string, file_id string")
    edges = spark.createDataFrame([("e1", "chunk:c0", "chunk:c2", 1.0), ("e2", "chunk:c2", "chunk:c4", 1.0)], "edge_id string, from_id string, to_id string, weight double")
    engine = Q.QueryEngine(chunks, HashingEmbedder(256), nodes, edges)
    best = engine.results(Q.Query("court case")).first()
    assert best.chunk_id == "c0" and engine.cache.misses == 1
    engine.results(Q.Query("court case"))
    assert engine.cache.hits == 1
    some = {r.chunk_id for r in engine.results(Q.Query("court heard case", top_k=1)).collect()}
    more = {r.chunk_id for r in engine.results(Q.Query("court heard case", top_k=1, depth=1)).collect()}
    assert some == {"c0"} and more == {"c0", "c2"}
    assert {r.file_id for r in engine.results(Q.Query("court", where=S.SearchFilter(file_id="f1"))).collect()} <= {"f1"}
    assert engine.windows(Q.Query("court case", top_k=1)).count() >= 1
    assert "c0" in Q.preview(list(engine.stream(Q.Query("court case", top_k=1))))
    for bad in (Q.Query(" "), Q.Query("x", mode="None")):
        with pytest.raises(InvalidQuery):
            engine.results(bad)


def test_cache_forgets():
    c = Q.QueryCache(1, 60)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") is None and c.get("b") == 2
    none = Q.QueryCache(0)
    none.put("a", 1)
    assert none.get("a") is None
    old = Q.QueryCache(5, -1)
    old.put("a", 1)
    assert old.get("a") is None
