import io
import json

import pytest

from sedimark import observe
from sedimark.errors import ScanError
from sedimark.operators import caching as C
from sedimark.operators.embedding import HashingEmbedder
from sedimark.operators.store import Store
from sedimark.sources import scan
from sedimark.streaming import watch


def test_lru():
    c = C.LruCache(2)
    for k in "abc":
        c.put(k, k.upper())
    assert c.get("a") is None and c.get("b") == "B" and len(c) == 2
    c.put("d", 1)
    assert c.get("c") is None and c.get("b") == "B" and (c.hits, c.misses) == (2, 2)
    c.remove("b")
    assert c.get("b", 5) == 5
    none = C.LruCache(0)
    none.put("a", 1)
    assert len(none) == 0


def test_embedding_cache(spark):
    rows = [("h1", "m", [1.0]), ("h2", "m", [2.0]), ("h1", "n", [3.0])]
    c = C.EmbeddingCache(spark.createDataFrame(rows, C.EmbeddingCache.SCHEMA))
    wanted = spark.createDataFrame([("h1",), ("h9",), ("h1",)], "content_hash string")
    assert [tuple(r) for r in c.get_batch(wanted, "m").collect()] == [("h1", [1.0])]
    d = c.with_vectors(spark.createDataFrame([("h1", "m", [9.0]), ("h9", "m", [8.0])], C.EmbeddingCache.SCHEMA))
    assert {tuple(map(str, r)) for r in d.get_batch(wanted, "m").collect()} == {("h1", "[9.0]"), ("h9", "[8.0]")}
    assert d.get_batch(wanted, "n").count() == 1


def test_graph_cache_and_manager(spark):
    edges = spark.createDataFrame([("e2", "a", "b", 1.0), ("e1", "a", "b", 1.0), ("e3", "c", "a", 1.0), ("e4", "a", "d", 0.0)], "edge_id string, from_id string, to_id string, weight double")
    m = C.CacheManager()
    g = m.graph(edges)
    assert {tuple(r) for r in g.neighbours(["a"]).collect()} == {("a", "b", "e1"), ("a", "c", "e3")}
    assert {tuple(r) for r in g.neighbours(["a"], "forward").collect()} == {("a", "b", "e1")}
    m.queries.put("q", 1)
    m.vectors.put("v", 1)
    m.invalidate()
    assert m.queries.get("q") is None and m.vectors.get("v") is None and not m.graphs
    assert m.stats()["query_misses"] == 1


def test_events_and_metrics():
    out = io.StringIO()
    observe.json_lines(out)("indexed", files=3)
    assert json.loads(out.getvalue())["files"] == 3
    observe.silent("x")
    m = observe.Metrics()
    m.count("hit", 3)
    m.count("miss")
    with m.timed("query"):
        pass
    assert m.rate("hit", "miss") == 0.75 and m.rate("no", "none") == 0.0
    assert m.snapshot()["query"] == 1 and m.snapshot()["query_seconds"] >= 0


def test_within(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("x")
    (tmp_path / "out.md").write_text("x")
    (tmp_path / "in" / "link.md").symlink_to(tmp_path / "in" / "a.md")
    (tmp_path / "in" / "away.md").symlink_to(tmp_path / "out.md")
    root = str(tmp_path / "in")
    assert scan.within(root, "a.md", ("md",)).endswith("a.md") and scan.within(root, "link.md", links=True).endswith("a.md")
    for bad in ("../out.md", "/etc/passwd", "away.md", "link.md"):
        with pytest.raises(ScanError):
            scan.within(root, bad)
    with pytest.raises(ScanError):
        scan.within(root, "a.md", ("txt",))


def test_watched_directory_is_indexed(spark, tmp_path):
    root, reports = tmp_path / "w", []
    root.mkdir()
    (root / "a.txt").write_text("one text")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        watch.index_changes(store, str(root), HashingEmbedder(8), f"file://{tmp_path}/check", done=reports.append, once=True).awaitTermination(90)
        (root / "b.txt").write_text("two text")
    assert [(r.indexed, r.skipped) for r in reports] == [(1, 0), (1, 0)] and store.chunks.count() == 2  # each batch by itself
