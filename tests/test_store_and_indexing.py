import json
import time
import urllib.error

import pytest
from pyspark.sql import functions as F

from sedimark import cli, config
from sedimark.errors import DimensionMismatch, DuplicateKey, EmbedError, IndexingError, ReadOnlyError, StorageError
from sedimark.operators import embedding as E
from sedimark.operators import indexing as I
from sedimark.operators import store as ST
from sedimark.streaming import watch


@pytest.fixture
def store(spark, tmp_path):
    return ST.Store(spark, f"file://{tmp_path}/store")


def files(spark, *rows):
    return spark.createDataFrame([(i, p, h, 1, m, "txt", None) for i, p, h, m in rows], ST.SCHEMAS["files"][1])


def test_upserts_and_lookups(spark, store):
    store.files.append(files(spark, ("a", "/a", "1", 1), ("b", "/b", "2", 1)))
    store.files.upsert(files(spark, ("b", "/b", "3", 2), ("c", "/c", "4", 1), ("c", "/c", "4", 1)))
    assert {r.file_id: r.hash for r in store.files.read().collect()} == {"a": "1", "b": "3", "c": "4"}
    assert store.files.get("b").first().hash == "3" and store.files.count() == 3
    with pytest.raises(DuplicateKey):
        store.files.append(files(spark, ("a", "/a", "9", 1)))
    with pytest.raises(DuplicateKey):
        store.files.append(files(spark, ("z", "/z", "9", 1), ("z", "/z", "9", 1)))
    assert store.files.delete(F.col("file_id") == "a") == 1 and store.files.delete(F.col("file_id") == "a") == 0
    assert store.counts() == {"files": 2, "chunks": 0, "nodes": 0, "edges": 0}
    store.files.clear()
    assert store.files.count() == 0
    with pytest.raises(AttributeError):
        store.nothing


def test_parts_are_taken_together(spark, store, monkeypatch):
    monkeypatch.setattr(ST, "MOST_PARTS", 3)
    for n in range(8):
        store.files.upsert(files(spark, ("a", "/a", str(n), n), (f"k{n}", "/k", "1", 1)))
        if n % 2:
            store.files.delete(F.col("file_id") == f"k{n}")
    assert {r.file_id: r.hash for r in store.files.read().collect()} == {"a": "7", "k0": "1", "k2": "1", "k4": "1", "k6": "1"}
    assert len(store.names("files")) <= 4
    store.moves.append(spark.createDataFrame([("a", "x", "y", 1)], ST.SCHEMAS["moves"][1]))
    store.moves.append(spark.createDataFrame([("a", "y", "z", 2)], ST.SCHEMAS["moves"][1]))
    assert store.moves.count() == 2 and store.moves.delete(F.col("timestamp") == 1) == 1 and store.moves.count() == 1


def test_transactions_of_two_writers(spark, store):
    other = ST.Store(spark, store.folder)
    store.files.append(files(spark, ("a", "/a", "1", 1)))
    with pytest.raises(StorageError):
        with store:
            store.files.upsert(files(spark, ("b", "/b", "1", 1)))
            store.moves.append(spark.createDataFrame([("b", "x", "y", 1)], ST.SCHEMAS["moves"][1]))
            other.files.upsert(files(spark, ("c", "/c", "1", 1)))
    assert {r.file_id for r in store.files.read().collect()} == {"a", "c"} and store.moves.count() == 0
    v = store.versions.current()
    with store:
        store.files.upsert(files(spark, ("b", "/b", "1", 1)))
        store.record_move("b", "x", "y", 1)
    assert store.versions.current() == v + 1 and other.moves.count() == 1  # both tables by one manifest


def test_lookups(spark, store):
    store.files.append(files(spark, ("b", "/1", "1", 1), ("a", "/2", "1", 1)))
    assert [r.file_id for r in store.files_in_order().collect()] == ["b", "a"] and store.files.where(path="/2").first().file_id == "a"
    store.edges.append(spark.createDataFrame([("e1", "x", "y", "Contains", 0.0, None, "f", 1), ("e2", "y", "z", "References", 1.0, None, None, 1)], ST.SCHEMAS["edges"][1]))
    assert [r.edge_id for r in store.edges_of("y").collect()] == ["e1", "e2"] and store.edges_of("y", "Forward").first().edge_id == "e2" and store.edges_of("y", "backward").first().edge_id == "e1"
    assert store.edges.where(relation="Contains").count() == 1 and store.edges.where(file_id=None).first().edge_id == "e2"
    store.state.append(spark.createDataFrame([("a", "1", 1, " indexed"), ("b", "1", 1, "Failed"), ("c", "1", 1, None)], ST.SCHEMAS["state"][1]))
    assert [r.file_id for r in store.pending().collect()] == ["b", "c"]
    wanted = spark.createDataFrame([("f",), (None,)], "file_id string")
    assert store.edges.among(wanted).count() == 2
    with pytest.raises(StorageError):
        store.edges_of("y", "up")


def test_transactions(spark, store):
    with store:
        store.files.append(files(spark, ("a", "/a", "1", 1)))
        assert store.files.count() == 1  # seen within
        assert ST.Store(spark, store.folder).files.count() == 0  # not by others
        with store:
            store.files.upsert(files(spark, ("b", "/b", "1", 1)))
    assert ST.Store(spark, store.folder).files.count() == 2
    with pytest.raises(ZeroDivisionError), store:
        store.files.clear()
        raise ZeroDivisionError
    assert store.files.count() == 2
    for f in (store.commit, store.rollback):
        with pytest.raises(StorageError):
            f()


def test_read_only(spark, store):
    guarded = ST.Store(spark, store.folder, read_only=True)
    with pytest.raises(ReadOnlyError):
        guarded.files.append(files(spark, ("a", "/a", "1", 1)))
    with pytest.raises(ReadOnlyError):
        guarded.begin()


def test_needs_update(spark):
    stored = files(spark, ("a", "/a", "1", 1), ("b", "/b", "2", 1), ("c", "/c", "3", 1))
    scanned = spark.createDataFrame([("/a", "1", 1), ("/b", "9", 1), ("/c", "3", 2), ("/d", "4", 1)], "path string, hash string, modified long")
    assert {r.path for r in ST.needs_update(scanned, stored).collect()} == {"/b", "/c", "/d"}


class Failing(E.HashingEmbedder):
    def embed_batch(self, texts):
        if any("bad" in t for t in texts):
            raise EmbedError("no such luck")
        return super().embed_batch(texts)


def test_embedding_runs(spark):
    e = E.HashingEmbedder(8)
    chunks = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one"), ("d", None), ("e", "bad text")], "chunk_id string, content string")
    none = spark.createDataFrame([], "content_hash string, model string, embedding array<float>")
    first = E.index_chunks(chunks, none, e)
    assert tuple(E.index_report(first).first()) == (4, 4, 0, 0)
    again = E.index_chunks(chunks, first, e)
    assert tuple(E.index_report(again).first()) == (4, 0, 4, 0)
    assert tuple(E.index_report(E.index_chunks(chunks, first, e, reindex=True)).first()) == (4, 4, 0, 0)
    other = E.index_chunks(chunks, first, E.HashingEmbedder(8, "else"))
    assert tuple(E.index_report(other).first()) == (4, 4, 0, 0)
    failed = E.index_chunks(chunks, none, Failing(8), batch=1)
    assert tuple(E.index_report(failed).first()) == (4, 3, 0, 1)
    assert {r.chunk_id for r in E.missing(chunks, first, "hashing").collect()} == {"d"}


def test_embedders():
    with pytest.raises(DimensionMismatch):
        E.checked([[1.0]], 1, 2)
    with pytest.raises(EmbedError):
        E.checked([], 1, 2)
    assert E.checked([[3, 4]], 1, 2) == [[0.6, 0.8]] and E.checked([[0, 0]], 1, 2) == [[0, 0]]
    assert E.resolve_dimension("openai", "text-embedding-3-large") == 3072 and E.resolve_dimension("ollama", "x") == 768 and E.resolve_dimension("x", "y", 5, 6) == 5
    with pytest.raises(EmbedError):
        E.create_embedder("nobody", "x")
    assert E.create_embedder("ollama", "nomic-embed-text").dimension == 768
    h = E.HashingEmbedder()
    assert h("a b") == h("b A") and h("a") != h("b")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise EmbedError("busy") from urllib.error.HTTPError("http://x", 429, "", None, None)
        return 7

    assert E.RetryPolicy(first_seconds=0.001).call(flaky) == 7 and len(calls) == 3
    with pytest.raises(EmbedError):
        E.RetryPolicy().call(lambda: (_ for _ in ()).throw(EmbedError("wrong key")))
    assert E.RetryPolicy().delay(20) == 30.0


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("# Alpha\nThe budget of the project. See Beta for details.\n## Beta\nmore budget text\n")
    (d / "b.txt").write_text("plain text about budget and pastry\n")
    (d / "broken.docx").write_text("no zip")
    return d


def test_index(spark, store, tree):
    e = E.HashingEmbedder(16)
    seen = []
    r = I.index(store, str(tree), e, progress=lambda k, n: seen.append(k))
    assert (r.total, r.indexed, r.skipped, r.failed) == (3, 2, 0, 1) and r.chunks == 5 and len(r.errors) == 1 and seen[:2] == ["started", "scanned"]
    n = store.counts()
    assert n["files"] == 3 and n["chunks"] == 5 and n["nodes"] > 5
    r = I.index(store, str(tree), e)
    assert (r.indexed, r.skipped, r.failed) == (0, 2, 1)  # the broken file is due again
    (tree / "b.txt").write_text("changed text\n")
    r = I.index(store, str(tree), e)
    assert (r.indexed, r.skipped) == (1, 1)
    assert {c.content for c in store.chunks.read().collect() if c.content and "text" in c.content} == {"changed text", "more budget text"}
    gone = store.delete_file(store.files.read().where(F.col("path").endswith("a.md")).first().file_id)
    assert gone["chunks"] == 4 and gone["files"] == 1 and store.chunks.count() == 1
    full = I.index(store, str(tree), e, I.IndexConfig("Full"))
    assert full.indexed == 2
    with pytest.raises(IndexingError):
        I.index(store, str(tree), e, I.IndexConfig("Sometimes"))
    assert full.merge(r).total == 6


def test_cli(spark, tree, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    out = []

    def run(*argv):
        out.clear()
        code = cli.run(list(argv), spark, out.append)
        return code, out[:]

    md = str(tree / "a.md")
    assert json.loads(run("outline", md)[1][0]) == [[1, "Alpha"], [2, "Beta"]]
    assert json.loads(run("read", md, "--heading", "beta")[1][0]) == ["## Beta\nmore budget text"]
    assert json.loads(run("read", md, "--paragraph", "1")[1][0]) == ["more budget text"]
    assert json.loads(run("read", md, "--range", "2-7")[1][0]) == ["Alpha"]
    assert json.loads(run("read", md, "--slice", "0,1")[1][0]) == ["# Alpha"]
    assert run("read", md, "--slide", "1")[0] == 1 and run("read", md, "--heading", "none")[0] == 1 and run("info", "gone.md")[0] == 1
    assert len(json.loads(run("search", md, "BUDGET")[1][0])) == 2
    assert len(json.loads(run("chunk", md)[1][0])) == 4
    assert json.loads(run("info", md)[1][0])["format"] == "md"
    h = json.loads(run("hash", md)[1][0])
    assert run("verify", md, h)[0] == 0 and run("verify", md, "0")[0] == 1
    assert len(run("scan", str(tree))[1]) == 3
    assert {json.loads(x)["matches"] for x in run("grep", str(tree), "budget")[1]} == {1, 2}
    assert json.loads(run("index", str(tree))[1][0])["indexed"] == 2
    assert "Alpha" in run("query", "the budget of the project", "--context")[1][0]
    assert run("vector-search", "pastry")[1][0].startswith("1. ")
    assert json.loads(run("graph-stats")[1][0])["types"]["File"] == 2
    node = "file:" + spark.read.parquet(f"{tmp_path}/.sedimark/files/part-*").where("path LIKE '%a.md'").first().file_id
    assert len(json.loads(run("graph-expand", node)[1][0])["nodes"]) >= 1
    assert json.loads(run("graph-path", node, node)[1][0]) == []
    assert json.loads(run("graph-info", node[5:])[1][0])["nodes"] >= 0
    assert json.loads(run("vector-status")[1][0])["vectors"] == 5
    assert "chunking" in run("config")[1][0]


def test_config(tmp_path):
    a, b = tmp_path / "g.json", tmp_path / "l.json"
    a.write_text('{"query": {"top_k": 5, "mode": "Vector"}, "storage": {"path": "${HERE}/x"}}')
    b.write_text('{"query": {"top_k": 7}}')
    c = config.load(str(a), str(b), {"HERE": "/data"})
    assert c.query.top_k == 7 and c.query.mode == "Vector" and c.storage.path == "/data/x"
    assert config.expanded("${NO}", {}) == "${NO}"
    with pytest.raises(ValueError):
        config.merged(config.Config(), {"nothing": {}})
    assert [config.runtime_mode("auto", n) for n in (1, 8, 32)] == ["embedded", "desktop", "server"] and config.runtime_mode("server", 1) == "server"


def test_watch(spark, tmp_path):
    root, seen = tmp_path / "w", []
    root.mkdir()
    (root / "a.txt").write_text("one")
    (root / "x.exe").write_text("no")
    for _ in range(2):
        q = watch.start(watch.watch(spark, str(root)), lambda df, n: seen.append([r.path for r in df.collect()]), f"{tmp_path}/check", once=True)
        q.awaitTermination(60)
        time.sleep(0.01)
        (root / "b.md").write_text("two")
    flat = [p for b in seen for p in b]
    assert [p.rpartition("/")[2] for p in flat] == ["a.txt", "b.md"]


def test_debounce_and_rate(spark):
    rows = [("p", 0.1), ("p", 0.2), ("p", 1.5), ("q", 0.3)]
    e = spark.createDataFrame(rows, "path string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    got = {(r.path, r.events) for r in watch.debounced(e).collect()}
    assert got == {("p", 2), ("p", 1), ("q", 1)}
    rate = sorted((r.path, r.s, r.recent) for r in watch.in_last_minute(e, "path", "ts", 1).collect())
    assert rate == [("p", 0.1, 1), ("p", 0.2, 2), ("p", 1.5, 1), ("q", 0.3, 1)]
