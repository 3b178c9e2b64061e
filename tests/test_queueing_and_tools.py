import io
import json

import pytest

from sedimark import api, cli, tools
from sedimark.errors import IndexingError, InvalidQuery
from sedimark.operators import embedding as E
from sedimark.operators import query
from sedimark.operators.queueing import JobQueue, RateLimiter
from sedimark.operators.search import SearchFilter, TextIndex, fts_search


def test_queue_goes_by_priority_and_is_bounded():
    q = JobQueue(4)
    assert [q.put(j, p) for j, p in (("a", "low"), ("b", "normal"), ("c", "high"), ("d", "high"), ("e", "high"))] == [True, True, True, True, False]
    assert [q.take() for _ in range(5)] == ["c", "d", "b", "a", None]
    with pytest.raises(IndexingError):
        q.put("x", "soon")
    full = JobQueue(1)
    full.put("only")
    assert full.take_under_pressure(lambda: False) == "only"
    full.put("late")
    assert full.take_under_pressure(lambda: True, wait=0.001, seconds=0.01) is None and len(full) == 1
    busy = iter([True, True, False])
    assert full.take_under_pressure(lambda: next(busy), wait=0.001) == "late"


def test_limiter():
    now = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = RateLimiter(2, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        with limit:
            now[0] += 1
    assert slept == [58.0, 58.0] and limit.delay() == 0.0
    with pytest.raises(IndexingError):
        RateLimiter(0)


@pytest.fixture
def docs(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("# Alpha\nThe budget of the project.\n## Beta\nmore budget text\n")
    (d / "b.txt").write_text("plain text about pastry and budget\n")
    return d


def test_tools(spark, docs, tmp_path):
    t = tools.Tools(str(docs), f"{tmp_path}/store", lambda: spark)
    ask = lambda method, key=1, **params: t.answer({"jsonrpc": "2.0", "id": key, "method": method, "params": params})
    listed = ask("tools/list")["result"]["tools"]
    assert len(listed) == 12 and next(x for x in listed if x["name"] == "read")["inputSchema"]["required"] == ["path"]
    call = lambda name, **a: (r := ask("tools/call", name=name, arguments=a)["result"], json.loads(r["content"][0]["text"]) if not r["isError"] else None)
    assert call("read", path="a.md")[1] == ["# Alpha", "The budget of the project.", "## Beta", "more budget text"]
    assert call("read", path="a.md", selector="heading:beta")[1] == ["## Beta\nmore budget text"]
    assert call("read", path="a.md", selector="range:2,7")[1] == ["Alpha"]
    assert call("search", path="b.txt", query="PASTRY")[1][0]["place"] == 0
    assert call("info", path="a.md")[1]["outline"][1] == {"level": 2, "label": "Beta"}
    assert {x["matches"] for x in call("grep", folder=".", query="budget")[1]} == {1, 2}
    assert len(call("scan", folder=".")[1]) == 2 and len(call("chunk", path="a.md")[1]) == 4
    assert call("verify", path="a.md", hash="0")[1] is False
    for bad in (call("read", path="../x"), call("nothing"), call("read"), call("read", path="a.md", selector="what")):
        assert bad[0]["isError"]
    t.index.add(str(docs))
    assert call("query", text="budget")[1] and call("vector_status")[1]["vectors"] == 5 and call("graph_stats")[1]["files"] == 2
    assert "plain text" in ask("resources/read", uri="document://b.txt")["result"]["contents"][0]["text"]
    assert "error" in ask("resources/read", uri="http://x") and ask("nothing")["error"]["code"] == -32601 and t.answer({"method": "x"}) is None
    sink = io.StringIO()
    t.serve(io.StringIO('{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n\nno json\n{"method": "note"}\n'), sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert replies[0] == {"jsonrpc": "2.0", "id": 7, "result": {}} and replies[1]["error"]["code"] == -32700 and len(replies) == 2


def test_set_up(tmp_path):
    out = []
    assert cli.run(["init", str(tmp_path), "--store-path", "s"], out=out.append) == 0 and len(json.loads(out[0])) == 2
    assert json.loads((tmp_path / ".sedimark.json").read_text())["storage"]["path"] == "s" and tools.set_up(str(tmp_path), "t") == []


def test_text_index_finds_what_a_search_of_the_texts_does(spark, tmp_path):
    rows = [("a", "court hearing of the court"), ("b", "hearing"), ("c", None), ("d", ""), ("e", "COURT, hearing!"), ("f", "x " * 5000 + "court")]
    df = spark.createDataFrame(rows, "chunk_id string, content string")
    index = TextIndex.build(df, f"file://{tmp_path}/terms")
    for text, any_term in (("court hearing", False), ("court hearing", True), ("hearing nothing", True)):
        want = [(r.chunk_id, round(r.fts_score, 9)) for r in fts_search(df, text, 10, any_term=any_term).collect()]
        assert [(r.chunk_id, round(r.fts_score, 9)) for r in index.search(text, 10, any_term).collect()] == want and want
    assert index.search("court nothing").count() == 0 and index.search("court", among=df.where("chunk_id = 'a'")).count() == 1
    with pytest.raises(InvalidQuery):
        index.search("!")


def test_vector_search_flags(spark, docs, tmp_path):
    index = api.Index(spark, f"{tmp_path}/store", embedder=E.HashingEmbedder(16))
    seen = []
    index.add(str(docs), progress=lambda k, n: seen.append(k))
    assert seen == ["started", "scanned", "skipped", "parsed", "chunking", "embedded", "graph", "storing", "done"]
    text = index.vector_search("pastry budget", 3, hybrid=True)
    assert "fts_score" in text.columns and text.count() >= 3
    beta = SearchFilter(heading_prefix="Beta")
    assert {r.heading for r in index.vector_search("budget", 3, beta).collect()} == {"Beta"}
    assert {r.heading for r in index.vector_search("budget", 3, beta, expand=2).collect()} == {"Beta"}
    assert index.vector_search("pastry", 1, expand=2).count() >= 1
    found = index.engine().results(query.Query("budget text of beta", depth=2, where=beta))
    assert {r.heading for r in found.collect()} == {"Beta"}
    out = []
    args = ["--store", f"{tmp_path}/store", "vector-search", "budget", "--hybrid", "--heading", "Beta"]
    assert cli.run(args, spark, out.append) == 0 and "Beta" in out[0] and "Alpha" not in out[0]


def test_watched_directory_gives_events(spark, docs):
    assert sorted(e["event_type"] for e in api.watch_directory(spark, str(docs), once=True)) == ["Created", "Created"]
    events = api.watch_directory(spark, str(docs), seconds=0)
    next(events), next(events)
    (docs / "b.txt").rename(docs / "c.txt")
    (docs / "a.md").write_text("changed")
    assert {(e["event_type"], e["path"].rpartition("/")[2]) for e in (next(events), next(events))} == {("Renamed", "c.txt"), ("Modified", "a.md")}
    events.close()
    out = []
    assert cli.run(["watch", str(docs), "--once"], spark, out.append) == 0 and len(out) == 2
