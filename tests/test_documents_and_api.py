import pytest
from tests.test_sources import DOCX, PPTX, pdf, xlsx

from sedimark import api
from sedimark.errors import DocumentError, InvalidQuery, InvalidSelector, UnsupportedFormat
from sedimark.sources.documents import _cell_name


@pytest.fixture(scope="module")
def docs(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    html = "<h1>Top</h1><p>one apple</p><p>two</p><h2>Sub</h2><p>three</p><table><tr><th>H</th></tr><tr><td>v</td></tr></table><img alt='Photo'>"
    files = {"a.txt": b"line1\nApple\nline3\n", "a.md": b"# A\n\nfirst\n\n## B\nsecond apple\n# C\nlast", "a.html": html.encode(), "a.docx": DOCX, "a.pptx": PPTX, "a.xlsx": xlsx(), "a.pdf": pdf(), "bad.docx": b"x", "a.xyz": b"apple"}
    for n, data in files.items():
        (d / n).write_bytes(data)
    return d


def doc(docs, ext):
    return api.open_doc(str(docs / f"a.{ext}"))


READS = [
    ("txt", "paragraph", 1, ["Apple"]), ("txt", "range", "0-5", ["line1"]), ("txt", "slice", (1, 9), ["Apple", "line3"]), ("md", "heading", "b", ["## B\nsecond apple"]), ("md", "paragraph", 1, ["second apple"]),
    ("html", "heading", "Top", ["one apple\ntwo"]), ("html", "heading", "Sub", ["three"]), ("html", "table", 0, [[["H"], ["v"]]]), ("html", "image", 0, [("Photo", None)]), ("html", "slice", "0,1", ["one apple"]),
    ("docx", "heading", "top", ["one two\nnext page"]), ("docx", "paragraph", 1, ["one two"]), ("docx", "table", 0, [[["H"], ["v"]]]), ("pptx", "slide", 10, ["Ten body text"]), ("pptx", "note", 2, ["Two body text"]), ("pptx", "image", 0, [("image1.png", b"png")]),
    ("xlsx", "cell", "C1", ["1.5"]), ("xlsx", "cell", "ZZ99", [""]), ("xlsx", "sheet", "SECOND", [[]]), ("pdf", "page", 2, ["second (page)"]), ("pdf", "pages", [2, 7, 1], ["second (page)\n\nINTRO\nHello World"]), ("pdf", "heading", "intro", ["INTRO\nHello World"]), ("pdf", "range", "0-5", ["INTRO"]),
]


@pytest.mark.parametrize("ext,kind,value,want", READS)
def test_reads(docs, ext, kind, value, want):
    assert doc(docs, ext).read(kind, value) == want


@pytest.mark.parametrize("ext,kind,value", [("txt", "slide", 1), ("txt", "heading", "x"), ("md", "heading", "none"), ("md", "table", 0), ("pdf", "page", 9), ("txt", "slice", (3, 1)), ("txt", "range", "4-2"), ("txt", "range", "0-999"), ("html", "image", 5), ("docx", "page", 1), ("xlsx", "range", "0-1"), ("md", "row", 1)])
def test_errors(docs, ext, kind, value):
    with pytest.raises(InvalidSelector):
        doc(docs, ext).read(kind, value)


def test_opening(docs):
    with pytest.raises(UnsupportedFormat):
        doc(docs, "xyz")
    with pytest.raises(DocumentError):
        api.open_doc(str(docs / "none.txt"))
    assert [doc(docs, e).page_count() for e in ("pdf", "pptx", "docx", "txt")] == [2, 2, 2, None]
    assert doc(docs, "docx").metadata()["title"] == "My Title"
    assert len(doc(docs, "docx").read()) == 1 and len(doc(docs, "pdf").read()) == 2


def test_outlines(docs):
    assert [(e.level, e.label, e.parent) for e in doc(docs, "md").outline()] == [(1, "A", None), (2, "B", 0), (1, "C", None)]
    assert [(e.level, e.label, e.parent) for e in doc(docs, "html").outline()] == [(1, "Top", None), (2, "Sub", 0)]
    assert [e.label for e in doc(docs, "pptx").outline()] == ["Two", "Slide 10"]
    assert [e.label for e in doc(docs, "xlsx").outline()] == ["First", "Second"]
    assert [(e.label, e.parent) for e in doc(docs, "pdf").outline()] == [("INTRO", None)]


def test_searches(docs):
    assert [(m.place, m.context) for m in doc(docs, "txt").search("APPLE")] == [(1, "line1\nApple\nline3")]
    assert [m.place for m in doc(docs, "xlsx").search("1.5")] == ["C1"] and doc(docs, "xlsx").search("1.5")[0].context == "Sheet: First"
    assert [m.place for m in doc(docs, "pptx").search("two")] == [2]
    assert [m.place for m in doc(docs, "pdf").search("hello")] == [1]
    assert [m.text for m in doc(docs, "html").search("apple")] == ["one apple"]
    with pytest.raises(InvalidSelector):
        doc(docs, "txt").search("")
    assert [_cell_name(0, c) for c in (0, 25, 26, 701, 702)] == ["A1", "Z1", "AA1", "ZZ1", "AAA1"]


def test_chunks(docs):
    assert [c["block_type"] for c in doc(docs, "pptx").chunks()] == ["Slide", "Slide"]
    assert doc(docs, "xlsx").chunks()[-1]["content"] == "[Sheet: Second]"
    assert doc(docs, "pdf").chunks()[0]["page"] is not None


def test_grep(spark, docs):
    got = {r.path.rpartition("/")[2]: r.matches for r in api.grep_docs(spark, str(docs), "apple").collect()}
    assert got == {"a.txt": 1, "a.md": 1, "a.html": 1}
    assert {r.path[-4:] for r in api.grep_docs(spark, str(docs), "1.5").collect()} == {"xlsx"}
    with pytest.raises(InvalidQuery):
        api.grep_docs(spark, str(docs), "")


def test_index(spark, docs, tmp_path):
    x = api.Index(spark, str(tmp_path / "store"))
    r = x.add(str(docs))
    assert r.indexed == 7 and r.failed == 1
    assert x.query("second apple text", any_term=True).count() > 0
    assert len(list(x.stream("apple"))) > 0
    assert x.vector_search("apple", 3).count() == 3
    assert x.vector_searches(["apple", "page"], 2).count() == 4
    s = x.stats()
    assert s["files"] == 8 and s["types"]["File"] == 7 and x.status()["vectors"] == s["chunks"]
    file_id = x.store.files.read().where("path LIKE '%a.md'").first().file_id
    assert x.graph_info(file_id)["types"]["Chunk"] >= 4
    assert x.path(f"file:{file_id}", f"file:{file_id}") == [] and x.expand(f"file:{file_id}")[0].count() > 1
