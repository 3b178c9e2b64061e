import pytest
from pyspark.sql import functions as F

from sedimark.errors import InvalidSelector
from sedimark.functions import text as T
from sedimark.operators import reading as R
from sedimark.operators.chunking import byte_tokens, count_tokens, detect_heading, last_sentences


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column).first()[0]


TEXTS = ["", "a", "Hello, world! It's fine... (really)", "  x　y\n", "# Head", "### Sub: part", "#no", "a. b! c? d", "日本語。 ok", "one\ntwo\n\nthree.", None]


@pytest.mark.parametrize("t", TEXTS)
def test_columns_agree_with_python(spark, t):
    df = spark.createDataFrame([(t,)], "t string")
    c = F.col("t")
    got = df.select(T.default_tokens(c), T.byte_tokens(c), T.heading_level(c), T.heading_text(c)).first()
    head = detect_heading(t) if t else None
    assert got[0] == count_tokens(t or "") and got[1] == byte_tokens(t or "")
    assert (got[2], got[3]) == (head if head else (None, None))
    if t is not None:
        for n in (0, 1, 2):
            assert df.select(T.last_sentences(c, n)).first()[0] == last_sentences(t, n)


def test_ranges_are_bytes(spark):
    assert one(spark, "Hello World", T.byte_range(F.col("t"), 0, 5)) == "Hello"
    assert one(spark, "ÄÖ", T.byte_range(F.col("t"), 2, 4)) == "Ö"
    for s, e in ((0, 3), (4, 5), (2, 2), (0, 9)):
        assert one(spark, "ÄÖ", T.byte_range(F.col("t"), s, e)) is None


def test_file_columns(spark):
    rows = [("/a/b.PDF", "PDF", True, False), ("/a/.x.md", "md", False, True), ("/node_modules/x.md", "md", False, False), ("/a/target", "", False, False), ("/Build/x.txt", "txt", False, False), ("/a/b.tar.gz", "gz", False, False)]
    from sedimark.sources.scan import include

    got = spark.createDataFrame([r[:1] for r in rows], "p string").select("p", T.extension(F.col("p")), include(F.col("p")), T.is_hidden(F.col("p"))).collect()
    assert [tuple(r) for r in got] == rows
    assert one(spark, "JPG", T.category(F.col("t"))) == "Image" and one(spark, "xyz", T.category(F.col("t"))) == "Unknown"
    assert one(spark, "Html", T.mime_type(F.col("t"))) == "text/html" and one(spark, "zip", T.mime_type(F.col("t"))) == "application/octet-stream"


MD = "# A\n\n## B\n\ntext one\n### C\ntext two\n\n# D\n\n## E\nend"


def test_outline_and_sections(spark):
    df = spark.createDataFrame([(MD,)], "t string")
    got = [tuple(r) for r in df.select(F.inline(R.outline(R.headings(F.col("t"))))).collect()]
    assert got == [(0, 1, "A", None), (1, 2, "B", 0), (2, 3, "C", 1), (3, 1, "D", None), (4, 2, "E", 3)]
    two = [(r[0], r[3]) for r in df.select(F.inline(R.two_level_outline(R.headings(F.col("t"))))).collect()]
    assert two == [(0, None), (1, 0), (2, 0), (3, None), (4, 3)]
    assert one(spark, MD, R.section(F.col("t"), " b ")) == "## B\n\ntext one\n### C\ntext two\n"
    assert one(spark, MD, R.section(F.col("t"), "E")) == "## E\nend"
    assert one(spark, MD, R.section(F.col("t"), "none")) is None
    assert one(spark, MD, R.paragraph(R.paragraphs(F.col("t")), 1)) == "text two"
    assert one(spark, MD, R.paragraph(R.paragraphs(F.col("t")), 9)) is None


def test_slices(spark):
    assert one(spark, "a\nb\r\nc\n", F.array_join(R.part(R.lines(F.col("t")), 1, 5), "|")) == "b|c"
    assert one(spark, "a\nb", R.part(R.lines(F.col("t")), 2, 1)) is None
    with pytest.raises(InvalidSelector):
        R.part(F.col("t"), -1, 2)


def test_search_and_grep(spark):
    docs = spark.createDataFrame([(1, "apple\nbanana\ncherry\nApple pie\nend"), (2, None), (3, ""), (4, "pear")], "id long, text string")
    got = sorted(tuple(r) for r in R.search(docs, "id", "text", "APPLE").collect())
    assert got == [(1, 0, "apple", "apple\nbanana\ncherry", 1.0), (1, 3, "Apple pie", "banana\ncherry\nApple pie\nend", 1.0)]
    assert [tuple(r) for r in R.grep(docs, "id", "text", "apple").collect()] == [(1, 2)]
    with pytest.raises(InvalidSelector):
        R.grep(docs, "id", "text", "")


def test_pages_cells_tables(spark):
    assert one(spark, ["p1", "p2", None], R.pages(F.col("t"), [2, 9, 1, 3]), "array<string>") == "p2\n\np1"
    assert one(spark, ["p1"], R.pages(F.col("t"), [4]), "array<string>") is None
    rows = [["h", "i"], ["a", "b"]]
    assert [one(spark, rows, R.cell(F.col("t"), c), "array<array<string>>") for c in ("A1", "b2", "C9", "AA1")] == ["h", "b", "", ""]
    assert R.cell_position("AA10") == (9, 26) and R.cell_position("Z1") == (0, 25)
    for bad in ("1A", "A0", "", "A"):
        with pytest.raises(InvalidSelector):
            R.cell_position(bad)
    head, rest = R.table_parts(F.col("t"))
    assert one(spark, rows, head, "array<array<string>>") == ["h", "i"] and one(spark, rows, rest, "array<array<string>>") == [["a", "b"]]
    assert one(spark, [], head, "array<array<string>>") == []
    names = spark.createDataFrame([(0, 0), (9, 26), (0, 701)], "r int, c int").select(R.cell_name(F.col("r"), F.col("c"))).collect()
    assert [x[0] for x in names] == ["A1", "AA10", "ZZ1"]


def test_capital_headings(spark):
    text = "INTRO\nSome text\nA LONG TITLE OF FIVE WORDS\nONE TWO THREE FOUR FIVE SIX SEVEN\nAB\n"
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(R.capital_headings(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [(1, "INTRO"), (2, "A LONG TITLE OF FIVE WORDS"), (3, "ONE TWO THREE FOUR FIVE SIX SEVEN")]
