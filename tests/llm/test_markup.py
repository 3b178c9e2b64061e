import random

import pytest

from sedimark.llm.markup import clean, convert, host_of, match_trees, parse_html, text_of

FENCE = "```python\ndef f(x):\n    # not a heading\n    - not an item\n```"

MARKED = [
    ("# Title\n\ntext", ["heading"]), ("Title\n=====\n\ntext", ["heading"]), ("== Wiki ==\nx [[Link]]", ["heading"]), ("\\section{A}\ntext", ["heading"]), ("<h2 id='s'>\nA\n</h2>", ["heading"]),
    ("- a\n- b", ["list"]), ("1. a\n2. b", ["list"]), ("* '''a'''\n** b", ["list"]), ("# [[A]] one\n# two", ["list"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["list"]), ("<ul><li>a<li>b</ul>", ["list"]),
    (FENCE, ["code"]), ("~~~\n# x\n~~~", ["code"]), ("<pre class='s'><code>def f():\n  # a\n  if x &lt; 1</code></pre>", ["code"]), ("\\begin{verbatim}\n\\section{no}\n\\end{verbatim}", ["code"]), ("<syntaxhighlight lang='py'>\n# x\n</syntaxhighlight>", ["code"]), ("```\nnever closed", ["code"]),
    ("$$\nx^2\n$$", ["formula"]), ("Here $r_{5} = \\sqrt{x}$ holds.", ["formula"]), ("a \\[q\\] b", ["formula"]), ("\\begin{equation}\nx\n\\end{equation}", ["formula"]), ("<math>x</math>", ["formula"]), ("<p>We set $$u_{1}$$ below.</p>", ["formula"]),
    ("| a | b |\n|---|:--:|\n| 1 | 2 |", ["table"]), ('{| class="w"\n! A !! B\n|-\n| 1 || 2\n|}', ["table"]), ("\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}", ["table"]), ("<table><tr><td>1</td></tr></table>", ["table"]),
    ("<p>plain</p>", ["other"]), ("one <b>two</b>", ["other"]), ("a</p> b", ["other"]), ("a &nbsp; b", ["other"]), ("a **b** c", ["other"]), ("a [b](/c) d", ["other"]), ("a `b` c", ["other"]), ("![a](b.png)", ["other"]), ("{{note|x}}", ["other"]), ("a\\footnote{b}", ["other"]),
    ("text\n<!-- == A == -->", ["other"]), ("text\n\n% \\section{A}", ["other"]), ("<script>var a = '<h1>';</script> x", ["other"]), ("<p>a</p><style>h1 { }</style>", ["other"]),
    ("a [[b]] c\n\n<pre>\n# x\n</pre>\n\n{| class=w\n! A !! B\n|}", ["code", "table"]),
    ("<h1>A</h1><ul><li>x</ul><pre>y</pre><table><tr><td>z</table>$$q$$", ["heading", "list", "code", "formula", "table"]),
]
PLAIN = ["", "   ", "a < 5 and b > 3", "cost $5 and $10 each", "The path C:\\section\\new_4 was empty.", "4 * 3 = 12 & called it R&D", "<no reply> a -> b", "field last_indexed_at or x_file_id, see [683].", 'at 5 > 4 it was "done" (= 189 ?)', "Ticket #12", "a\tb\nc\td", "the short- and long-term view"]


@pytest.mark.parametrize("text,kinds", MARKED)
def test_kinds(text, kinds):
    assert convert(text)[1] == kinds


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert convert(text) == (text, [])


def test_clean_text_keeps_structure():
    text, _ = convert("# T\n\nSome **bold** [link](/x).\n\n- a\n- `b`\n\n" + FENCE + "\n\n$$\nx^2\n$$\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<!-- gone -->end")
    assert text == "# T\n\nSome bold link.\n\n- a\n- b\n\n```\ndef f(x):\n    # not a heading\n    - not an item\n```\n\n$$x^2$$\n\n| a | b |\n| 1 | 2 |\n\nend"
    text, _ = convert("<html><head><title>t</title></head><body><h1>A</h1><p>x &mdash; <b>y</b></p><ul><li>1<li>2</ul><pre>a &lt; b</pre><table><tr><th>H</th></tr><tr><td>v</td></tr></table></body>")
    assert text == "# A\n\nx \u2014 y\n\n- 1\n- 2\n\n```\na < b\n```\n\n| H |\n| v |"
    assert convert(None) == (None, [])


def test_long_and_broken_texts():
    assert convert("<p>" * 3000 + "x")[1] == ["other"]
    assert convert("$" * 20_000)[0] is not None
    assert convert("<" * 5000 + "[" * 5000 + "'" * 5000 + "{" * 5000)[0] is not None
    assert convert("word " * 200_000 + "**b**")[1] == ["other"]


def test_no_depth_is_too_deep():
    text, kinds = convert("<div>" * 1500 + "<h2>Deep</h2><ul><li>item</li></ul><pre>x = 1</pre>end")
    assert kinds == ["heading", "list", "code"] and text.startswith("## Deep\n\n- item") and text.endswith("end")
    assert convert("<p>" + "<b>" * 3000 + "x")[0] == "x"


def test_simple_tree_matching():
    a, b = parse_html("<div><p>1</p><b>2</b><p>3</p></div>"), parse_html("<div><b>2</b><p>x</p></div>")
    size, pairs = match_trees(a, b)
    assert size == len(pairs) == 6
    assert match_trees(parse_html("<a>x</a>"), parse_html("<b>x</b>"))[0] == 1


def test_long_lists_and_deep_trees_are_matched_exactly():
    def flat(*first):
        return "<div>" + "".join([*first, *(f"<p>{i}</p> <b>{i}<i>{i}</i></b> " if i % 3 else f"<h3>{i}</h3> " for i in range(300)), "<nav><a>Imprint</a></nav>"]) + "</div>"

    a, b = flat("<table><tr><td>new</td></tr></table>"), flat()
    size, pairs = match_trees(parse_html(a), parse_html(b))
    assert size == len(pairs) and {y.number for _, y in pairs} == set(range(len(pairs)))
    assert all(text_of(x) == text_of(y) for x, y in pairs if x.tag in ("p", "b", "i", "h3", "nav"))
    deep = match_trees(parse_html("<div>" * 3000 + "<b>x</b>"), parse_html("<div>" * 3000 + "<i>y</i>"))
    assert deep[0] == len(deep[1]) == 3001


KIND = "file_id string, path string, content string, text string, kinds string"


def page(i, extra=""):
    return f"<html><body><div><a>Home</a> <a>About us</a></div>{extra}<h1>Title {i}</h1><p>Content number {i}.</p><div>Imprint and terms</div></body></html>"


def test_template_is_induced(spark):
    rows = [(f"f{i}", "/site/a/x.html", page(i, "<p>extra</p>" if i % 2 else ""), None, None) for i in range(8)]
    rows += [("g", "/site/b/x.html", page(1), None, None), ("n", "/site/a/y.html", None, None, None), ("t", "/site/a/z.html", "just text", None, None), ("f0", "/site/a/x.html", page(0), None, None)]
    df = spark.createDataFrame(rows, KIND)
    got = {r.id: (r.text, r.kinds) for r in clean(df, "file_id", "content", host_of("path")).collect()}
    assert got["f0"] == ("# Title 0\n\nContent number 0.", ["heading"])
    assert got["f1"][0].endswith("# Title 1\n\nContent number 1.")
    assert "About us" in got["g"][0]  # the only page of its host
    assert got["n"] == (None, []) and got["t"] == ("just text", [])
    assert clean(df, "file_id", "content", host_of("path")).count() == 11
    assert clean(df.limit(0), "file_id", "content", host_of("path")).count() == 0


def test_rows_without_html_are_no_pages(spark):
    rows = [(f"f{i}", "/site/a/x.html", page(i), None, None) for i in range(6)]
    rows += [(f"a{i}", "/site/a/x.txt", f"# Notes {i}", None, None) for i in range(6)]  # the smallest ids, and half of the rows
    got = {r.id: r.text for r in clean(spark.createDataFrame(rows, KIND), "file_id", "content", host_of("path")).collect()}
    assert got == {f"f{i}": f"# Title {i}\n\nContent number {i}." for i in range(6)} | {f"a{i}": f"# Notes {i}" for i in range(6)}


def test_host(spark):
    got = spark.createDataFrame([("/v/a/2024/x",), ("https://h.org/a/b",), ("x",), (None,)], "p string").select(host_of("p")).collect()
    assert [r[0] for r in got] == ["/v/a", "h.org", "", None]


def test_clean_text_of_pages_gives_back_what_was_planted(spark):
    """Pages of one host: the same menu and foot, headings, items, tables, code and paragraphs that differ."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("bdgklmnrst") + r.choice("aeiou") for _ in range(3))
    line = lambda n: " ".join(word() for _ in range(n))
    menu = "".join(f"<li><a href='/{i}'>{m}</a></li>" for i, m in enumerate(("Home", "News", "About us")))
    rows, want = [], {}
    for i in range(12):
        head, items, para, cells, code = line(3), [line(2) for _ in range(r.randint(2, 5))], [line(9) for _ in range(r.randint(1, 4))], [[word(), word()] for _ in range(r.randint(1, 3))], f"x = {i}\ny = {word()}"
        body = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in para) + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul><table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in cells) + f"</table><pre>{code}</pre>"
        rows.append((f"p{i}", f"/site/host/{i}.html", f"<html><body><div><ul>{menu}</ul></div><div>{body}</div><div><p>All rights reserved.</p></div></body></html>"))
        want[f"p{i}"] = "\n\n".join([f"# {head}", *para, "\n".join(f"- {x}" for x in items), "\n".join(f"| {a} | {b} |" for a, b in cells), f"```\n{code}\n```"])
    pages = spark.createDataFrame(rows, "file_id string, path string, content string")
    got = {x.id: (x.text, x.kinds) for x in clean(pages, "file_id", "content", host_of("path")).collect()}
    assert {k: t for k, (t, _) in got.items()} == want
    assert all(k == ["heading", "list", "code", "table"] for _, k in got.values())
    # without a host nothing is taken for template
    alone = {x.id: x.text for x in clean(pages, "file_id", "content").collect()}
    assert all(t.startswith("- Home\n- News") and t.endswith("All rights reserved.") for t in alone.values())
