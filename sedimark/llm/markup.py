"""Markup residue in text: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A text becomes a tree: a tolerant HTML parse, or the lines of a light markup grouped into blocks.
Blocks are written out in one notation: ``# `` headings, ``- `` list items, fenced code, ``$$``
formulas, and rows of cells between bars. Pages of one host go through wrapper induction: each
page's tree is aligned with the host's reference page by simple tree matching (the largest order-
preserving mapping between equal tags); nodes of the reference that meet the same text on most of
the host's pages are template, those whose text varies are slots, that is content. A page's tree is
then taken apart into the two: the slots give its text, and each of them its kinds of structure.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.operators.skew import join_unique
from sedimark.storage_paths import written

KINDS = ("heading", "list", "code", "formula", "table")
#: Part of a host's pages that must have a node with the same text for it to be template, and the pages it takes to tell.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 4
#: Pages that one task aligns where there are many.
TASK = 2_000
#: Children that are aligned by plain loops; more are aligned by the same steps on arrays.
PLAIN_CHILDREN = 32

_TAGS = "a abbr article aside b blockquote body br button caption center cite code col colgroup dd del details div dl dt em embed figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav noscript ol option p path picture pre q ref references s samp script section select small source span strike strong style sub summary sup svg syntaxhighlight table tbody td template textarea tfoot th thead title tr tt u ul var video wbr nowiki gallery".split()
_TAG = re.compile(r"</?(?:" + "|".join(_TAGS) + r")(?:\s[^<>]*)?/?>", re.I)
_BLOCK_TAG = re.compile(r"<(?:p|div|h[1-6]|ul|ol|dl|table|pre|html|body|section|article|nav|li|tr|td)(?:\s[^<>]*)?/?>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<\?xml[^>]*>", re.S | re.I)
_HIDDEN = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#x[0-9A-Fa-f]{1,6});")
_MATH_ENV = r"(?:equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign)\*?"
_INLINE_MATH = r"\$(?=[^\s$])(?:[^$\n\\]|\\.)*?[\\^_{](?:[^$\n\\]|\\.)*?(?<=\S)\$(?!\d)"
_CODE_OR_MATH = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<hidden><(?P<h>script|style)\b[^>]*>.*?(?:</(?P=h)\s*>|\Z))"
    r"|(?P<fence>^[ \t]*(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<fbody>.*?)(?:^[ \t]*(?P=f)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><(?P<t>pre|syntaxhighlight|source)\b[^>]*>(?P<pbody>.*?)(?:</(?P=t)\s*>|\Z))"
    r"|(?P<verb>\\begin\{(?P<v>verbatim|lstlisting|minted|Verbatim|alltt)\*?\}(?:\[[^\]\n]*\])?(?P<vbody>.*?)(?:\\end\{(?P=v)\*?\}|\Z))"
    r"|(?P<inline>(?<!`)`[^`\n]+`(?!`))"
    r"|(?P<display>\$\$(?P<d1>.+?)\$\$|\\\[(?P<d2>.+?)\\\]|\\\((?P<d3>.+?)\\\)|\\begin\{(?P<e>" + _MATH_ENV + r")\}(?P<d4>.*?)(?:\\end\{(?P=e)\}|\Z)|<math\b[^>]*>(?P<d5>.*?)(?:</math\s*>|\Z)|(?P<d6>" + _INLINE_MATH + r"))",
    re.S | re.M | re.I,
)
_TEX_COMMAND = re.compile(r"\\(?:begin|end|[a-zA-Z]{2,}\*?)(?:\[[^\]\n]*\])?\{[^{}\n]*\}|^[ \t]*\\item\b", re.M)
_TEX_COMMENT = re.compile(r"^[ \t]*%[ \t]*\\.*$", re.M)
_INLINE = re.compile(
    r"!\[[^\]\n]*\]\([^)\s]*\)|(?<!\!)\[[^\[\]\n]+\]\([^)\s]+\)|\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|'{2,5}[^'\n]+'{2,5}|(?<![\w*])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![\w*])|(?<![\w_])__(?=\S)[^_\n]+?(?<=\S)__(?![\w_])"
    r"|(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])|~~(?=\S)[^~\n]+?(?<=\S)~~|\[(?:https?|ftp)://[^\s\]]+[^\]\n]*\]"
)
_WIKI = re.compile(r"'{2,5}[^'\n]+'{2,5}|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^\{\||^(={2,6})[^=\n].*\1[ \t]*$|<ref\b|<syntaxhighlight\b|<nowiki\b", re.M | re.I)
_MARKDOWN = re.compile(r"\*\*\S|!?\[[^\[\]\n]+\]\([^)\s]+\)|^[ \t]*(?:```|~~~)|^\|?[ \t]*:?-{2,}:?[ \t]*\||^#{2,6} |^[-+] |(?<!`)`[^`\n]+`", re.M)
_MAYBE = re.compile(r"[<&\\`*#=|$~_\[{]|''|^[ \t]*(?:[-+\u2022][ \t]|\d+[.)][ \t])|^-{3,}[ \t]*$", re.M)


class Node:
    __slots__ = ("tag", "text", "children", "number", "template")

    def __init__(self, tag: str, text: str = ""):
        self.tag, self.text, self.children, self.number, self.template = tag, text, [], -1, False


_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr", "source", "embed"}
_ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_OPENS = {"p", "div", "ul", "ol", "table", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "nav", "blockquote", "dl"}
_SCOPE = {"ul", "ol", "dl", "table", "body", "div", "section", "article", "html", "nav"}


class _Builder(HTMLParser):
    """A tree from any text; what isn't closed ends with its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag not in _KNOWN:
            self.handle_data(self.get_starttag_text() or "")
            return
        closes = _ENDS.get(tag, set()) | ({"p"} if tag in _OPENS else set())
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in closes:
                del self.stack[i:]
                break
            if self.stack[i].tag in _SCOPE or self.stack[i].tag not in closes | {"b", "i", "em", "strong", "span", "a", "code", "font", "td", "th", "p", "li"}:
                break
        if tag in ("script", "style"):
            self.hidden += 1
        node = Node(tag, dict(attrs).get("alt") or "" if tag == "img" else "")
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not self.hidden and data:
            self.stack[-1].children.append(Node("#text", data))


_KNOWN = set(_TAGS)


def parse_html(text: str) -> Node:
    b = _Builder()
    b.feed(_COMMENT.sub("", text))
    b.close()
    stack, n = [b.root], 0
    while stack:
        node = stack.pop()
        node.number, n = n, n + 1
        stack.extend(reversed(node.children))
    return b.root


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.template:
            continue
        if n.tag == "br":
            out.append("\n")
        else:
            out.append(n.text)
            stack.extend(reversed(n.children))
    return "".join(out)


def _flat(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


_Block = tuple[str, str]


def html_blocks(node: Node) -> list[_Block]:
    """(kind, text) in the order of the page, without template; kind is one of KINDS, ``text`` or ``hidden``. Nesting may have any depth."""
    out: list[_Block] = []
    stack = [_blocks(node, out)]
    while stack:
        if (inner := next(stack[-1], None)) is None:
            stack.pop()
        else:
            stack.append(_blocks(*inner))
    return out


def _blocks(node: Node, out: list[_Block]) -> Iterator[tuple[Node, list[_Block]]]:
    """Appends the node's blocks to ``out``; yields (child, list) where the child's blocks must be appended to the list before it goes on."""
    run: list[str] = []

    def flush():
        if (t := _flat("".join(run))) or run:
            if t:
                out.extend(_formulas(t))
            run.clear()

    for c in node.children:
        if c.template or c.tag in ("script", "style", "head", "title", "meta", "link", "template", "noscript"):
            flush()
        elif c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            flush()
            out.append(("heading", "#" * int(c.tag[1]) + " " + _flat(text_of(c))))
        elif c.tag in ("pre", "syntaxhighlight", "textarea"):
            flush()
            out.append(("code", "```\n" + text_of(c).strip("\n") + "\n```"))
        elif c.tag == "math":
            flush()
            out.append(("formula", "$$" + _flat(text_of(c)) + "$$"))
        elif c.tag in ("li", "dt", "dd"):
            flush()
            inner: list[_Block] = []
            yield c, inner
            first = [t for k, t in inner if k == "text"]
            out.append(("list", "- " + " ".join(first)))
            out.extend(b for b in inner if b[0] != "text")
        elif c.tag == "tr":
            flush()
            out.append(("table", "| " + " | ".join(_flat(text_of(x)) for x in c.children if x.tag in ("td", "th")) + " |"))
        elif c.tag in ("td", "th"):
            flush()
            out.append(("table", "| " + _flat(text_of(c)) + " |"))
        elif c.tag in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "p", "div", "section", "article", "nav", "header", "footer", "main", "aside", "blockquote", "body", "html", "figure", "form", "details", "summary", "caption", "figcaption", "center"):
            flush()
            before = len(out)
            yield c, out
            if c.tag in ("ul", "ol", "dl", "table") and not any(k in KINDS for k, _ in out[before:]):
                out.append(("table" if c.tag == "table" else "list", _flat(text_of(c))))
        elif c.children and not c.tag.startswith("#") and any(x.tag in _OPENS | {"li", "tr", "td", "math", "pre"} for x in c.children):
            flush()
            yield c, out
        else:
            run.append(text_of(c))
    flush()


def _formulas(text: str) -> list[_Block]:
    """The text, and its formulas as blocks of their own."""
    out, last = [], 0
    for m in _CODE_OR_MATH.finditer(text):
        if m["display"]:
            if t := text[last : m.start()].strip():
                out.append(("text", t))
            out.append(("formula", "$$" + _flat(next(g for g in (m["d1"], m["d2"], m["d3"], m["d4"], m["d5"], m["d6"]) if g is not None).strip("$")) + "$$"))
            last = m.end()
    if t := text[last:].strip():
        out.append(("text", t))
    return out


def _plain(line: str) -> str:
    """A line without inline marks."""
    line = re.sub(r"!\[([^\]\n]*)\]\([^)\s]*\)|\[([^\[\]\n]+)\]\([^)\s]+\)", lambda m: m[1] if m[1] is not None else m[2], line)
    line = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", line)
    line = re.sub(r"\[(?:https?|ftp)://[^\s\]]+\s*([^\]\n]*)\]", r"\1", line)
    line = re.sub(r"\{\{[^{}]*\}\}", "", line)
    line = re.sub(r"'{2,5}([^'\n]+)'{2,5}", r"\1", line)
    line = re.sub(r"(?<![\w*])(\*\*|\*)(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\w*])", r"\2", line)
    line = re.sub(r"(?<![\w_])(__|_)(?=[^\s_])([^_\n]+?)(?<=[^\s_])\1(?![\w_])", r"\2", line)
    line = re.sub(r"~~(?=\S)([^~\n]+?)(?<=\S)~~", r"\1", line)
    line = re.sub(r"<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/>", "", line, flags=re.I)
    line = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", line)
    line = re.sub(r"~?\\(?:footnote|cite|label|ref|pageref|index)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", line)
    line = re.sub(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", line)
    return html.unescape(_TAG.sub("", line)).replace("\u00a0", " ").strip()


_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$")
_TEX_HEAD = re.compile(r"^[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{(.*)\}[ \t]*(?:\\label\{[^}]*\})?[ \t]*$")
_TEX_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_ITEM = re.compile(r"^[ \t]*(?:([-+*\u2022])|(\d{1,3}[.)]))[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
_WIKI_ITEM = re.compile(r"^([*#:;]+)[ \t]*(\S.*)$")
_RULE_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-{1,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)+\|?[ \t]*$")
_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$")


def light_blocks(text: str) -> tuple[list[_Block], bool]:
    """Blocks of a text in a light markup, and whether it has marks at all."""
    held: list[_Block] = []
    marked = False

    def hold(m: re.Match) -> str:
        nonlocal marked
        if m["inline"]:
            marked = True
            return m[0]
        marked = True
        if m["comment"] or m["hidden"]:
            return ""
        if m["display"]:
            body = next(g for g in (m["d1"], m["d2"], m["d3"], m["d4"], m["d5"], m["d6"]) if g is not None)
            held.append(("formula", "$$" + _flat(body.strip("$")) + "$$"))
        else:
            body = m["fbody"] if m["fence"] else html.unescape(re.sub(r"</?code\b[^>]*>", "", m["pbody"])) if m["pre"] else m["vbody"]
            held.append(("code", "```\n" + (body or "").strip("\n") + "\n```"))
        return f"\n\x00{len(held) - 1}\x00\n" if not m["display"] or m[0].count("\n") else f"\x00{len(held) - 1}\x00"

    text = _CODE_OR_MATH.sub(hold, text)
    if _TEX_COMMENT.search(text):
        marked = True
        text = _TEX_COMMENT.sub("", text)
    if _TAG.search(text) or _ENTITY.search(text) or _TEX_COMMAND.search(text) or _INLINE.search(text) or _COMMENT.search(text):
        marked = True
    wiki = len(_WIKI.findall(text)) > len(_MARKDOWN.findall(text))
    out: list[_Block] = []
    lines = text.split("\n")
    paragraph: list[str] = []

    def flush():
        if paragraph:
            whole = _plain(" ".join(paragraph))
            last = 0
            for m in re.finditer("\x00(\\d+)\x00", whole):
                if t := whole[last : m.start()].strip():
                    out.append(("text", t))
                out.append(held[int(m[1])])
                last = m.end()
            if t := whole[last:].strip():
                out.append(("text", t))
            paragraph.clear()

    def add(kind: str, t: str):
        flush()
        out.append((kind, t))

    tabular = wikitable = False
    tex_list = 0
    for i, line in enumerate(lines):
        bare = line.strip()
        if wikitable:
            if bare.startswith("|}"):
                wikitable = False
            elif bare.startswith(("|-", "|+")) or not bare:
                pass
            elif bare.startswith(("!", "|")):
                add("table", "| " + " | ".join(_plain(c) for c in re.split(r"!!|\|\|", bare[1:])) + " |")
            continue
        if tabular:
            if re.search(r"\\end\{(?:tabular|array|longtable|tabularx|table)\*?\}", bare):
                tabular = False
            elif (row := re.sub(r"\\\\.*$|\\(?:hline|toprule|midrule|bottomrule)\b", "", bare).strip()):
                add("table", "| " + " | ".join(_plain(c) for c in row.split("&")) + " |")
            continue
        if bare.startswith("{|"):
            wikitable = marked = True
            add("table", "")
            continue
        if re.match(r"\\begin\{(?:tabular|longtable|tabularx)\*?\}", bare):
            tabular = marked = True
            add("table", "")
            continue
        if re.match(r"\\begin\{(?:itemize|enumerate|description)\}", bare):
            tex_list, marked = tex_list + 1, True
            add("list", "")
            continue
        if re.match(r"\\end\{(?:itemize|enumerate|description)\}", bare):
            tex_list -= 1
            flush()
            continue
        if m := re.match(r"\\item\b(?:\[[^\]]*\])?[ \t]*(.*)$", bare):
            marked = True
            add("list", "- " + _plain(m[1]))
        elif m := _TEX_HEAD.match(line):
            marked = True
            add("heading", "#" * _TEX_LEVEL[m[1]] + " " + _plain(m[2]))
        elif m := _WIKI_HEAD.match(bare):
            marked = True
            add("heading", "#" * len(m[1]) + " " + _plain(m[2]))
        elif wiki and (m := _WIKI_ITEM.match(line)) and not line.startswith("#\x00"):
            marked = True
            add("list", "- " + _plain(m[2]))
        elif m := _ATX.match(line):
            marked = True
            near = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            if len(m[1]) == 1 and any(re.match(r"#+ ", x) for x in near):  # ordered items of a wiki, one below the other
                add("list", "- " + _plain(m[2]))
            else:
                add("heading", m[1] + " " + _plain(m[2]))
        elif re.fullmatch(r"=+|-+", bare) and len(bare) >= 2 and len(paragraph) == 1 and i and lines[i - 1].strip() and _plain(paragraph[0]):
            marked = True
            title = _plain(paragraph.pop())
            add("heading", ("#" if bare[0] == "=" else "##") + " " + title)
        elif re.fullmatch(r"(?:-{3,}|\*{3,}|_{3,})", bare):
            marked = True
            flush()
        elif _RULE_ROW.match(line) and i and "|" in lines[i - 1]:
            marked = True
            if paragraph:
                head = paragraph.pop()
                add("table", "| " + " | ".join(_plain(c) for c in head.strip().strip("|").split("|")) + " |")
            else:
                add("table", "")
        elif _ROW.match(line) and (out and out[-1][0] == "table" and not paragraph or any(_ROW.match(lines[j]) for j in (i - 1, i + 1) if 0 <= j < len(lines))) and "\x00" not in line:
            marked = True
            add("table", "| " + " | ".join(_plain(c) for c in bare.strip("|").split("|")) + " |")
        elif (m := _ITEM.match(line)) and not _ATX.match(line):
            marked = True
            add("list", "- " + _plain(m[3]))
        elif not bare:
            flush()
        else:
            paragraph.append(line)
    flush()
    final: list[_Block] = []
    for kind, t in out:
        if kind in ("list", "table", "heading") and "\x00" in t:
            inner = [held[int(n)] for n in re.findall("\x00(\\d+)\x00", t)]
            final.append((kind, re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])][1], t)))
            final.extend((k, "") for k, _ in inner)
        else:
            final.append((kind, t))
    return final, marked


def is_html(text: str) -> bool:
    """Whether there are block tags outside code and comments; light markups have preformatted blocks, too."""
    return bool(_BLOCK_TAG.search(_CODE_OR_MATH.sub(lambda m: m[0] if m["display"] else " ", text)))


def render(blocks: list[_Block]) -> str:
    """The text of the blocks; items and rows stay together, everything else is a paragraph of its own."""
    out, last = [], ""
    for kind, t in blocks:
        if t:
            out.append(("\n" if kind == last and kind in ("list", "table") else "\n\n") + t if out else t)
            last = kind
    return "".join(out)


def _apart(root: Node, template: frozenset[int]) -> Node:
    """Marks the template's nodes in the tree, which leaves the slots, and gives a tree of the template alone."""
    fixed, stack = Node("#root"), [root]
    while stack:
        n = stack.pop()
        if n.number in template:
            n.template = True
            # its copy stands by itself, with all that is below it
            copy = Node(n.tag, n.text)
            copy.children = n.children
            fixed.children.append(copy)
        else:
            stack.extend(reversed(n.children))
    return fixed


def convert(text: str | None, template: frozenset[int] = frozenset()) -> tuple[str | None, list[str]]:
    """Clean text and the kinds of structure that the text marks up, ``['other']`` if only inline or hidden marks, [] if none.

    With a ``template``, the numbers of a page's nodes as induction has found them, the text is that of
    the slots; the kinds are those of the slots and of the template, as both are marked up.

    Null stays null; text without markup stays as it is.
    """
    if not text or not _MAYBE.search(text):
        return text, []
    if is_html(text):
        root = parse_html(text)
        fixed = _apart(root, template)
        slots = html_blocks(root)
        kinds = {k for k, _ in [*slots, *html_blocks(fixed)]} & set(KINDS)
        return render(slots), [k for k in KINDS if k in kinds] or ["other"]
    blocks, marked = light_blocks(text)
    kinds = {k for k, _ in blocks} & set(KINDS)
    if not marked and not kinds:
        return text, []
    return render(blocks), [k for k in KINDS if k in kinds] or ["other"]


# --- wrapper induction -------------------------------------------------------------------------


def _row(prev, w):
    """The next row of the alignment's table: the best of the lists so far, given the weights of one element with each of the other list."""
    if isinstance(prev, np.ndarray):
        return np.concatenate(([0], np.maximum.accumulate(np.maximum(prev[1:], prev[:-1] + w))))
    row = [0]
    for j, x in enumerate(w):
        row.append(max(prev[j + 1], row[j], prev[j] + x))
    return row


class _Matcher:
    """Sizes of mappings by shape: trees that differ in text only have one shape, so each two shapes are compared once."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.shapes: list[tuple[str, tuple[int, ...], int]] = []  # tag, shapes of the children, nodes
        self.of: dict[int, int] = {}
        self.size: dict[tuple[int, int], int] = {}

    def add(self, root: Node) -> None:
        order, stack = [], [root]
        while stack:
            order.append(n := stack.pop())
            stack.extend(n.children)
        for n in reversed(order):
            key = n.tag, tuple(self.of[id(c)] for c in n.children)
            if key not in self.ids:
                self.ids[key] = len(self.shapes)
                self.shapes.append((*key, 1 + sum(self.shapes[c][2] for c in key[1])))
            self.of[id(n)] = self.ids[key]

    def weight(self, x: int, y: int) -> int | None:
        """The size for two shapes, None if it isn't known yet."""
        if x == y:
            return self.shapes[x][2]
        if self.shapes[x][0] != self.shapes[y][0]:
            return 0
        if not self.shapes[x][1] or not self.shapes[y][1]:
            return 1
        return self.size.get((x, y))

    def compare(self, x: int, y: int) -> int:
        stack = [(x, y)]
        while stack:
            p, q = stack[-1]
            if self.weight(p, q) is None:
                xs, ys = self.shapes[p][1], self.shapes[q][1]
                if open := [(i, j) for i in set(xs) for j in set(ys) if self.weight(i, j) is None]:
                    stack.extend(open)
                    continue
                row, weights = self.first(ys), self.weights(ys)
                for i in xs:
                    row = _row(row, weights(i))
                self.size[p, q] = 1 + int(row[-1])
            stack.pop()
        return self.weight(x, y)

    @staticmethod
    def first(ys):
        return [0] * (len(ys) + 1) if len(ys) <= PLAIN_CHILDREN else np.zeros(len(ys) + 1, np.int64)

    def weights(self, ys):
        if len(ys) <= PLAIN_CHILDREN:
            return lambda x: [self.weight(x, y) for y in ys]
        kinds, place = np.unique(np.array(ys), return_inverse=True)
        known: dict[int, np.ndarray] = {}

        def of(x: int) -> np.ndarray:
            if x not in known:
                known[x] = np.array([self.weight(x, int(y)) for y in kinds], np.int64)
            return known[x][place]

        return of

    def aligned(self, p: int, q: int) -> list[tuple[int, int]]:
        """Positions of the children that the best alignment pairs. Every so many rows one is kept, the others are made again."""
        xs, ys = self.shapes[p][1], self.shapes[q][1]
        if p == q:
            return [(i, i) for i in range(len(xs))]
        if not xs or not ys:
            return []
        weights, step = self.weights(ys), math.isqrt(len(xs)) + 1
        row, kept = self.first(ys), []
        for i, x in enumerate(xs):
            if i % step == 0:
                kept.append(row)
            row = _row(row, weights(x))
        pairs, i, j, low, rows = [], len(xs), len(ys), -1, []
        while i and j:
            if (start := (i - 1) // step * step) != low:
                low, rows = start, [kept[start // step]]
                for x in xs[start:i]:
                    rows.append(_row(rows[-1], weights(x)))
            here, above = rows[i - low], rows[i - 1 - low]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return pairs


def match_trees(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """The size of the largest mapping between two trees that keeps parents, order and tags, and the mapping."""
    if a.tag != b.tag:
        return 0, []
    m = _Matcher()
    m.add(a)
    m.add(b)
    size = m.compare(m.of[id(a)], m.of[id(b)])
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        for i, j in m.aligned(m.of[id(x)], m.of[id(y)]):
            stack.append((x.children[i], y.children[j]))
    return size, pairs


#: The trees of the last reference pages; pages of one host mostly come one after the other.
_reference = functools.lru_cache(maxsize=16)(parse_html)


def same_nodes(page: str, reference: str) -> list[tuple[int, int]]:
    """(number in the reference, number in the page) of aligned nodes that hold the same text, and any."""
    _, pairs = match_trees(_reference(reference), parse_html(page))
    return [(a.number, b.number) for a, b in pairs if a.tag not in ("#root", "html", "body") and (t := _flat(text_of(a))) and t == _flat(text_of(b))]


def host_of(path: str) -> Column:
    """The host of a URL, or the first two folders of a path."""
    p = F.col(path)
    return F.when(p.rlike("^[a-z]+://"), F.regexp_extract(p, "^[a-z]+://([^/]+)", 1)).otherwise(F.regexp_extract(p, "^(/?[^/]+/[^/]+)/", 1))


def induce(pages: DataFrame) -> DataFrame:
    """(page rows, template): ``pages`` (host, id, content) with the numbers of each page's template nodes.

    Only HTML has a tree to align, so other rows are left out and don't count as pages. A host's
    reference is its page with the smallest id. Counts of matched nodes are taken together
    within each task before they are shuffled; a host with any number of pages has one row a node.
    """

    def only_html(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([is_html(t) for t in b.column(2).to_pylist()], pa.bool_()))

    ok = pages.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("content").isNotNull()).select("host", "id", "content")
    ok = written(ok.mapInArrow(only_html, "host string, id string, content string"), "html")
    ref = ok.groupBy("host").agg(F.min_by("content", F.struct("id", "content")).alias("reference"), F.count("*").alias("pages"))
    met = join_unique(ok, ref.where(F.col("pages") >= TEMPLATE_PAGES), "host", "inner")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [same_nodes(p, r) for p, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array([[x for x, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[y for _, y in r] for r in rows], pa.list_(pa.int32()))], names=["host", "id", "content", "pages", "theirs", "own"])

    # aligning takes far longer than moving the pages, so tasks are made by number of pages, not by bytes
    tasks = max(2 * pages.sparkSession.sparkContext.defaultParallelism, ok.count() // TASK)
    aligned = met.select("host", "id", "content", "reference", "pages").repartition(tasks).mapInArrow(align, "host string, id string, content string, pages long, theirs array<int>, own array<int>")
    aligned = written(aligned, "nodes")
    counts = aligned.select("host", "pages", F.explode("theirs").alias("node")).groupBy("host", "pages", "node").agg(F.count("*").alias("n"))
    # a node list is bounded by the size of the reference page
    constant = counts.where(F.col("n") >= F.col("pages") * TEMPLATE_SHARE).groupBy("host").agg(F.collect_set("node").alias("constant"))
    found = join_unique(aligned, constant, "host", "left")
    zipped = F.transform(F.filter(F.arrays_zip("theirs", "own"), lambda z: F.array_contains(F.col("constant"), z["theirs"])), lambda z: z["own"])
    return found.select("host", "id", "content", F.coalesce(zipped, F.array().cast("array<int>")).alias("template"))


def clean(rows: DataFrame, key: str, content: str, host: Column | None = None) -> DataFrame:
    """(id, text, kinds): every distinct row's clean text and the kinds of structure it marks up.

    ``host`` names what pages have a template in common; without it nothing is taken for template.
    Null content has null text and no kinds; empty, blank and very long texts are treated whole; a
    key with several contents has several rows. Other columns are left out.
    """
    base = rows.select((host if host is not None else F.lit(None).cast("string")).alias("host"), F.col(key).cast("string").alias("id"), F.col(content).cast("string").alias("content"))
    if host is not None:
        base = written(base.distinct(), "pages")
        known = written(induce(base), "aligned")
        rest = base.join(known.select("host", "id", "content").distinct(), ["host", "id", "content"], "left_anti").select("id", "content", F.array().cast("array<int>").alias("template"))
        base = known.select("id", "content", "template").unionByName(rest)
    else:
        base = base.select("id", "content", F.array().cast("array<int>").alias("template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [convert(t, frozenset(n or ())) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([k for _, k in got], pa.list_(pa.string()))], names=["id", "text", "kinds"])

    return base.mapInArrow(run, "id string, text string, kinds array<string>")
