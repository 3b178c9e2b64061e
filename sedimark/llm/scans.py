"""Noise in text from scanned pages: running lines, words split over lines, misread characters.

The lines of a page are labelled by a hidden Markov model with the states running (page header,
footer, number), body and break (blank lines, headings). What a line emits is a few layout features:
its place at the page's edge, its form, whether it comes back on other pages of the document, whether
its number fits the count of pages, and what the document's other pages have there. The model starts
from counts by rule and is re-estimated on the lines of all documents: a line's features are one of a
fixed number of codes, so tasks hand on tables of fixed size. Every document is decoded with it by the
Viterbi algorithm, page by page and whole, all pages of a batch at once.

The labels say which line goes on in which: a split word's second part is in the next line that isn't
running. Words are judged by a channel over the counts of all documents: a word is misread if a typical
confusion leads to it from one that is ``RATIO`` times as frequent, or if it has a sign inside that no
word has. Every distinct word is judged once, at most, whatever the number of documents that have it:
frequent words send out the forms that they may be misread as, and only words that are such a form,
or have odd signs or an odd shape, are looked at. All tests are ratios, so they are alike at every size.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.storage_paths import written

#: Rounds of estimating the line model.
ROUNDS = 3
#: A larger number that doesn't go on from page to page is no page's number.
MAX_PAGE = 999
#: Documents that one task reads where there are many.
TASK = 2_000
#: Part of all words from which a word's count is held by every task; the counts of rarer ones are joined to the documents that have them.
WORD_SHARE = 1e-6
#: Counts that a task holds before it hands them on.
HELD_WORDS = 1_000_000
#: How many times as frequent as a misread word the right one must be; for capitalised words, as names are many and like each other; for words with a sign or digit inside, which is evidence in itself.
RATIO, NAME_RATIO, SIGN_RATIO = 25, 100, 3
#: Part of all words from which a word with odd signs inside is one of its own, and a shape is common.
ESTABLISHED, COMMON_SHAPE = 2e-5, 1e-4
#: How many times as frequent a shape must be as the odd one that a word has.
SHAPE_RATIO = 50
#: Characters of a word at most; longer tokens, such as addresses and encoded data, are no words and have no wrong characters.
LONGEST = 64
#: Nonblank lines from either edge of a page that may be running.
EDGE = 2

HYPHENS = "-‐‑­¬"
#: What scanners take for what: (read, meant).
CONFUSIONS = [
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("c", "e"), ("e", "c"), ("f", "t"), ("b", "h"), ("v", "y"), ("m", "in"), ("m", "ni"), ("m", "rn"), ("d", "cl"), ("U", "ll"), ("li", "h"), ("l", "i"), ("I", "l"), ("D", "O"),
    ("1", "l"), ("1", "i"), ("1", "I"), ("1", "O"), ("1", "e"), ("0", "o"), ("0", "O"), ("0", "D"), ("0", "J"),
    ("5", "s"), ("5", "S"), ("6", "b"), ("6", "G"), ("8", "B"), ("8", "g"), ("9", "g"), ("9", "q"), ("3", "e"), ("3", "E"), ("2", "z"), ("2", "Z"), ("4", "A"), ("7", "T"), ("@", "a"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "I"), ("|", "P"), ("$", "s"), ("$", "S"), ("(", "c"), ("€", "e"), ("¢", "c"),
]
LETTERS = [(read, meant) for read, meant in CONFUSIONS if read.isalpha()]
#: Signs that no word has inside.
FOREIGN = re.compile(r"(?<=[^\W_])[~^|@!\\§¦°¨`´*_#<>{}\[\]]+(?=[^\W_])|^[~^|@!\\]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[~^|@\\]+$")
MAYBE_FOREIGN = re.compile(r"(?<=[^\W_])['’.,:;]+(?=[^\W_])")

_STATES = ("running", "body", "break")
_ROMAN = re.compile(r"[ivxlcdm]+|[IVXLCDM]+")
_NUMBER = re.compile(r"[-–—~|·•.()\[\]<>«»*\s]{0,4}(\d{1,5})[-–—~|·•.()\[\]<>«»*\s]{0,4}")
_OF = re.compile(r"\D{0,12}?(\d{1,5})\s*(?:of|von|de|sur|/|из|de un total de)\s*(\d{1,5})\D{0,3}", re.I)
_TRAILING = re.compile(r"(\S.*?)(?:\s{3,}|\s*[|·•–—]\s*)(\d{1,5}|[ivxlcdm]{1,7})\s*")
_LEADING = re.compile(r"(\d{1,5}|[ivxlcdm]{1,7})(?:\s{3,}|\s*[|·•–—]\s*)(\S.*?)\s*")
_CODE = re.compile(r"\S+(?:\s+\S+){0,3}\s+[A-Z0-9|!]{2,4}-[\dOlI|!SB]{3,6}")
_END = re.compile(r"[.!?:;»”\")\]]\s*$")
_FIGURES = re.compile(r"[\d\s.,]+|\S+\s{2,}[\d.,]+(?:\s{2,}[\d.,]+)*")


def _roman(s: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    v = [value[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


_ROMANS = frozenset("ivxlcdmIVXLCDM")
_DIGITS = frozenset("0123456789")


def _page_number(line: str) -> tuple[str, int | None, str]:
    """(form, number, rest): what a line is as a page's number line, the number, and the text beside it."""
    s = line.strip()
    if not s:
        return "", None, s
    digit_near_end = not _DIGITS.isdisjoint(s[-6:])
    if digit_near_end:
        if m := _OF.fullmatch(s):
            return "of", int(m[1]), ""
        if m := _NUMBER.fullmatch(s):
            return "number", int(m[1]), ""
    if s[-1] in _ROMANS and _ROMAN.fullmatch(s):
        return "roman", _roman(s), ""
    if (s[-1] in _DIGITS or s[-1] in _ROMANS) and (m := _TRAILING.fullmatch(s)) and len(m[1]) <= 60:
        return "beside", int(m[2]) if m[2].isdigit() else _roman(m[2]), m[1]
    if (s[0] in _DIGITS or s[0] in _ROMANS) and (m := _LEADING.fullmatch(s)) and len(m[2]) <= 60:
        return "beside", int(m[1]) if m[1].isdigit() else _roman(m[1]), m[2]
    return "", None, s


def _form(line: str, typical: float, title: str | None) -> str:
    s = line.strip()
    kind, _, rest = _page_number(s)
    if kind:
        if kind == "beside" and (len(re.findall(r"\s{2,}\d", s)) > 1 or not re.search(r"[^\W\d_]{2}", rest)):
            return "figures"
        return kind
    if (s[-1] in ".," or s[-1].isdigit()) and _FIGURES.fullmatch(s):
        return "figures"
    if "  " in s or "\t" in s:
        s = re.sub(r"\s+", " ", s)
    if title and _like(s.lower(), title):
        return "title"
    if "-" in s[-7:] and s[-1] != "." and _CODE.fullmatch(s):
        return "code"
    if len(s) < 0.9 * typical + 12 and (s[:8].isupper() or s[-8:].isupper()):
        letters = [c for c in s if c.isalpha()]
        if len(letters) > 4 and sum(c.isupper() for c in letters) >= 0.8 * len(letters):
            return "capitals"
    if len(s) < 0.75 * typical and s[:1].isupper() and s[-1] not in "," + HYPHENS and not _END.search(s):
        return "heading"
    return "text"


def _like(a: str, b: str) -> bool:
    """Equal but for some misread characters."""
    if a == b:
        return True
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > 2 or n < 5:
        return False
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    if head + tail < 0.4 * n:
        return False
    return max(len(a), len(b)) - head - tail <= max(1, 0.12 * n) or SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.85


def _ends(s: str) -> list[tuple[str, int, str]]:
    """Two lines that are ``_like`` but not equal have one of these in common: a fifth of the shorter one, whose length is n, from the head or the tail."""
    return [(end, n, s[: (n + 4) // 5] if end == "head" else s[-((n + 4) // 5) :]) for n in range(max(5, len(s) - 2), len(s) + 1) for end in ("head", "tail")]


def _near(seen: dict[str, set[int]]) -> dict[str, set[int]]:
    """Of each line the pages that have a like one; it ends at three pages, as more count the same."""
    by: dict[tuple[str, int, str], list[str]] = {}
    for s in seen:
        for e in _ends(s):
            by.setdefault(e, []).append(s)
    near: dict[str, set[int]] = {}
    for s, own in seen.items():
        pages, tried = set(own), {s}
        for o in (o for e in _ends(s) for o in by[e]):
            if len(pages) >= 3:
                break
            if o not in tried:
                tried.add(o)
                if not seen[o] <= pages and _like(s, o):
                    pages |= seen[o]
        near[s] = pages
    return near


PLACES = ["inner", "top0", "top1", "bottom0", "bottom1"]
FORMS = ["number", "roman", "of", "beside", "figures", "title", "code", "capitals", "heading", "text"]
AGAIN, FITS, COMMON = ["-", "0", "1", "2", "3"], ["-", "yes", "far", "only", "no"], ["-", "most", "few"]
#: All that a line's features can be: (place, form, comes back, number fits, what other pages have).
CODES = [(p, f, a, n, c) for p in PLACES for f in FORMS for a in AGAIN for n in FITS for c in COMMON]
_NUMBER_OF = {f: i for i, f in enumerate(CODES)}
_INNER = [_NUMBER_OF["inner", f, "-", "-", "-"] for f in FORMS]
_FORM_NUMBER = {f: i for i, f in enumerate(FORMS)}
BLANK = -1


def features(pages: list[str | None], title: str | None) -> list[list[int]]:
    """Of each line of each page the number of its features among ``CODES``; ``BLANK`` for a blank line."""
    lines = [(p or "").split("\n") for p in pages]
    full = [[i for i, x in enumerate(p) if x and not x.isspace()] for p in lines]
    lengths = sorted(len(p[i].strip()) for p, at in zip(lines, full) for i in at)
    typical = float(lengths[int(len(lengths) * 0.6)]) if lengths else 40.0
    title = title.strip().lower() if title and title.strip() else None
    edge: list[dict[int, str]] = []
    for at in full:
        e = {i: f"bottom{k}" for k, i in enumerate(at[::-1][:EDGE])}
        e.update({i: f"top{k}" for k, i in enumerate(at[:EDGE]) if i not in e or k < len(at) - 1 - k})
        edge.append(e)
    numbers = [{i: _page_number(lines[n][i]) for i in e} for n, e in enumerate(edge)]
    skeletons = [{i: re.sub(r"\s+", " ", x[2]).strip().lower() for i, x in e.items()} for e in numbers]
    seen: dict[str, set[int]] = {}
    offsets: dict[tuple, set[int]] = {}
    for n, e in enumerate(skeletons):
        for i, s in e.items():
            if len(s) > 3:
                seen.setdefault(s, set()).add(n)
            kind, number, _ = numbers[n][i]
            if kind:
                offsets.setdefault((kind, number - n), set()).add(n)
    near = _near(seen) if len(pages) > 1 else seen
    forms = [{i: _form(lines[n][i], typical, title) for i in at} for n, at in enumerate(full)]
    tops = [bool(at) and (forms[n][at[0]] in ("title", "code", "capitals", "heading", "beside") and (n > 0 and bool(full[n - 1])) or len(near.get(skeletons[n][at[0]], ())) > 1) for n, at in enumerate(full)]
    all_tops, all_full = sum(tops), sum(map(bool, full))
    out = []
    for n, p in enumerate(lines):
        row = [BLANK] * len(p)
        others, there = all_tops - tops[n], all_full - bool(full[n])
        for i in full[n]:
            place = edge[n].get(i)
            if place is None:
                row[i] = _INNER[_FORM_NUMBER[forms[n][i]]]
                continue
            kind, number, _ = numbers[n][i]
            fits = "-"
            if kind:
                fits = "yes" if len(offsets[kind, number - n]) > 1 else "far" if number > MAX_PAGE else "only" if there == 0 else "no"
            common = "-" if place != "top0" or not there else "most" if others >= 0.5 * there else "few"
            row[i] = _NUMBER_OF[place, forms[n][i], str(min(len(near.get(skeletons[n][i], ())), 3)), fits, common]
        out.append(row)
    return out


def _first_guess(f: tuple) -> str:
    place, form, again, fits, common = f
    if place == "inner":
        return "break" if form in ("capitals", "heading", "title") else "body"
    if form in ("number", "roman", "of", "beside"):
        if fits == "yes" or form == "of" or fits == "only" and place.startswith("bottom"):
            return "running"
        if form == "roman" and place == "bottom0" or form == "beside" and again in "23":
            return "running"
        return "body"
    if form == "figures":
        return "body"
    if form == "code" and place in ("top0", "bottom0"):
        return "running"
    if again in "23" and form != "text" and place in ("top0", "bottom0"):
        return "running"
    if place == "top0" and common == "most" and form in ("title", "capitals", "heading"):
        return "running"
    return "break" if form in ("capitals", "heading", "title") else "body"


def _parts(f: tuple) -> tuple[str, str, str, str]:
    """The parts of a line that are taken as independent: form by place, repetition by form, fit by form, the other pages by form."""
    place, form, again, fits, common = f
    return place + form, form + again + place[:3], form + fits + place[:3], form + common


#: By code: the state to start from (the last is that of a blank line), the numbers of its independent parts, and whether it can't be running.
_GUESS = np.array([_STATES.index(_first_guess(f)) for f in CODES] + [2])
_PARTS = np.stack([np.unique([_parts(f)[k] for f in CODES], return_inverse=True)[1] for k in range(4)])
_FIXED = np.array([f[0] == "inner" or f[3] == "far" for f in CODES])


@dataclass
class LineModel:
    """Log probabilities: of each code (the last is the blank line) by state, of the next state by state, of the first and last one."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def counted(cls, lines: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray) -> LineModel:
        """From numbers of lines by code and state, of steps, and of first and last states."""
        totals = 8.0 + lines.sum(0)
        emit = np.zeros((len(CODES) + 1, 3))
        for own in _PARTS:
            n = np.zeros((own.max() + 1, 3))
            np.add.at(n, own, lines)
            emit[:-1] += np.where(n.sum(1, keepdims=True) > 0, np.log((n + 0.2) / totals), -9.0)[own]
        emit[:-1, 0] -= 30.0 * _FIXED
        emit[-1] = -30.0, -30.0, 0.0
        log = lambda x: np.log((x + 0.5) / (x + 0.5).sum(-1, keepdims=True))
        return cls(emit, log(step), log(start), log(end))

    def decode(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The most probable states of the lines of each page. Pages of about one length go through together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pages)
        size = np.array([len(p) for p in pages])
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        for own in np.split(order, np.flatnonzero(np.diff(np.ceil(np.log2(size[order]) * 2))) + 1) if len(order) else ():
            for at in (own[i : i + 4096] for i in range(0, len(own), 4096)):
                n, width = size[at], int(size[at].max())
                codes = np.full((len(at), width), BLANK)
                for i, k in enumerate(at):
                    codes[i, : n[i]] = pages[k]
                e = self.emit[codes]
                score, back = self.start + e[:, 0], np.zeros((width, len(at), 3), np.int8)
                last = np.zeros(len(at), np.int8)
                for t in range(width):
                    if t:
                        ways = score[:, :, None] + self.step
                        back[t] = ways.argmax(1)
                        score = ways.max(1) + e[:, t]
                    done = n == t + 1
                    last[done] = (score[done] + self.end).argmax(1)
                states = np.zeros((len(at), width), np.int8)
                rows = np.arange(len(at))
                now = last.copy()
                for t in range(width - 1, -1, -1):
                    now = np.where(t == n - 1, last, now)
                    states[:, t] = now
                    now = np.where(t <= n - 1, back[t][rows, now], now)
                for i, k in enumerate(at):
                    out[k] = states[i, : n[i]]
        return out


_SIZES = [(len(CODES), 3), (3, 3), (3,), (3,)]


def _tally(pages: list[np.ndarray], states: list[np.ndarray]) -> np.ndarray:
    """The counts that a model is made from, one after the other."""
    lines, step, start, end = (np.zeros(s) for s in _SIZES)
    kept = [(c, s) for c, s in zip(pages, states) if len(c)]
    if kept:
        codes, flat = np.concatenate([c for c, _ in kept]), np.concatenate([s for _, s in kept]).astype(np.int64)
        np.add.at(lines, (codes[codes >= 0], flat[codes >= 0]), 1)
        first = np.cumsum([0, *(len(c) for c, _ in kept)])
        inside = np.ones(len(flat) - 1, bool)
        inside[first[1:-1] - 1] = False
        np.add.at(step, (flat[:-1][inside], flat[1:][inside]), 1)
        np.add.at(start, flat[first[:-1]], 1)
        np.add.at(end, flat[first[1:] - 1], 1)
    return np.concatenate([x.ravel() for x in (lines, step, start, end)])


def _model(tally: np.ndarray) -> LineModel:
    cuts = np.cumsum([int(np.prod(s)) for s in _SIZES])
    return LineModel.counted(*(x.reshape(s) for x, s in zip(np.split(tally, cuts[:-1]), _SIZES)))


def fit_lines(documents: list[tuple[list[str | None], str | None]]) -> LineModel:
    """The model of a few documents; ``fit`` does the same on tables."""
    pages = [np.array(c) for p, title in documents for c in features(p, title)]
    model = _model(_tally(pages, [_GUESS[c] for c in pages]))
    for _ in range(ROUNDS - 1):
        model = _model(_tally(pages, model.decode(pages)))
    return model


# --- words -------------------------------------------------------------------------------------

_STRIP = ".,;:!?()[]\"“”«»…"
_LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl"}
#: The last token of a line that ends with a hyphen.
_BROKEN = re.compile(rf"(?<!\S)(\S*[{HYPHENS}])[^\S\n]*$", re.M)


class _Cores(dict):
    """Tokens without the signs around them, remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > HELD_WORDS:
            self.clear()
        core = token if token.isascii() else unicodedata.normalize("NFC", token.translate(_LIGATURES))
        core = self[token] = core.strip(_STRIP)
        return core


_cores = _Cores()


def _core(token: str) -> str:
    return _cores[token]


def shape(word: str) -> str:
    """Digits as 9, capitals as A, other letters as a; a + for more of the same."""
    if word.isalpha() and len(word) > 2:
        if word.islower():
            return "a+"
        if word[0].isupper() and word[1:].islower():
            return "Aa+"
    return _MORE.sub(r"\1+", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))


_MORE = re.compile(r"(.)\1+")


#: Signs that are evidence of a misread character in themselves.
SIGNS = "@!|$(€¢"


def _options(core: str) -> list[str]:
    """What a misread word may stand for."""
    options = []
    for pattern in (FOREIGN, MAYBE_FOREIGN):
        for m in pattern.finditer(core):
            options.append(core[: m.start()] + core[m.end() :])
    for read, meant in CONFUSIONS:
        at = core.find(read)
        while at >= 0:
            options.append(core[:at] + meant + core[at + len(read) :])
            at = core.find(read, at + 1)
    return options


def _reshaped(word: str) -> Iterator[tuple[int, str]]:
    """(position, word): the word with another digit, letter or sign at one position."""
    for i, c in enumerate(word):
        for o in [meant for read, meant in CONFUSIONS if read == c] if not c.isalpha() else [read for read, meant in CONFUSIONS if meant == c and read.isdigit()]:
            yield i, word[:i] + o + word[i + 1 :]


def spellings(word: str) -> list[str]:
    """The word and, if it begins or is written with capitals, its other ways; all count for it."""
    if word[:1].isupper() and word[1:].islower() or word.isupper():
        return [word, low := word.lower(), low.capitalize()]
    return [word]


def _is_name(word: str) -> bool:
    return word[:1].isupper() and word[1:].islower()


def misread_forms(word: str) -> Iterator[str]:
    """What a word may be misread as by letters alone; forms with a sign or digit are looked at in any case."""
    for w in {word, word.capitalize(), word.upper()} if word.islower() else {word, word.upper()} if _is_name(word) else {word}:
        for read, meant in LETTERS:
            at = w.find(meant)
            while at >= 0:
                yield w[:at] + read + w[at + len(meant) :]
                at = w.find(meant, at + 1)


@dataclass
class Lexicon:
    """Counts of words and shapes, as far as they are known here, and the number of all words."""

    words: dict[str, int]
    shapes: dict[str, int]
    total: int

    def count(self, word: str) -> int:
        return max(self.words.get(w, 0) for w in spellings(word))

    def asks(self, word: str) -> Iterator[str]:
        """The keys of the counts that judging and repairing a word may need: ``w`` with a word, ``s`` with a shape."""
        if len(word) > LONGEST:
            yield "w" + word
            return
        for w in (word, *_options(word)):
            yield from ("w" + x for x in spellings(w))
        if any(c.isdigit() or c in SIGNS for c in word):
            yield "s" + shape(word)
            yield from ("s" + shape(o) for _, o in _reshaped(word))

    def misread_at(self, word: str) -> int | None:
        """Where a word has a wrong character, or None."""
        if not 2 <= len(word) <= LONGEST:
            return None
        own = max(1, self.count(word))
        if (m := FOREIGN.search(word)) and not re.search(r"[/@]\S*\.\w|://", word):
            if own < max(1.5, ESTABLISHED * self.total) or self.count(word[: m.start()] + word[m.end() :]) > RATIO * own:
                return m.start()
        has_letter, has_digit = any(c.isalpha() for c in word), any(c.isdigit() for c in word)
        if not has_letter:
            return None
        for m in MAYBE_FOREIGN.finditer(word):
            if self.count(word[: m.start()] + word[m.end() :]) >= SIGN_RATIO * own:
                return m.start()
        for read, meant in CONFUSIONS:
            enough = own * (SIGN_RATIO if not read.isalpha() else NAME_RATIO if _is_name(word) else RATIO)
            at = word.find(read)
            while at >= 0:
                if self.count(word[:at] + meant + word[at + len(read) :]) >= enough:
                    return at
                at = word.find(read, at + 1)
        if has_digit or any(c in SIGNS for c in word):
            rare = self.shapes.get(shape(word), 0)
            if rare < COMMON_SHAPE * self.total:
                for i, o in _reshaped(word):
                    if self.shapes.get(shape(o), 0) >= SHAPE_RATIO * max(1, rare):
                        return i
        return None

    def repaired(self, word: str) -> str:
        """What a misread word stands for, as far as the counts tell."""
        best = max(_options(word), key=self.count, default=word)
        return best if self.count(best) > self.count(word) else FOREIGN.sub("", word)

    def verdict(self, word: str) -> tuple[int, str] | None:
        at = self.misread_at(word)
        return None if at is None else (at, self.repaired(word))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all pages of ``docs``; the broken words at the ends of lines don't count. Counts are summed up within tasks first."""

    def counted(tokens: Counter) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for t, n in tokens.items():
            if (c := _core(t)) and n:
                words[c] += n
        items = list(words.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        for b in batches:
            for p in b.column(0).to_pylist():
                text = "\n".join(x for x in p if x)
                tokens.update(text.split())
                tokens.subtract(_BROKEN.findall(text))
            if len(tokens) > HELD_WORDS:
                yield from counted(tokens)
                tokens = Counter()
        yield from counted(tokens)

    return docs.select("pages").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shapes(words: DataFrame) -> DataFrame:
    """(shape, n) of (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: Counter = Counter()
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shapes[shape(w)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(shapes), pa.string()), pa.array(list(shapes.values()), pa.int64())], names=["shape", "n"])

    return words.mapInArrow(run, "shape string, n long").groupBy("shape").agg(F.sum("n").alias("n"))


_ODD = re.compile(r"[\d~^|@!\\§¦°¨`´*_#<>{}\[\]'’.,:;$(€¢]")
#: Codes of capitals and digits, which are many; if their shape is common, nothing is odd about them.
_CODED = re.compile(r"[A-Z]{2,}[-/ ]?\d+")


def verdicts(words: DataFrame, shapes: DataFrame, total: int) -> DataFrame:
    """(word, at, meant) of the misread words of (word, n): where the wrong character is and what the word stands for.

    Words that a frequent one may be misread as, and those with odd signs or an odd shape, are looked
    at with the counts of all that they may stand for; the others can't be misread.
    """
    # at most 1 / COMMON_SHAPE shapes
    common = words.sparkSession.sparkContext.broadcast({r[0] for r in shapes.where(F.col("n") >= COMMON_SHAPE * total).select("shape").collect()})

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form, of = [], []
            odd = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(w) > LONGEST:
                    continue
                if n >= RATIO:
                    forms = set(misread_forms(w)) - {w}
                    form += forms
                    of += [n] * len(forms)
                if not w.isalpha() and len(w) > 1 and _ODD.search(w) and any(c.isalpha() for c in w) and not (_CODED.fullmatch(w) and shape(w) in common.value):
                    odd.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(form + odd, pa.string()), pa.array(of + [None] * len(odd), pa.int64())], names=["word", "of"])

    sent = written(words.mapInArrow(looked_at, "word string, of long"), "forms")
    forms = sent.where(F.col("of").isNotNull()).groupBy("word").agg(F.max("of").alias("of"))
    met = words.join(forms, "word").where(F.col("of") >= RATIO * F.col("n")).select("word")
    looked = met.unionByName(sent.where(F.col("of").isNull()).select("word")).distinct()

    return _judged_words(looked, words, shapes, total)


def _judged_words(looked: DataFrame, words: DataFrame, shapes: DataFrame, total: int) -> DataFrame:
    """(word, at, meant) of the misread ones of ``looked`` (word)."""

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon({}, {}, total)
        for b in batches:
            own = b.column(0).to_pylist()
            keys = [sorted(set(lexicon.asks(w))) for w in own]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, k in zip(own, keys) for _ in k], pa.string()), pa.array([x for k in keys for x in k], pa.string())], names=["word", "key"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = {x["key"]: x["n"] for x in found}
                v = Lexicon({k[1:]: x for k, x in n.items() if k[0] == "w"}, {k[1:]: x for k, x in n.items() if k[0] == "s"}, total).verdict(w)
                if v:
                    out.append((w, *v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string())], names=["word", "at", "meant"])

    asked = looked.mapInArrow(asking, "word string, key string").join(_keyed(words, shapes), "key")
    # a word asks for some dozens of keys
    return asked.groupBy("word").agg(F.collect_list(F.struct("key", "n")).alias("found")).mapInArrow(judge, "word string, at int, meant string")


def _keyed(words: DataFrame, shapes: DataFrame) -> DataFrame:
    return words.select(F.concat(F.lit("w"), "word").alias("key"), "n").unionByName(shapes.select(F.concat(F.lit("s"), "shape").alias("key"), "n"))


_JOINERS = {"and", "or", "und", "oder", "bzw.", "et", "ou", "y", "e", "o", "u", "и", "или", "to", "bis"}


@dataclass
class Known:
    """What a document's words are judged by: counts for words that lines may join to, and verdicts."""

    lexicon: Lexicon
    wrong: dict[str, tuple[int, str]]

    @classmethod
    def of(cls, pages: list[str | None], lexicon: Lexicon) -> Known:
        """From counts of all words; ``fit`` finds the verdicts once for every document."""
        words = {_core(t) for p in pages for t in (p or "").split()}
        words |= {w for a, b in _joins([x for p in pages for x in (p or "").split("\n")], set()) for w in (a + b, a + "-" + b)}
        return cls(lexicon, {w: v for w in words if w and (v := lexicon.verdict(w))})


def noisy_lines(pages: list[str | None], title: str | None, model: LineModel, lexicon: Lexicon) -> tuple[list[tuple[int, int, str]], list[str]]:
    """((page, line, kind)...) from 1, and the paragraphs of the document."""
    states = model.decode([np.array(c) for c in features(pages, title)])
    found, text, joined, wrong = _judged(pages, states, known := Known.of(pages, lexicon))
    return found, _paragraphs(text, joined, known, wrong)


def _continued(pages: list[str | None], states: list) -> tuple[list, list, list[int], list]:
    """(running lines, other lines, places of those that aren't blank, (place, next place, first part, second part, next token) where a word may go on)."""
    found: list[tuple[int, int, str]] = []
    text: list[tuple[int, int, str, bool]] = []  # page, line, content, whether it is a break
    for n, (page, f) in enumerate(zip(pages, states), 1):
        for i, (line, s) in enumerate(zip((page or "").split("\n"), f), 1):
            if s == 0 and line.strip():
                found.append((n, i, "running"))
            else:
                text.append((n, i, line, s == 2))
    full = [k for k, t in enumerate(text) if t[2].strip()]
    parts = []
    for k, after in zip(full, full[1:]):
        line, following = text[k][2].rstrip(), text[after][2].lstrip()
        if len(line) < 2 or line[-1] not in HYPHENS or not line[-2].isalnum() or line[-2].isdigit():
            continue
        head, tail = line.split()[-1][:-1], following.split()[0]
        bare, rest = head.lstrip(_STRIP), _core(tail)
        if rest:
            parts.append((k, after, bare, rest, tail))
    return found, text, full, parts


def _joins(lines: list[str], edges: set[int]) -> Iterator[tuple[str, str]]:
    """(first, second part) of all words that may go on from one of the lines in a later one, whatever is running: up to the next line that isn't at an edge."""
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    for k, i in enumerate(full):
        line = lines[i].rstrip()
        if line[-1] not in HYPHENS or len(line) < 2 or not line[-2].isalnum() or line[-2].isdigit():
            continue
        bare = line.split()[-1][:-1].lstrip(_STRIP)
        for j in full[k + 1 :]:
            if rest := _core(lines[j].split()[0]):
                yield bare, rest
            if j not in edges:
                break


_AT_EDGE = np.array([f[0] != "inner" for f in CODES] + [False])


def _asked(pages: list[str | None], codes: list[list[int]], sound: dict[str, int]) -> tuple[list[str], list[str]]:
    """The words of which the document must know whether they are misread, and the keys of what it must know about words that lines may join to."""
    text = "\n".join(p or "" for p in pages)
    words = {c for t in set(text.split()) if 1 < len(c := _core(t)) <= LONGEST and c not in sound}
    keys: set[str] = set()
    if _BROKEN.search(text):
        edges = set(np.flatnonzero(_AT_EDGE[[c for page in codes for c in page]]).tolist())
        for bare, rest in _joins(text.split("\n"), edges):
            for w in (bare + rest, bare + "-" + rest):
                keys.update("w" + x for x in spellings(w))
            if rest[0].isdigit():
                keys.add("s" + shape(bare + "-" + rest))
    return list(words), list(keys)


def _judged(pages: list[str | None], states: list, known: Known) -> tuple[list[tuple[int, int, str]], list, dict, set[int]]:
    """(noisy lines, other lines, joined words, places of lines with misread words)."""
    found, text, full, parts = _continued(pages, states)
    lexicon = known.lexicon
    joined: dict[int, tuple[str, int, int]] = {}  # position in text: repaired word, length of the part on this line, place of the next line
    for k, after, bare, rest, tail in parts:
        line = text[k][2].rstrip()
        whole, hyphened = bare + rest, bare + "-" + rest
        if tail.lower() in _JOINERS or rest.lower() in _JOINERS and not lexicon.count(whole):
            continue
        if rest[0].isdigit():
            if line[-1] != "-" or not (bare.isupper() and lexicon.shapes.get(shape(hyphened), 0) > COMMON_SHAPE * lexicon.total):
                continue
        elif not rest[0].islower() and not lexicon.count(whole) and not lexicon.count(hyphened):
            continue
        word = hyphened if lexicon.count(hyphened) > lexicon.count(whole) or rest[0].isdigit() else whole
        joined[k] = (word, len(bare) + (word == hyphened), after)
        found.append((text[k][0], text[k][1], "split"))
    second = {j[2] for j in joined.values()}
    wrong: set[int] = set()
    some = {w for w in known.wrong}
    for k in full if some else ():
        line = text[k][2]
        if not any(w in line for w in some) and line.isascii():
            continue
        tokens = line.split()
        if k in joined:
            tokens.pop()
        if k in second and tokens:
            tokens.pop(0)
        if any(_core(t) in some for t in tokens):
            wrong.add(k)
    for k, (word, cut, after) in joined.items():
        if word in some:
            wrong.add(k if known.wrong[word][0] < cut else after)
    found += [(text[k][0], text[k][1], "misread") for k in wrong]
    return sorted(set(found)), text, joined, wrong


def repair(token: str, known: Known) -> str:
    """The token with its word as it stands for, if it is misread."""
    core = _core(token)
    v = known.wrong.get(core)
    if not v:
        return token
    return token.replace(core, v[1]) if core in token else v[1]


def _paragraphs(text: list[tuple[int, int, str, bool]], joined: dict, known: Known, wrong: set[int]) -> list[str]:
    out: list[list[str]] = [[]]
    held = ""
    skip = False
    following: list[tuple | None] = [None] * len(text)
    for k in range(len(text) - 2, -1, -1):
        following[k] = text[k + 1] if text[k + 1][2].strip() else following[k + 1]
    for k, (page, _, line, is_break) in enumerate(text):
        bare = line.strip()
        if not bare:
            follows = following[k]
            if not held and not (follows and follows[0] != page and out[-1] and not _END.search(out[-1][-1])):
                out.append([])
            continue
        tokens = bare.split()
        if skip:
            first = tokens.pop(0)
            core = _core(first)
            v = known.wrong.get(held)
            tokens.insert(0, (v[1] if v else held) + (first[first.find(core) + len(core) :] if core and core in first else ""))
            held, skip = "", False
        if k in joined:
            held, skip = joined[k][0], True
            last = tokens.pop() if tokens else ""
            if last and last[0] in _STRIP:
                tokens.append(last[: len(last) - len(last.lstrip(_STRIP))])
        tokens = [repair(t, known) for t in tokens] if k in wrong else tokens
        if is_break or line.startswith("   "):
            out.append([" ".join(tokens)])
            if not held:
                out.append([])
        else:
            out[-1].extend(tokens)
    return [p for x in out if (p := " ".join(x).strip())]


@dataclass
class Reader:
    """``lines``: (id, pages, codes, found) of every document, where found has the counts and verdicts that it asks for; ``frequent`` has the counts that every task holds."""

    model: LineModel
    frequent: dict[str, int]
    total: int
    lines: DataFrame


def fit(docs: DataFrame) -> Reader:
    """The line model, and what the documents' words are judged by, of (id, title, pages)."""
    spark = docs.sparkSession
    docs = written(docs, "documents")
    words = written(word_counts(docs), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    shapes = written(_shapes(words), "shapes")
    judged = written(verdicts(words, shapes, total), "verdicts")
    # at most 1 / WORD_SHARE words
    held = words.join(judged, "word", "left").where(F.col("n") >= max(2, total * WORD_SHARE)).collect()
    frequent = {r.word: r.n for r in held}
    sound = spark.sparkContext.broadcast({r.word: r.n for r in held if r.at is None})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                pages = part.column("pages").to_pylist()
                codes = [features(p, t) for p, t in zip(pages, part.column("title").to_pylist())]
                asked = [_asked(p, c, sound.value) for p, c in zip(pages, codes)]
                lists = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex for _ in pages], pa.string()), part.column("id"), part.column("pages"), pa.array(codes, pa.list_(pa.list_(pa.int16()))), pa.array([w for w, _ in asked], lists), pa.array([k for _, k in asked], lists)], names=["row", "id", "pages", "codes", "words", "joins"])

    lines = written(docs.mapInArrow(label, "row string, id string, pages array<string>, codes array<array<short>>, words array<string>, joins array<string>"), "lines")

    def tallied(model: LineModel | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _tally([], [])
            for b in batches:
                codes = _codes(b.column(0))
                total += _tally(codes, [_GUESS[c] for c in codes] if model is None else model.decode(codes))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["t"])

        return run

    model = None
    for _ in range(ROUNDS):
        # of fixed size, whatever the number of documents
        parts = lines.select("codes").mapInArrow(tallied(model), "t binary").repartition(1).mapInArrow(_summed, "t binary").collect()
        model = _model(np.frombuffer(parts[0][0])) if parts else _model(_tally([], []))
    joins = lines.select("row", F.explode("joins").alias("key"))
    # words that stand nowhere in one piece are judged, too
    new = joins.where(F.col("key").startswith("w")).select(F.substring("key", 2, 1_000_000).alias("word")).distinct().join(words, "word", "left_anti")
    unseen = _judged_words(new, words, shapes, total)
    bad = judged.unionByName(unseen)
    wrong = lines.select("row", F.explode("words").alias("word")).join(bad, "word").select("row", F.concat(F.lit("w"), "word").alias("key"), F.lit(None).cast("long").alias("n"), "at", "meant")
    info = joins.join(_keyed(words, shapes), "key", "left").join(bad.select(F.concat(F.lit("w"), "word").alias("key"), "at", "meant"), "key", "left").where(F.col("n").isNotNull() | F.col("at").isNotNull())
    found = info.select("row", "key", "n", "at", "meant").unionByName(wrong).groupBy("row").agg(F.collect_list(F.struct("key", "n", "at", "meant")).alias("found"))
    return Reader(model, frequent, total, lines.select("row", "id", "pages", "codes").join(found, "row", "left").drop("row"))


def _codes(column: pa.Array) -> list[np.ndarray]:
    """The codes of each page."""
    pages = column.flatten()
    offsets = pages.offsets.to_numpy()
    return np.split(pages.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:-1] - offsets[0]) if len(pages) else []


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _tally([], [])
    for b in batches:
        for t in b.column(0):
            total = total + np.frombuffer(t.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["t"])


def documents(rows: DataFrame, key: str = "file_id", pages: str = "page_texts", title: str | None = "title") -> DataFrame:
    """(id, title, pages): the distinct documents that have pages.

    Reading them takes far longer than moving them, so tasks are made by number of documents, not by bytes.
    """
    t = (F.col(title) if title else F.lit(None)).cast("string").alias("title")
    picked = rows.select(F.col(key).cast("string").alias("id"), t, F.col(pages).alias("pages")).where(F.col("id").isNotNull() & F.col("pages").isNotNull())
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK)
    return picked.repartition(tasks, "id", "title", "pages").distinct()


def _over(reader: Reader, schema: str, make) -> DataFrame:
    shared = reader.lines.sparkSession.sparkContext.broadcast((reader.model, reader.frequent, reader.total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent, total = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                decoded = iter(model.decode(_codes(part.column("codes"))))
                rows = []
                for key, pages, found in zip(*(part.column(c).to_pylist() for c in ("id", "pages", "found"))):
                    rare: dict[str, int] = {}
                    shapes: dict[str, int] = {}
                    bad: dict[str, tuple[int, str]] = {}
                    for x in found or ():
                        k = x["key"]
                        if x["n"] is not None:
                            (rare if k[0] == "w" else shapes)[k[1:]] = x["n"]
                        if x["at"] is not None:
                            bad[k[1:]] = (x["at"], x["meant"])
                    known = Known(Lexicon(ChainMap(rare, frequent), shapes, total), bad)
                    rows += [(key, *x) for x in make(pages, [next(decoded) for _ in pages], known)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[f.split()[0] for f in schema.split(", ")])

    return reader.lines.select("id", "pages", "codes", "found").mapInArrow(run, schema)


def noise(reader: Reader) -> DataFrame:
    """(id, page_no, line_no, kind): the noisy lines, each kind once. Null and empty pages have none; pages and lines count from 1."""
    return _over(reader, "id string, page_no long, line_no long, kind string", lambda *x: _judged(*x)[0]).distinct()


def paragraphs(reader: Reader) -> DataFrame:
    """(id, number, paragraph): continuous text without running lines, with split words joined and misread ones repaired."""

    def make(pages, states, known):
        _, text, joined, wrong = _judged(pages, states, known)
        return enumerate(_paragraphs(text, joined, known, wrong), 1)

    return _over(reader, "id string, number long, paragraph string", make)
