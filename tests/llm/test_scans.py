import random
import textwrap

import pytest

from sedimark.llm import scans as S

FRAMES = ["The report of {} lists many cases where the contract followed the verdict.", "Nobody at {} expected the evidence to depend on the witness this spring.", "Under the new statute the hearing and the settlement were compared by {}.", "About half of the lines of the record by {} remain unclear and open.", "When {} opened the tribunal the entries on the licence were rare."]


def name(r):
    return "".join(r.choice("BDGKLMNPRSTVZ" if i == 0 else "bdgklmnprstvz") + r.choice("aeiou") for i in range(3))


def document(r):
    body = " ".join(r.choice(FRAMES).format(name(r)) for _ in range(r.randint(12, 24)))
    lines, split = [], set()
    words, line = body.split(), ""
    for w in words:
        if len(line) + len(w) + 1 > 58:
            if len(w) > 6 and w.isalpha() and r.random() < 0.5:
                split.add(len(lines))
                lines.append(line + " " + w[:4] + "-")
                line = w[4:]
                continue
            lines.append(line)
            line = w
        else:
            line = (line + " " + w).strip()
    lines.append(line)
    misread = set()
    for i in range(len(lines)):
        for a, b in (("the ", "tbe "), ("cases", "cascs"), ("open", "op~en"), ("entries", "eritries"), ("record", "rec0rd")):
            if a in lines[i] and r.random() < 0.012:
                lines[i] = lines[i].replace(a, b, 1)
                misread.add(i)
                break
    head, style = "Review of " + name(r) + " " + name(r), r.choice(["{}", "- {} -", "Page {} of 9", "none"])
    first, pages, truth, at = r.randint(1, 40), [], set(), 0
    size = r.randint(9, 14)
    for n, start in enumerate(range(0, len(lines), size), 1):
        page = ["" if style == "none" else head, ""] if style != "none" else []
        if page:
            truth.add((n, 1, "running"))
        for i in range(start, min(start + size, len(lines))):
            page.append(lines[i])
            truth |= {(n, len(page), k) for k, at in (("split", split), ("misread", misread)) if i in at}
        if style != "none":
            page += ["", style.format(n if "of" in style else first + n)]
            truth.add((n, len(page), "running"))
        pages.append("\n".join(page))
    return pages, truth, body


KIND = "file_id string, title string, page_texts array<string>, id string, pages long"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    return [document(r) for _ in range(150)]


@pytest.fixture(scope="module")
def read(spark, corpus):
    rows = [(f"d{i}", None, p, "x", 1) for i, (p, _, _) in enumerate(corpus)]
    rows += [rows[0], ("null", None, None, None, None), ("empty", None, [], None, None), ("nothing", "T", ["", None, " \n "], None, None), (None, None, ["a"], None, None), ("long", None, ["word and word\n" * 4000], None, None)]
    return S.fit(S.documents(spark.createDataFrame(rows, KIND)))


def test_found_lines(read, corpus):
    got: dict = {}
    for x in S.noise(read).collect():
        got.setdefault(x.id, set()).add((x.page_no, x.line_no, x.kind))
    for kind in ("running", "split", "misread"):
        want = {(f"d{i}", *t) for i, (_, truth, _) in enumerate(corpus) for t in truth if t[2] == kind}
        have = {(d, *t) for d, ts in got.items() if d[0] == "d" for t in ts if t[2] == kind}
        assert len(want & have) >= 0.95 * len(want), kind
        assert len(want & have) >= 0.95 * len(have), kind
    assert not got.keys() & {"null", "empty", "nothing", "long"}


def test_paragraphs_give_back_the_text(read, corpus):
    whole: dict = {}
    for x in S.paragraphs(read).orderBy("id", "number").collect():
        whole.setdefault(x.id, []).append(x.paragraph)
    same = [" ".join(whole[f"d{i}"]).split() == body.split() for i, (_, _, body) in enumerate(corpus)]
    assert sum(same) >= 0.9 * len(same)


def test_empty(spark):
    docs = S.documents(spark.createDataFrame([], KIND))
    assert S.noise(S.fit(docs)).count() == 0


def lexicon(**words):
    return S.Lexicon({k: v for k, v in words.items()}, {"A+-9+": 10_000, "9+": 9000}, 100_000)


@pytest.mark.parametrize("word,wrong", [("abou~t", True), ("ahout", False), ("tbe", True), ("th.e", True), ("h0rse", True), ("horse", False), ("Krodova", False), ("AB-1234", False), ("A8-1234", True), ("AB-12|34", True), ("12O4", True), ("d'horse", False), ("l.e", False)])
def test_misread(word, wrong):
    assert (lexicon(about=900, the=5000, horse=800).misread_at(word) is not None) == wrong


def test_split_is_no_suspended_hyphen():
    lex = lexicon(roughly=50)
    pages = ["both pre-\nand post-war\nwere rou-\n- 3 -", "ghly done\nx-\n\nYes\n- 4 -"]
    model = S.fit_lines([(["some words on a line\n" * 4 + f"- {n} -" for n in (1, 2)], None)] * 20)
    found, text = S.noisy_lines(pages, None, model, lex)
    assert {(p, i) for p, i, k in found if k == "split"} == {(1, 3)}
    assert "roughly done" in " ".join(text)


def test_roman_and_like():
    assert [S._roman(x) for x in ("iv", "ix", "xliv")] == [4, 9, 44]
    assert S._like("review of kudako", "rcview of kudako") and not S._like("review of kudako", "review of mirola")


def test_judgements_do_not_depend_on_how_many_words_are_held(spark, corpus, monkeypatch):
    rows = [(f"d{i}", None, p, "x", 1) for i, (p, _, _) in enumerate(corpus[:60])]
    rows += [(f"m{i}", None, ["a hovel and a bovel\n" * (4 if i < 8 else 0) + "we talk of a hovel\n" * 40], None, None) for i in range(10)]
    docs = S.documents(spark.createDataFrame(rows, KIND))
    got = []
    for _ in range(2):
        reader = S.fit(docs)
        monkeypatch.setattr(S, "WORD_SHARE", 60 / reader.total)  # from then on, words seen 60 times are held; "bovel" is seen 32 times
        got.append((len(reader.frequent), {tuple(x) for x in S.noise(reader).collect()}, {tuple(x) for x in S.paragraphs(reader).collect()}))
    assert got[1][0] < 0.5 * got[0][0]
    assert got[0][1:] == got[1][1:]


def test_like_lines_are_found_in_long_documents():
    r = random.Random(3)
    pages = [f"{'Rcview' if n == 7 else 'Review'} of Kudako\n{name(r)} {name(r)} {n}\nsome words on a line\n{name(r)} {name(r)} {name(r)}\nend {name(r)}" for n in range(200)]
    assert S.CODES[S.features(pages, None)[7][0]][2] == "3"
    lines = ["".join(r.choices("ab", k=r.randint(4, 12))) for _ in range(300)]
    seen = {x: {i} for i, x in enumerate(lines)}
    near = S._near(seen)
    for x in seen:
        want = set().union(*(seen[o] for o in seen if S._like(x, o)))
        assert near[x] <= want and min(len(near[x]), 3) == min(len(want), 3)


def test_misread_words_are_found_however_often_they_occur(spark):
    """The same ratio at ten times the size has the same verdict."""
    for times in (1, 10):
        rows = [("of the horse " * (50 * times), None)] + [("of the h0rse and a borse " * times, None)] * 2
        docs = S.documents(spark.createDataFrame([(f"d{i}", None, [t], "x", 1) for i, (t, _) in enumerate(rows)] , KIND))
        words = spark.createDataFrame([("horse", 50 * times), ("borse", 2 * times), ("h0rse", 2 * times), ("bone", 50 * times), ("hone", 49 * times)], "word string, n long")
        shapes = spark.createDataFrame([("a+", 153 * times), ("a9a+", 2 * times)], "shape string, n long")
        assert {(r.word, r.meant) for r in S.verdicts(words, shapes, 155 * times).collect()} == {("borse", "horse"), ("h0rse", "horse")}
        assert S.word_counts(docs).where("word = 'horse'").first().n == 50 * times


def test_decoding_many_pages_is_decoding_each():
    r = random.Random(7)
    pages = [S.np.array([r.choice([-1, *range(0, len(S.CODES), 37)]) for _ in range(r.randint(0, 40))], S.np.int64) for _ in range(200)]
    model = S._model(S._tally(pages, [S._GUESS[p] for p in pages]))
    together = model.decode(pages)
    for p, states in zip(pages, together):
        assert len(p) == len(states)
        if not len(p):
            continue
        score = model.start + model.emit[p[0]]
        back = []
        for c in p[1:]:
            ways = score[:, None] + model.step
            back.append(ways.argmax(0))
            score = ways.max(0) + model.emit[c]
        out = [int((score + model.end).argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        assert out[::-1] == states.tolist()


def test_tokens_that_are_no_words_are_left_alone(spark):
    """A page of one very long token, and words broken over lines that make one, end soon and have no noise."""
    blob = "aB3/x+c1l0rn" * 30_000
    rows = [("blob", None, [blob, f"{blob}-\n{blob} and more words"], "x", 1), ("line", None, ["word, " * 50_000 + "7"], "x", 1)]
    reader = S.fit(S.documents(spark.createDataFrame(rows, KIND)))
    assert {x.kind for x in S.noise(reader).collect()} <= {"split"}
    assert S.Lexicon({}, {}, 1).misread_at("a~" * 40) is None
