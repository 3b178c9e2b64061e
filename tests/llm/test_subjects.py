import random

import numpy as np
import pytest

from sedimark.llm import subjects as S

WORDS = {"law": "court clause verdict plaintiff statute tribunal appeal witness".split(), "food": "recipe oven dough menu kitchen harvest sauce butter".split(), "sport": "match coach relay sprint goal league medal stadium".split()}
FRAMES = ["The {0} was moved to the {1} by team {2}.", "Nobody expected the {0} after {1} in {2}.", "Without {0} the {1} cannot finish, said {2}."]


def sentence(r, subject):
    a, b = r.sample(WORDS[subject], 2)
    return r.choice(FRAMES).format(a, b, "".join(r.choice("bdklmnr") + r.choice("aeiou") for _ in range(3)))


def corpus(seed, n):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main, other = r.sample(list(WORDS), 2)
        plan = r.choice([[main] * 8, [main] * 4 + [other] * 4, [main] * 9 + [other]])
        r.shuffle(plan)
        docs.append((i, " ".join(sentence(r, s) for s in plan) + "\nNothing of note here.", "en", "clash"))
        truth[i] = {s for s in plan if plan.count(s) * 4 >= len(plan)}
    return docs, truth


DOC, LAB, SUB = "doc_id long, text string, lang string, subject string", "doc_id long, subject string, annotator string", "subject string, hint string"


@pytest.fixture(scope="module")
def found(spark):
    docs, truth = corpus(1, 400)
    odd = [(900, None, None, None), (901, "", "", None), (902, " \n ", "xx", None), (903, "@@@ ### 12", "en", None), (904, docs[0][1] * 200, "en", None)]
    r = random.Random(2)
    labels = [(i, r.choice(list(WORDS)) if r.random() < 0.05 else r.choice(sorted(truth[i])), "a") for i in range(0, 400, 4)] + [(0, "law", "b"), (None, "law", "b"), (1, None, "b"), (2, "unknown", "b")]
    hints = [("law", "law: court, clause"), ("food", None), ("sport", "sport: match")]
    model, occ = S.fit(spark.createDataFrame(docs + odd, DOC), spark.createDataFrame(labels, LAB), spark.createDataFrame(hints, SUB))
    got = {}
    for row in S.assign(model, occ).collect():
        got.setdefault(row.doc_id, set()).add(row.subject)
    return model, got, truth


def test_held_out_accuracy(found):
    _, got, truth = found
    held = [i for i in truth if i % 4]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.95 * len(held)


def test_empty_and_long_texts(found):
    _, got, truth = found
    assert not got.keys() & {900, 901, 902, 903}
    assert got[904] == truth[0]


def test_components_keep_their_anchors(found):
    model, _, _ = found
    for s, name in enumerate(model.subjects):
        best = np.argsort(-model.weights[s])[:8]
        names = {i: t for t, i in model.vocabulary.items()}
        assert {names[i] for i in best} == set(WORDS[name])


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], DOC), spark.createDataFrame([], LAB), spark.createDataFrame([], SUB)
    assert S.assign(*S.fit(*none)).count() == 0
    docs = spark.createDataFrame(corpus(3, 20)[0], DOC)
    assert S.assign(*S.fit(docs, none[1], none[2])).count() == 0
    S.assign(*S.fit(docs, none[1], spark.createDataFrame([("law", "law: court")], SUB))).count()


def test_terms_and_sentences():
    assert S.terms_of("実験とテストを確認した the api x".lower()) == ["実験", "と", "テスト", "を", "確認", "した", "the", "api"]
    assert S.terms_of("café ab élan".lower()) == ["café", "élan"]
    assert S.parts_of("abc def. ghi 04.06.2015 jkl! mno。pqr\nstu") == ["abc", "def", ".", "ghi", "jkl", "!", "mno", "。", "pqr", "\n", "stu"]
    assert S.parts_of("abc! def.ghi") == ["abc", "!", "def", "ghi"]
