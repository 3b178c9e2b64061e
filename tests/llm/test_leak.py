import random

import numpy as np

from sedimark.llm.leak import TestSuffixes, find_leaks, suffix_array, without_leaks, words_of


def test_suffix_array():
    r = random.Random(1)
    for n in (1, 2, 5, 60, 300):
        t = np.array([r.randint(0, 3) for _ in range(n)])
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def brute(docs, items, least):
    out = {}
    for d, a in docs:
        a = words_of((a or "").lower())
        for i, b in items:
            b = words_of((b or "").lower())
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[d, i] = best
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(i, text(r.randint(0, 30))) for i in range(12)]
    docs = [(i, text(r.randint(0, 60)) + " ZZ " + text(9)) for i in range(60)]
    docs += [(100, items[0][1].upper().replace(" ", "-\n")), (101, None), (102, ""), (103, "x " * 5000 + items[1][1])]
    items += [(50, None), (51, "")]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=6)
    assert {(x.doc_id, x.item_id): x.words for x in got.collect()} == brute(docs, items, 6)
    left = without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), got)
    assert left.count() == len(docs) - len({d for d, _ in brute(docs, items, 6)})


def test_blocks_of_tests(spark, monkeypatch):
    monkeypatch.setattr("sedimark.llm.leak.BLOCK_WORDS", 10)
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "so " + passage + " end"), (2, passage[:-4])], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"q{i} {passage} {i}") for i in range(9)], "item_id long, text string")
    assert {tuple(x) for x in find_leaks(docs, items).collect()} == {(1, i, 12, 1) for i in range(9)}


def test_passage_in_every_document_is_laid_out_in_pieces(monkeypatch):
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [f"{'x ' * (n % 5)}{passage} {n} {passage}" for n in range(50)]
    tests = TestSuffixes([(i, f"{passage} {i}") for i in range(30)], 12)
    whole = [x.tolist() for x in tests.matches(texts)]
    monkeypatch.setattr("sedimark.llm.leak.PIECE", 64)
    assert [x.tolist() for x in tests.matches(texts)] == whole and len(whole[0]) == 50 * 30
    # item n goes on with its number, so document n has one word more
    assert {(d, i, n) for d, i, n in zip(*whole[:3]) if n > 20} == {(i, i, 21) for i in range(30)}
    assert all(p == d % 5 for d, p in zip(whole[0], whole[3]))


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(docs, spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")).count() == 0
