import random

import numpy as np

from sedimark.llm.leak import words_of
from sedimark.llm.neardup import SLOTS, WORD_SLOTS, Shingles, allocate, duplicate_pairs, lookups, near_duplicates, shingle_sets

KIND = "chunk_id string, content string, cls string"


def brute(rows, size, similarity, least):
    sets = []
    for k, t in rows:
        w = words_of((t or "").lower())
        if k is not None and len(w) >= max(least, size):
            sets.append((k, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}))
    return {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and len(x & y) >= similarity * len(x | y)}


def found(spark, rows, **kw):
    members, pairs = near_duplicates(spark.createDataFrame([(a, b, "c") for a, b in rows], KIND), **kw)
    return {tuple(r) for r in duplicate_pairs(members, pairs).collect()}


def corpus(seed, n):
    r = random.Random(seed)
    common = ["the report of the day was filed under number", "nobody expected that it would depend on the draft"]
    rows = []
    for i in range(n):
        words = " ".join(r.choice(common) + f" {r.randint(0, 10**6)} {r.choice('abcdefg')}" for _ in range(6)).split()
        rows.append((f"k{i}", " ".join(words)))
        for j in range(r.randint(0, 2)):
            w = list(words)
            for _ in range(r.randint(0, 8)):
                at = r.randrange(len(w))
                r.choice([lambda: w.insert(at, "new"), lambda: w.pop(at), lambda: w.__setitem__(at, "other")])()
            rows.append((f"k{i}.{j}", " ".join(w)))
    return rows


def test_no_link_is_lost(spark):
    rows = corpus(1, 60) + [("copy", "A  B"), ("null", None), ("empty", ""), (None, "x y z " * 20), ("one", "x y z " * 20), ("two", "X, y; Z. " * 20), ("two", "X, y; Z. " * 20), ("long", "p q r s " * 20_000)]
    for size, similarity, least in ((3, 0.5, 40), (5, 0.8, 0), (3, 0.65, 10)):
        want = brute(rows, size, similarity, least)
        assert found(spark, rows, size=size, similarity=similarity, least=least) == want
        assert ("one", "two") in want


def test_copies_are_one_class(spark):
    rows = [(f"c{i}", "same words in every one of these texts here") for i in range(40)]
    members, pairs = near_duplicates(spark.createDataFrame([(a, b, None) for a, b in rows], KIND))
    assert members.select("cls").distinct().count() == 1 and members.count() == 40 and pairs.count() == 0


def test_blocks_of_a_large_class_lose_no_pair(spark, monkeypatch):
    rows = [(f"c{i:02d}", "the same words in each of these many copies") for i in range(23)] + [("z", "the same words in each of these many copies here")]
    whole = found(spark, rows)
    monkeypatch.setattr("sedimark.llm.neardup.BLOCK", 4)
    assert found(spark, rows) == whole == brute(rows, 5, 0.8, 0) and len(whole) == 24 * 23 // 2


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [("a", "too short"), ("b", None)]) == set()


def _best(cost, part, most, wanted):
    best = {0: 0.0}
    for p in np.unique(part):
        c = np.concatenate([[0], np.minimum(np.cumsum(np.sort(cost[part == p])), most[part == p][0])])
        best = {u: min(best[u - k] + c[k] for k in range(len(c)) if u - k in best) for u in range(wanted + 1) if any(u - k in best for k in range(len(c)))}
    return best[wanted]


def _allocated(r, rows):
    row = np.repeat(np.arange(rows), r.integers(0, 30, rows))
    part, price = r.integers(0, 7, len(row)).astype(np.uint64), r.integers(1, 300, 7)
    cost, most = r.integers(0, 100, len(row)).astype(float), price[part.astype(int)].astype(float)
    wanted = np.array([r.integers(1, n + 1) if n else 0 for n in np.bincount(row, minlength=rows)])
    at = allocate(row, part, cost, most, wanted)
    for w in range(rows):
        own, mine = np.flatnonzero(row == w), at[row[at] == w]
        assert len(mine) == len(set(mine.tolist())) == wanted[w]
        spent = sum(min(cost[mine[part[mine] == p]].sum(), price[int(p)]) for p in set(part[mine]))
        yield spent, _best(cost[own], part[own], most[own], wanted[w]) if wanted[w] else 0.0


def test_allocation_is_of_least_cost():
    r = np.random.default_rng(5)
    for _ in range(20):
        assert all(abs(a - b) < 1e-6 for a, b in _allocated(r, 5))


def test_allocation_over_several_programmes(monkeypatch):
    monkeypatch.setattr("sedimark.llm.neardup.PROGRAMME", 6)
    r = np.random.default_rng(6)
    spent = [x for _ in range(20) for x in _allocated(r, 5)]
    assert sum(a for a, _ in spent) <= 1.1 * sum(b for _, b in spent)


def test_thresholds_are_unequal_and_partitions_are_words():
    texts = [f"the board of the day met for the {a} {b} report of the board of the day" for a, b in (("amber", "heron"), ("amber", "otter"), ("violet", "lynx"))]
    own = Shingles(texts, 3, 0)
    table = np.zeros(SLOTS + WORD_SLOTS, np.uint8)
    slots, n = np.unique(own.slots(), return_counts=True)
    table[slots] = 1 + np.floor(6 * np.log2(n))
    part, records = own.partitions(table)
    of = lambda w: part[(own.row == 0) & (records == w)]
    assert len(set(of(1.0))) == 1 and len(of(1.0)) == 3  # the three shingles with heron
    assert len(of(2.0)) == 1  # amber without heron
    found = lookups(np.arange(3), own, table, 0.5, 50_000)
    assert not set(found["bit"][found["cls"] == 0]) & set(own.shingle[(own.row == 0)][records[own.row == 0] == 1.0].tolist())


def test_bit_of_all_records_is_not_looked_up():
    texts = ["the same three words " + " ".join(f"w{i}x{j % (3 + i % 5)}" for j in range(12)) for i in range(300)]
    own = Shingles(texts, 3, 0)
    table = np.zeros(SLOTS + WORD_SLOTS, np.uint8)
    slots, n = np.unique(own.slots(), return_counts=True)
    table[slots] = 1 + np.floor(6 * np.log2(n))
    found = lookups(np.arange(300), own, table, 0.5, 50_000)
    bits, times = np.unique(found["bit"], return_counts=True)
    hot = bits[times >= 300]
    assert len(hot) and not np.isin(found["bit"][found["need"] > 0], hot).any()


def test_blocks_of_a_hot_bit_lose_no_pair(spark, monkeypatch):
    rows = corpus(3, 40)
    whole = found(spark, rows, size=3, similarity=0.5, least=0)
    monkeypatch.setattr("sedimark.llm.neardup.HOT", 3)
    assert found(spark, rows, size=3, similarity=0.5, least=0) == whole == brute(rows, 3, 0.5, 0)


def test_shingles_stay_within_rows():
    row, s, count = shingle_sets(["a b c", "d e", "a b c d", None], 3, 0)
    assert row.tolist() == [0, 2, 2] and count.tolist() == [3, 2, 4, 0]
    assert s[0] in s[1:].tolist()
