import random

from sedimark.llm.rank import leximin_top, supports

S = ["a", "b", "c"]
KIND = "q long, x string, a float, b float, c double, place string"


def brute(rows, k):
    out = []
    for q in {r[0] for r in rows}:
        items = {}
        for r in rows:
            if r[0] == q and r[1] is not None:
                old = items.setdefault(r[1], [None] * 3)
                for i in range(3):
                    v = r[2 + i]
                    if v is not None and v == v and (old[i] is None or v > old[i]):
                        old[i] = v
        sup = {x: [0 if v[i] is None else len(items) - sum(o[i] is not None and o[i] > v[i] for o in items.values()) for i in range(3)] for x, v in items.items()}
        order = sorted(sup, key=lambda x: ([-p for p in sorted(sup[x])], x))
        out += [(q, x, n + 1, sup[x]) for n, x in enumerate(order[:k])]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(4)
    pick = lambda: r.choice([None, float("nan"), 0.0, 1.0, -3.0, 1e30, float(r.randint(0, 50))])
    rows = [(r.choice([1, 2, None]), r.choice([None, *"abcdefghijklmnop"]), pick(), pick(), pick(), "clash") for _ in range(90)]
    rows += rows[:5] + [(7, "only", None, None, None, None)]
    got = leximin_top(spark.createDataFrame(rows, KIND), "q", "x", S, 4)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows, 4)


def test_large_groups_are_ranked_apart_alike(spark, monkeypatch):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 2, None, None]), f"i{i}", r.choice([None, 1.0, float(r.randint(0, 30))]), float("nan") if r.random() < 0.3 else r.random(), 5.0, None) for i in range(300)]
    df = spark.createDataFrame(rows, KIND)
    whole = sorted((tuple(x) for x in leximin_top(df, "q", "x", S, 9).collect()), key=repr)
    monkeypatch.setattr("sedimark.llm.rank.LARGE", 60)
    assert sorted((tuple(x) for x in leximin_top(df, "q", "x", S, 9).collect()), key=repr) == whole == brute(rows, 9)


def test_large_group_and_ties(spark, monkeypatch):
    monkeypatch.setattr("sedimark.llm.rank.LARGE", 1000)
    rows = [(1, f"i{i:04d}", float(i % 7), float(i), 5.0, None) for i in range(3000)]
    got = {(x.x): x.supports for x in supports(spark.createDataFrame(rows, KIND), "q", "x", S).collect()}
    assert got["i2999"] == [sum(i % 7 <= 2999 % 7 for i in range(3000)), 3000, 3000]
    assert len(got) == 3000


def test_scale_of_a_score_does_not_matter(spark):
    rows = [(1, "wide", 1000.0, 0.1, 0.1, None), (1, "even", 2.0, 0.2, 0.2, None), (1, "low", 1.0, 0.3, 0.05, None)]
    assert [x.x for x in leximin_top(spark.createDataFrame(rows, KIND), "q", "x", S, 1).collect()] == ["even"]


def test_empty(spark):
    assert leximin_top(spark.createDataFrame([], KIND), "q", "x", S, 5).count() == 0
