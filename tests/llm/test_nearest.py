import random

import numpy as np
import pytest

from sedimark.llm import nearest as N

KIND = "chunk_id string, embedding array<float>, model string, dimension long, cls string, id string"


def brute(rows, k, least):
    vs = []
    for key, v, m, d, *_ in rows:
        if key is None or v is None or d is None or d <= 0 or len(v) != d or any(x is None or x != x or abs(x) == float("inf") for x in v) or not any(v):
            continue
        x = np.array(np.float32(v), np.float64)
        vs.append((key, m, d, x / np.linalg.norm(x)))
    best = {}
    for a, m, d, x in vs:
        for b, n, e, y in vs:
            if a != b and (m, d) == (n, e) and x @ y >= least:
                best[a, b] = max(best.get((a, b), -1), float(x @ y))
    out = set()
    for a in {a for a, _ in best}:
        mine = sorted(((-round(s, 6), b) for (c, b), s in best.items() if c == a))
        out |= {(a, b) for _, b in mine[:k]}
    return out


def cloud(seed, families, dim, model):
    r = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        c = r.standard_normal(dim)
        for j in range(int(r.integers(1, 5))):
            v = c + r.standard_normal(dim) * r.choice([0.05, 0.2, 0.4])
            rows.append((f"{model}{f}.{j}", [float(x) for x in np.float32(v * r.choice([1, 3]))], model, dim, "x", "y"))
    return rows


def found(spark, rows, **kw):
    return {(r.id, r.other) for r in N.nearest(spark.createDataFrame(rows, KIND), **kw).collect()}


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 32)
    rows = cloud(1, 150, 24, "s") + cloud(2, 100, 40, "l")
    want = brute(rows, 3, 0.8)
    got = found(spark, rows, k=3)
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)


def test_one_leaf_loses_nothing(spark):
    rows = cloud(3, 120, 16, "s") + cloud(4, 40, 8, "t")
    assert found(spark, rows) == brute(rows, 5, 0.8)


def test_cells_are_split_by_their_own_vectors(spark, monkeypatch):
    """Upper levels that no sample reaches: all the depth comes from the tasks."""
    monkeypatch.setattr(N, "LEAF", 48)
    monkeypatch.setattr(N, "GROUP_SHARE", 2.0)
    rows = cloud(5, 200, 24, "s")
    want, got = brute(rows, 3, 0.8), found(spark, rows, k=3)
    assert len(got & want) >= 0.9 * len(want)


def test_leaves_hold_every_vector_once_whatever_ties():
    r = np.random.default_rng(2)
    for points in (r.integers(-127, 127, (1000, N.TEST_DIMS)), np.zeros((1000, N.TEST_DIMS))):
        got = N.leaves(points.astype(np.int8), 3, 40)
        assert max(map(len, got)) <= 40 and sorted(np.concatenate(got).tolist()) == list(range(1000))


def test_search_stops_at_the_verified_neighbour():
    r = np.random.default_rng(3)
    points = r.standard_normal((60, N.TEST_DIMS)).astype(np.float32) * 20
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    far = np.full(60, np.nan)
    far[:30] = np.sort(d[:30], axis=1)[:, 2] * 1.0001  # two neighbours each
    i, j = N.passed(points, far, 3, float(np.median(d)), 1.0)
    got = set(zip(i.tolist(), j.tolist()))
    for a in range(30):
        for b in np.argsort(d[a])[1:3]:
            assert (min(a, b), max(a, b)) in got or d[a, b] > np.median(d)
    only = {(a, b) for a, b in got if a < 30 and b < 30}
    assert all(d[a, b] <= max(far[a], far[b]) * 1.001 for a, b in only)


def test_dense_cluster(spark, monkeypatch):
    r = np.random.default_rng(9)
    centre = r.standard_normal(24)
    rows = [(f"d{i:03d}", [float(x) for x in np.float32(centre + 0.2 * r.standard_normal(24))], "m", 24, None, None) for i in range(400)]
    want = brute(rows, 5, 0.8)
    assert found(spark, rows) == want
    monkeypatch.setattr(N, "LEAF", 100)
    assert len(found(spark, rows) & want) >= 0.9 * len(want)


def test_models_with_long_names_stay_apart(spark):
    name = "m" * 100
    rows = [("a", [1.0, 2.0], name + "1", 2, None, None), ("b", [1.0, 2.0], name + "2", 2, None, None), ("c", [1.0, 2.0], name + "2", 2, None, None)]
    assert found(spark, rows) == {("b", "c"), ("c", "b")}


def test_unusable_and_repeated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", [1.0, 0.0], "m", 2, None, None), ("b", [2.0, 0.1], "m", 2, None, None), ("b", [2.0, 0.1], "m", 2, None, None), ("c", [1.0, 0.0], "other", 2, None, None),
        ("d", [1.0, 0.0], "m", 3, None, None), ("e", None, "m", 2, None, None), ("f", [], "m", 0, None, None), ("g", [0.0, 0.0], "m", 2, None, None), ("h", [1.0, nan], "m", 2, None, None),
        ("i", [1.0, None], "m", 2, None, None), ("j", [1.0, inf], "m", 2, None, None), ("k", [1.0, 0.0], "m", None, None, None), (None, [1.0, 0.0], "m", 2, None, None), ("n", [1.0, 0.0], None, 2, None, None), ("o", [1.0, 0.0], None, 2, None, None),
    ]
    assert found(spark, rows) == {("a", "b"), ("b", "a"), ("n", "o"), ("o", "n")}
    assert found(spark, []) == set()


def test_ties_of_many_copies(spark):
    rows = [(f"c{i:02d}", [1.0, 2.0, 3.0], "m", 3, None, None) for i in range(30)]
    assert found(spark, rows, k=2) == brute(rows, 2, 0.8)


def test_chi_square_quantiles():
    # published table values
    for q, dims, want in ((0.95, 10, 18.307), (0.995, 32, 56.328), (0.005, 32, 15.134), (0.5, 6, 5.348)):
        assert N.chi_square(q, dims) == pytest.approx(want, rel=0.01)


def test_projected_distances_are_chi_square():
    r = np.random.default_rng(7)
    x, y = (v / np.linalg.norm(v) for v in r.standard_normal((2, 50)))
    d = np.array([((x - y) @ np.random.default_rng(s).standard_normal((50, 32))) ** 2 for s in range(400)]).sum(1) / ((x - y) ** 2).sum()
    assert abs((d <= N.chi_square(0.9, 32)).mean() - 0.9) < 0.05
