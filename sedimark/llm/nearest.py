"""The most similar vectors of every vector.

Unit vectors are projected with Gaussian, that is 2-stable, matrices into few dimensions, where the
squared distance of two projections over that of the vectors is chi-square distributed. Each tree is
a kd-tree over projections of its own. Its upper levels are fitted on a bounded sample and place
every vector in a cell; the task that holds a cell splits it on by the cell's own vectors until no
leaf has more than ``LEAF``, so depth follows the data and the work per vector is the same at any size.

In a leaf a vector's neighbours are taken in the order of their projected distance until the
chi-square test holds: at the ``sure`` quantile, whatever is left is further than the least similarity
allows, or than the vector's k-th neighbour. What comes before that is verified on the vectors
themselves. Trees are searched in two rounds: in the first nothing is verified yet, and the k-th
neighbour's distance is bounded by its projection; the second one stops at the verified distance of
the k-th neighbour that the first has found, and verifies only what is new.

Equal vectors are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimark.operators.skew import join_unique
from sedimark.storage_paths import written

#: Vectors on which the trees of all groups are fitted, at most (about, as they are drawn by their hash), and for each leaf.
SAMPLE, PER_LEAF = 16_384, 16
#: Vectors that a leaf holds at most.
LEAF = 1024
#: Trees that are searched before the k-th neighbours are known.
FIRST = 4
#: A group has upper levels of its own if it has this part of all vectors at least; smaller ones are split in one task.
GROUP_SHARE = 1 / 4096
#: Dimensions of the projections that the chi-square test uses.
TEST_DIMS = 64
#: Projected coordinates are kept as whole steps of this size.
STEP = 1 / 24
#: Coordinates of which a task may choose one to split a cell by.
CHOICES = 8


def chi_square(q: float, dims: int) -> float:
    """The quantile q of the chi-square distribution, by Wilson and Hilferty."""
    lo, hi = -9.0, 9.0
    for _ in range(80):
        z = (lo + hi) / 2
        lo, hi = (z, hi) if 0.5 * math.erfc(-z / math.sqrt(2)) < q else (lo, z)
    return dims * (1 - 2 / (9 * dims) + z * math.sqrt(2 / (9 * dims))) ** 3


@dataclass
class Forest:
    """Upper levels of trees over the projections of vectors with one dimension; tree t splits at node n by axis[t, n] at cut[t, n]."""

    test: np.ndarray
    axes: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, trees: int, seed: int) -> Forest:
        dim = sample.shape[1]
        r = np.random.default_rng([seed, dim])
        depth = max(0, min(math.ceil(math.log2(max(1, rows / LEAF))), int(math.log2(max(1, len(sample) / 8)))))
        width = depth + 2
        test, axes = r.standard_normal((dim, TEST_DIMS)).astype(np.float32), r.standard_normal((dim, trees * width)).astype(np.float32)
        p = (sample @ axes).reshape(len(sample), trees, width)
        axis, cut = np.zeros((trees, 1 << depth), np.int32), np.zeros((trees, 1 << depth), np.float32)
        for t in range(trees):
            nodes = {1: np.arange(len(sample))}
            for _ in range(depth):
                below: dict[int, np.ndarray] = {}
                for n, at in nodes.items():
                    own = p[at, t]
                    a = int(np.argmax(own.std(0))) if len(at) > 1 else n % width
                    c = float(np.median(own[:, a])) if len(at) else 0.0
                    axis[t, n], cut[t, n] = a, c
                    right = own[:, a] > c
                    below[2 * n], below[2 * n + 1] = at[~right], at[right]
                nodes = below
        return cls(test, axes, axis, cut, depth)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector in each tree, and its coordinates for the test, in steps."""
        trees = len(self.axis)
        p = (unit @ self.axes).reshape(len(unit), trees, -1)
        node = np.ones((len(unit), trees), np.int64)
        rows, ts = np.arange(len(unit))[:, None], np.arange(trees)[None, :]
        for _ in range(self.depth):
            node = 2 * node + (p[rows, ts, self.axis[ts, node]] > self.cut[ts, node])
        return node, np.clip(np.rint(unit @ self.test / STEP), -127, 127).astype(np.int8)


def leaves(points: np.ndarray, tree: int, most: int) -> list[np.ndarray]:
    """The lower levels of a tree over the coordinates of a cell: positions by leaf, of at most ``most`` each.

    A node is halved at the median of the widest of a few coordinates, which differ from tree to
    tree; vectors that lie on the median go to either side, so no number of equal values stops it.
    """
    out, stack = [], [(np.arange(len(points)), 1)]
    while stack:
        at, node = stack.pop()
        if len(at) <= most:
            out.append(at)
            continue
        some = np.random.default_rng([tree, node % (1 << 62)]).choice(points.shape[1], CHOICES, replace=False)
        own = points[np.ix_(at, some)]
        order = np.argpartition(own[:, int(np.argmax(own.std(0)))], len(at) // 2)
        stack += [(at[order[: len(at) // 2]], 2 * node), (at[order[len(at) // 2 :]], 2 * node + 1)]
    return out


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list array one after the other, missing ones as NaN, and the lengths (-1 for null)."""
    lengths = np.where(np.asarray(lists.is_valid()), np.diff(lists.offsets.to_numpy()), -1)
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False), lengths


def unit_vectors(rows: DataFrame, key: str, vector: str, model: str, dimension: str) -> DataFrame:
    """(cls, grp, id, unit): the usable vectors at unit length; grp is for model and dimension, cls for the vector in it.

    Usable: not null, of the stated dimension, above 0, without NaN, infinity or missing values, not all zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = _matrix(b.column(1))
            dims = np.array([-2 if d is None else d for d in b.column(3).to_pylist()], np.int64)
            models = b.column(2).to_pylist()
            starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]).astype(np.int64)
            for d in set(dims.tolist()):
                at = np.flatnonzero((dims == d) & (lengths == d)) if d > 0 else []
                if not len(at):
                    continue
                x = flat[starts[at][:, None] + np.arange(d)].astype(np.float64)
                size = np.abs(x).max(1)
                ok = np.isfinite(x).all(1) & (size > 0)
                at, x, size = at[ok], x[ok], size[ok]
                if not len(at):
                    continue
                x /= size[:, None]
                x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
                grp = [f"{d}:{'' if models[i] is None else models[i]}" if models[i] is not None else f"{d}" for i in at]
                names = {g: blake2b(g.encode("utf-8", "surrogatepass")).digest() for g in set(grp)}
                cls = np.frombuffer(b"".join(blake2b(v.tobytes(), digest_size=8, key=names[g]).digest() for v, g in zip(x, grp)), np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * d + 1, d, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(grp, pa.string()), b.column(0).take(pa.array(at)), values], names=["cls", "grp", "id", "unit"])

    picked = rows.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.col(model).cast("string").alias("m"), F.col(dimension).cast("long").alias("d"))
    return picked.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.col("d") > 0)).mapInArrow(run, "cls long, grp string, id string, unit array<float>")


def _forests(vectors: DataFrame, trees: int, seed: int) -> dict[str, Forest]:
    """The upper levels of each large group's trees."""
    sizes = vectors.groupBy("grp").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    large = {r[0]: r[1] for r in sizes.where(F.col("count") > max(LEAF, total * GROUP_SHARE)).collect()}
    if not large:
        return {}
    share = min(PER_LEAF / LEAF, SAMPLE / sum(large.values()))
    sample = vectors.where(F.col("grp").isin(list(large)) & (F.pmod(F.xxhash64("cls"), F.lit(1_000_003)) < int(share * 1_000_003))).select("grp", "unit").toArrow()
    groups = np.array(sample.column("grp").to_pylist())
    forests = {}
    for g, n in large.items():
        own = sample.column("unit").take(np.flatnonzero(groups == g)).combine_chunks()
        x = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), int(g.split(":")[0]))
        forests[g] = Forest.fit(x, n, trees, seed)
    return forests


def _placed(vectors: DataFrame, forests: dict[str, Forest], trees: int, seed: int) -> DataFrame:
    """(cls, g, cells, point): each vector's cell in every tree, within its group g, and its coordinates for the test."""
    shared = vectors.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: dict[int, Forest] = {}
        for b in batches:
            groups = np.array(b.column(1).to_pylist())
            for g in sorted(set(groups.tolist())):
                dim = int(g.split(":")[0])
                if (forest := shared.value.get(g)) is None:
                    if dim not in small:
                        small[dim] = Forest.fit(np.zeros((0, dim), np.float32), 0, trees, seed)
                    forest = small[dim]
                at = np.flatnonzero(groups == g)
                own = b.column(2).take(pa.array(at))
                node, point = forest.place(own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
                cell = (np.arange(trees, dtype=np.int64)[None, :] << 32) | node
                name = int.from_bytes(blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * trees + 1, trees, dtype=np.int32)), pa.array(cell.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), name)), lists, pa.array([p.tobytes() for p in point], pa.binary())], names=["cls", "g", "cells", "point"])

    return vectors.select("cls", "grp", "unit").mapInArrow(run, "cls long, g long, cells array<long>, point binary")


def passed(points: np.ndarray, far: np.ndarray, k: int, limit: float, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a leaf that come before either one's search stops: at ``far``, or if that is NaN at ``spread`` times the projected k-th neighbour's distance; at ``limit`` in any case."""
    n = len(points)
    square = (points * points).sum(1)
    d = square[:, None] + square[None, :] - 2 * (points @ points.T)
    np.fill_diagonal(d, np.inf)
    stop = np.where(np.isnan(far), limit, np.minimum(far, limit)).astype(d.dtype)
    many = np.flatnonzero(np.isnan(far) & ((d <= limit).sum(1) > k))
    if len(many):
        stop[many] = np.minimum(limit, spread * np.maximum(np.partition(d[many], k - 1, axis=1)[:, k - 1], 1e-3))
    i, j = np.nonzero(d <= stop[:, None])
    flat = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    return flat // n, flat % n


def _searched(rows: DataFrame, k: int, limit: float, spread: float) -> DataFrame:
    """(cls_a, cls_b), each once: the pairs to verify of ``rows`` (g, cell, cls, point, far). A task holds one cell at a time."""
    most = LEAF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def searched() -> Iterator[pa.RecordBatch]:
            cls, far = (np.concatenate([h[n] for h in held]) for n in (1, 2))
            points = np.concatenate([h[3] for h in held])
            for at in leaves(points, int(held[0][0][1]) >> 32, most):
                i, j = passed(points[at].astype(np.float32), far[at], k, limit, spread)
                if len(i):
                    a, b = cls[at[i]], cls[at[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["cls_a", "cls_b"])

        for b in batches:
            if not b.num_rows:
                continue
            g, cell, cls = (b.column(n).to_numpy() for n in range(3))
            point = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int8).reshape(-1, TEST_DIMS)
            far = b.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            edges = np.concatenate([[0], np.flatnonzero((np.diff(g) != 0) | (np.diff(cell) != 0)) + 1, [len(cell)]])
            for s, e in zip(edges[:-1], edges[1:]):
                name = (g[s], cell[s])
                if held and held[0][0] != name:
                    yield from searched()
                    held = []
                held.append((name, cls[s:e], far[s:e], point[s:e]))
        if held:
            yield from searched()

    together = rows.select("g", "cell", "cls", "point", "far").repartition(F.col("g"), F.col("cell")).sortWithinPartitions("g", "cell")
    return together.mapInArrow(run, "cls_a long, cls_b long").where(F.col("cls_a") != F.col("cls_b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b"), "similarity"))


def close_pairs(vectors: DataFrame, k: int, min_similarity: float, trees: int = 12, sure: float = 0.995, seed: int = 11) -> DataFrame:
    """(cls_a, cls_b, similarity): verified pairs, each once, that hold the ``k`` nearest of each vector. ``vectors``: (cls, grp, unit), each class once."""
    placed = written(_placed(vectors, _forests(vectors, trees, seed), trees, seed), "placed")
    # rounding moves each coordinate's difference by a step at most, typically by 0.4
    scale = chi_square(sure, TEST_DIMS) * 1.02 / STEP**2
    limit, spread = scale * (2 - 2 * min_similarity), chi_square(sure, TEST_DIMS) / chi_square(1 - sure, TEST_DIMS)
    first = min(FIRST, trees)
    cells = lambda df, start, n: df.select("g", "cls", "point", "far", F.explode(F.slice("cells", start + 1, max(1, n))).alias("cell"))
    tried = written(_searched(cells(placed.withColumn("far", F.lit(None).cast("double")), 0, first), k, limit, spread), "passed")
    close = written(similarities(tried, vectors, min_similarity), "close")
    if first == trees:
        return close
    ranked = both_ways(close).withColumn("n", F.row_number().over(W.partitionBy("cls_a").orderBy(F.desc("similarity"), F.asc("cls_b"))))
    # the k-th neighbour's verified distance; a little more, as it is rounded, too
    kth = ranked.where(F.col("n") <= k).groupBy("cls_a").agg(F.count("*").alias("n"), F.min("similarity").alias("s")).where(F.col("n") == k)
    far = kth.select(F.col("cls_a").alias("cls"), (F.lit(scale) * (F.lit(2.0) - 2 * F.col("s") + 1e-6) + TEST_DIMS / 6).alias("far"))
    more = _searched(cells(placed.join(far, "cls", "left"), first, trees - first), k, limit, spread)
    new = written(more.join(tried, ["cls_a", "cls_b"], "left_anti"), "passed-later")
    return close.unionByName(written(similarities(new, vectors, min_similarity), "close-later"))


def similarities(pairs: DataFrame, vectors: DataFrame, min_similarity: float) -> DataFrame:
    """(cls_a, cls_b, similarity) of the pairs whose cosine is at least ``min_similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(2).offsets.to_numpy())
            x, y = (b.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for n in (2, 3))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            s = np.bincount(owner, x * y, minlength=len(lengths)) / np.sqrt(np.bincount(owner, x * x, minlength=len(lengths)) * np.bincount(owner, y * y, minlength=len(lengths)))
            at = pa.array(np.flatnonzero(s >= min_similarity))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s[s >= min_similarity])], names=["cls_a", "cls_b", "similarity"])

    left, right = vectors.select(F.col("cls").alias("cls_a"), F.col("unit").alias("x")), vectors.select(F.col("cls").alias("cls_b"), F.col("unit").alias("y"))
    return pairs.join(left, "cls_a").join(right, "cls_b").select("cls_a", "cls_b", "x", "y").mapInArrow(run, "cls_a long, cls_b long, similarity double")


def nearest(rows: DataFrame, key: str = "chunk_id", vector: str = "embedding", model: str = "model", dimension: str = "dimension", k: int = 5, min_similarity: float = 0.8, trees: int = 12, sure: float = 0.995) -> DataFrame:
    """(id, other, similarity): the up to ``k`` most similar other keys of each key with at least ``min_similarity``.

    Only vectors of the same model and dimension are compared; a null model is one of its own.
    Unusable vectors (see ``unit_vectors``) and null keys have no row and are nobody's neighbour.
    Repeated rows count once; of a key with several vectors each counts, its best similarity stands.
    Of others that tie, the smaller keys come first. Empty input gives an empty result. The members
    of a class with a large part of all rows stay where they are.
    """
    every = written(unit_vectors(rows, key, vector, model, dimension), "units")
    members = every.select("cls", "id").distinct()
    vectors = written(every.groupBy("cls").agg(F.first("grp").alias("grp"), F.first("unit").alias("unit")), "vectors")
    close = both_ways(close_pairs(vectors, k, min_similarity, trees, sure))
    # of each class only the k + 1 smallest keys can be among anyone's k first others
    first = members.withColumn("n", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(F.col("n") <= k + 1).select("cls", "id")
    own = first.select("cls", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    met = close.join(first.withColumnsRenamed({"cls": "cls_b", "id": "other"}), "cls_b").select(F.col("cls_a").alias("cls"), "other", "similarity")
    lists = own.unionByName(met).groupBy("cls", "other").agg(F.max("similarity").alias("similarity"))
    order = [F.desc("similarity"), F.asc("other")]
    lists = lists.withColumn("n", F.row_number().over(W.partitionBy("cls").orderBy(*order))).where(F.col("n") <= k + 1)
    lists = lists.groupBy("cls").agg(F.collect_list(F.struct("other", "similarity")).alias("others"))
    found = join_unique(members, lists, "cls", "inner").select("id", F.inline("others")).where(F.col("id") != F.col("other")).groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return found.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(*order))).where(F.col("n") <= k).drop("n")
