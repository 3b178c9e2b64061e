"""One ranking from several differently-scaled scores, by leximin.

A score counts only by the number of a query's candidates that it is not below, so scales and
outliers have no say. Each item's supports are sorted ascending and compared lexicographically: the
item whose weakest support is strongest comes first, and a strong score can't make up for a weak one.

The candidates of a query meet in one task, which ranks them by each score in turn, as long as they
are at most ``LARGE``. Those of larger queries are ranked without ever meeting: from the distinct
values of each score with their numbers of rows, cut into buckets at approximate quantiles, so the rows
in higher buckets are a sum over few counts and only the values of one bucket are sorted together.
Both ways give the same supports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimark.storage_paths import written

#: Candidates of a query that meet in one task.
LARGE = 100_000
#: Quantiles at which the values of a score are cut.
CUTS = 64
#: Parts that the rows of one value are spread over.
PARTS = 16


def supports(rows: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(group, item, supports): for each score how many of the group's candidates aren't above this one; 0 for null and NaN.

    Repeated rows count once. Where rows of an item differ in a score, its greatest value counts.
    """
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(f"s{i}") for i, s in enumerate(scores)]
    items = written(rows.groupBy(F.col(group).alias("g"), F.col(item).alias("x")).agg(*clean), "items")
    large = written(items.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("total")).where(F.col("total") > LARGE), "large-groups")
    if large.isEmpty():
        found = _together(items, len(scores))
    else:
        is_large = F.col("g").eqNullSafe(F.col("_g"))
        found = _together(items.join(large, is_large, "left_anti"), len(scores)).unionByName(_apart(items.join(large, is_large, "left_semi"), len(scores)))
    return found.select(F.col("g").alias(group), F.col("x").alias(item), "supports")


def _together(items: DataFrame, n: int) -> DataFrame:
    """(g, x, supports), all items of a group in one task: one shuffle for the ranks by every score."""
    every = W.partitionBy("g")
    rank = lambda i: F.rank().over(every.orderBy(F.col(f"s{i}").desc_nulls_last()))
    parts = [F.when(F.col(f"s{i}").isNull(), F.lit(0)).otherwise(F.count("*").over(every) - rank(i) + 1) for i in range(n)]
    return items.select("g", "x", F.array(*[p.cast("long") for p in parts]).alias("supports"))


def _apart(items: DataFrame, n: int) -> DataFrame:
    """(g, x, supports), however many items a group has."""
    items = written(items, "large-items")
    long = items.select("g", "x", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(f"s{i}").alias("v")) for i in range(n)])).alias("e")).select("g", "x", "e.which", "e.v")
    values = written(long.where(F.col("v").isNotNull()).groupBy("g", "which", "v").agg(F.count("*").alias("n")), "values")
    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    cuts = values.groupBy("g", "which").agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], CUTS * 10).alias("cuts"))
    # one row a large group and score
    placed = values.alias("a").join(F.broadcast(cuts.alias("b")), same("g", "g") & (F.col("a.which") == F.col("b.which"))).select("a.g", "a.which", "v", "n", F.size(F.filter("cuts", lambda c: c > F.col("v"))).alias("bucket"))
    placed = written(placed, "placed")
    sizes = placed.groupBy("g", "which", "bucket").agg(F.sum("n").alias("size"))
    above = sizes.withColumn("above", F.coalesce(F.sum("size").over(W.partitionBy("g", "which").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = placed.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("g", "which", "bucket").orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = inside.alias("a").join(above.alias("b"), same("g", "g") & (F.col("a.which") == F.col("b.which")) & (F.col("a.bucket") == F.col("b.bucket"))).select("a.g", "a.which", "a.v", (F.col("above") + F.col("before")).alias("higher"))
    # rows that share a value are spread over parts, each with a copy of the value's rank
    spread = long.withColumn("_part", F.pmod(F.xxhash64("x"), F.lit(PARTS)))
    copies = ranked.withColumn("_part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])))
    met = spread.alias("a").join(copies.alias("b"), same("g", "g") & (F.col("a.which") == F.col("b.which")) & (F.col("a.v") == F.col("b.v")) & (F.col("a._part") == F.col("b._part")), "left").select("a.g", "a.x", "a.which", "b.higher")
    total = F.broadcast(items.groupBy(F.col("g")).agg(F.count("*").alias("total")).alias("b"))
    full = met.alias("a").join(total, same("g", "g")).select("a.g", "a.x", "a.which", F.coalesce(F.col("total") - F.col("higher"), F.lit(0)).alias("support"))
    per = full.groupBy("g", "x").agg(*[F.max(F.when(F.col("which") == i, F.col("support"))).alias(f"p{i}") for i in range(n)])
    return per.select("g", "x", F.array(*[F.col(f"p{i}").cast("long") for i in range(n)]).alias("supports"))


def leximin_top(rows: DataFrame, group: str, item: str, scores: list[str], k: int) -> DataFrame:
    """(group, item, place, supports): the first ``k`` items of each group; items that tie are ordered by their id.

    A null group is a group of its own; null items are no candidates. A group of fewer than ``k``
    items comes out whole, also items without any score, which are last. Of the many rows of a hot
    group only ``k`` leave each task.
    """
    ranked = supports(rows.where(F.col(item).isNotNull()), group, item, scores)
    order = [F.desc(F.array_sort("supports")), F.asc(item)]
    return ranked.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= k).select(group, item, "place", "supports")
