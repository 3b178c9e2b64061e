"""Equi-joins against a side with unique keys, where one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.storage_paths import written

#: A key is hot when it has more than this part of all rows, or more than half of what a task has if that is less.
HOT_PART = 0.01
#: Fewer rows than this fit in one task, so no key is hot; which rows come out doesn't depend on it.
LEAST_ROWS = 200_000


def hot_part(df: DataFrame) -> float:
    """The part of all rows from which a key is hot: less with more tasks, so that a key's rows fit in one."""
    return min(HOT_PART, 0.5 / max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))


def hot_keys(left: DataFrame, key: str, part: float | None = None) -> list:
    """Keys of more than ``part`` of the rows that have a key; never more than ``1 / part`` of them.

    Rows are counted before the shuffle, so a hot key reaches the reducer as one row a task.
    """
    some = left.where(F.col(key).isNotNull()).select(key)
    total = some.count()
    if total < LEAST_ROWS:
        return []
    least = int(total * (hot_part(left) if part is None else part))
    return [r[0] for r in some.groupBy(key).count().where(F.col("count") > least).select(key).collect()]


#: Tasks that the rows of a hot key are spread over.
SPREAD = 32


def join_spread(few: DataFrame, many: DataFrame, key: str, by: str, hot: list) -> DataFrame:
    """``few`` joined with ``many`` by ``key``, where ``many`` has a large part of its rows at the ``hot`` keys: these are cut by a hash of ``by``, and the rows of ``few`` meet all parts."""
    if not hot:
        return few.join(many, key)
    is_hot = F.col(key).isin(hot)
    parts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("_part")
    left = few.select("*", parts)
    right = many.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0)))
    return left.join(right, [key, "_part"]).drop("_part")


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left", part: float | None = None, counted: DataFrame | None = None, hot: list | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has each ``key`` at most once.

    Rows of hot keys meet their at most ``1 / part`` rows of ``right`` by broadcast, where they lie;
    the others are shuffled. Null keys match nothing and stay for ``how='left'``. No row is dropped.
    ``counted`` has the key's values at less cost than ``left``, such as the table it was made from;
    ``hot`` names the hot keys where they are known.
    """
    if hot is None:
        hot = hot_keys(left if counted is None else counted, key, part)
    if not hot:
        return left.join(right, key, how)
    left = written(left, "split")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = right.where(F.col(key).isin(hot))
    return left.where(is_hot).join(F.broadcast(few), key, how).unionByName(left.where(~is_hot).join(right, key, how))
