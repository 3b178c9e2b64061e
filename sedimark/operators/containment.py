"""Which texts of a group contain which needles of the same group, as substrings.

A join on the group with a test of every pair is quadratic in the size of a group. Here a group's
needles become an automaton that finds all of them in one pass over a text. Texts and needles of a
large group are cut into parts, and every two parts meet in a task of their own; texts stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.skew import join_unique
from sedimark.storage_paths import written

#: Texts and needles of a group that one task takes.
TEXTS, NEEDLES = 5_000, 50_000


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(grp, id, needle): each once. ``texts`` (grp, id, text), ``needles`` (grp, needle); null and empty ones are never found."""
    t = texts.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("string").alias("id"), F.col("text").alias("s")).where(F.col("grp").isNotNull() & F.col("s").isNotNull())
    n = needles.select(F.col("grp").cast("string").alias("grp"), F.col("needle").alias("s")).where(F.col("grp").isNotNull() & (F.col("s") != "")).distinct()
    n = written(n, "needles")
    count = lambda df, most, name: df.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)
    large = written(count(n, NEEDLES, "ns").join(count(t, TEXTS, "ts"), "grp", "full_outer"), "large-groups")
    if large.isEmpty():
        # no group is larger than a task
        one = F.lit(0)
        left = t.join(n.select("grp").distinct(), "grp", "left_semi").select("grp", one.alias("part"), one.alias("own"), F.lit(1).alias("kind"), "id", "s")
        right = n.select("grp", one.alias("part"), one.alias("own"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "s")
        return _found(left.unionByName(right))
    parts = n.select("grp").distinct().join(large, "grp", "left").select("grp", F.coalesce("ns", F.lit(1)).alias("ns"), F.coalesce("ts", F.lit(1)).alias("ts"))
    mine = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = join_unique(t, parts, "grp", "inner").select("grp", mine("id", "ts").alias("part"), every("ns").alias("own"), F.lit(1).alias("kind"), "id", "s")
    right = join_unique(n, parts, "grp", "inner").select("grp", "s", mine("s", "ns").alias("own"), every("ts").alias("part")).select("grp", "part", "own", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "s")
    return _found(left.unionByName(right))


def _found(both: DataFrame) -> DataFrame:
    """(grp, id, needle) of the needles (kind 0) and texts (kind 1) that share grp, part and own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, finder = None, set(), None
        for b in batches:
            found: list[tuple[str, str, str]] = []
            for grp, part, own, kind, id_, s in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (grp, part, own) != key:
                    key, words, finder = (grp, part, own), set(), None
                if kind == 0:
                    words.add(s)
                    continue
                if finder is None and words:
                    finder = ahocorasick.Automaton()
                    for w in words:
                        finder.add_word(w, w)
                    finder.make_automaton()
                if finder is not None:
                    found.extend((grp, id_, w) for w in {w for _, w in finder.iter(s)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["grp", "id", "needle"])

    together = both.repartition("grp", "part", "own").sortWithinPartitions("grp", "part", "own", "kind")
    return together.mapInArrow(run, "grp string, id string, needle string").distinct()
