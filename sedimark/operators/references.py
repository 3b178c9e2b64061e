"""References to records that do not exist.

``cascade`` goes down the graph of foreign keys to its fixpoint: a reference without a target in time
is a direct orphan, and a record whose target is an orphan is one by inheritance. Tables come after
those that they refer to, so each foreign key is joined once, with its targets and what is known of
them; keys that go in a circle are followed by semi-joins, depth by depth, until nothing is new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.operators.skew import hot_keys, join_unique
from sedimark.storage_paths import written


@dataclass(frozen=True)
class ForeignKey:
    """``child.field`` refers to ``parent.key``. With ``timed``, a target that came after the reference is late."""

    child: str
    field: str
    parent: str
    timed: bool = False


@dataclass(frozen=True)
class Keyed:
    """A table, its key and, if it has one, its time in epoch milliseconds. A key may occur in several rows."""

    rows: DataFrame
    key: str
    created: str | None = None


def month(ms: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM"), F.lit("unknown"))


def _time(t: Keyed) -> Column:
    return F.col(t.created).cast("long") if t.created else F.lit(None).cast("long")


def _targets(t: Keyed) -> DataFrame:
    """Each key once with its earliest time; partial aggregation takes repeated rows together before the shuffle."""
    return t.rows.where(F.col(t.key).isNotNull()).groupBy(F.col(t.key).alias("ref")).agg(F.min(_time(t)).alias("target_at"))


def references(t: Keyed, fields: list[str]) -> DataFrame:
    """(record_id, field_name, ref, at): the distinct non-empty references of a table.

    ``at`` is the earliest time of the record over all its rows, not only those with this reference.
    All rows without a record id are one record; its time is a single row, as they may be many.
    """
    at = t.rows.groupBy(F.col(t.key).alias("record_id")).agg(F.min(_time(t)).alias("at"))
    nameless = t.rows.where(F.col(t.key).isNull()).agg(F.min(_time(t)).alias("_at"))
    refs = (
        t.rows.select(F.col(t.key).alias("record_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("ref")) for f in fields])).alias("x"))
        .select("record_id", "x.field_name", "x.ref")
        .where(F.col("ref").isNotNull() & (F.col("ref") != ""))
        .distinct()
    )
    dated = join_unique(refs, at.where(F.col("record_id").isNotNull()), "record_id", counted=t.rows.select(F.col(t.key).alias("record_id")))
    dated = dated.join(F.broadcast(nameless))  # one row
    return dated.select("record_id", "field_name", "ref", F.when(F.col("record_id").isNull(), F.col("_at")).otherwise(F.col("at")).alias("at"))


def _order(keys: list[ForeignKey]) -> tuple[list[str], set[str]]:
    """The tables with foreign keys, each after those that it refers to as far as that goes, and those that are in or below a circle."""
    left, done = list(dict.fromkeys(k.child for k in keys)), []
    while ready := [n for n in left if not any(k.child == n and k.parent in left for k in keys)]:
        done += ready
        left = [n for n in left if n not in ready]
    return done + left, set(left)


def _judged(tables: dict[str, Keyed], keys: list[ForeignKey], name: str, orphans: dict[str, DataFrame]) -> DataFrame:
    """The findings of one table, given the orphans (record_id, depth) of those that it refers to."""
    found = None
    own = [k for k in keys if k.child == name]
    for parent in dict.fromkeys(k.parent for k in own):
        of = [k for k in own if k.parent == parent]
        timed = [k.field for k in of if k.timed]
        refs = references(tables[name], [k.field for k in of])
        values = tables[name].rows.select(F.explode(F.array(*[F.col(k.field).cast("string") for k in of])).alias("ref"))
        targets = _targets(tables[parent]).withColumn("there", F.lit(True))
        if parent in orphans:
            lost = orphans[parent].where(F.col("record_id").isNotNull()).select(F.col("record_id").alias("ref"), F.col("depth").alias("above"))
            targets = targets.join(lost, "ref", "left")
        else:
            targets = targets.withColumn("above", F.lit(None).cast("int"))
        met = join_unique(refs, targets, "ref", counted=values)
        late = F.col("field_name").isin(timed) & (F.col("target_at") > F.col("at")) if timed else F.lit(False)
        reason = F.when(F.col("there").isNull(), "absent").when(late, "late").when(F.col("above").isNotNull(), "orphan")
        depth = F.when(F.col("reason") == "orphan", F.col("above") + 1).otherwise(F.lit(0))
        part = met.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(F.lit(name).alias("table_name"), "field_name", "record_id", month(F.col("at")).alias("period"), "reason", depth.cast("int").alias("depth")).distinct()
        found = part if found is None else found.unionByName(part)
    return found


def cascade(tables: dict[str, Keyed], keys: list[ForeignKey]) -> DataFrame:
    """(table_name, field_name, record_id, period, reason, depth) of the references that end at a missing record, at once or by way of others.

    At depth 0 there is no target in time: reason is ``absent`` or, for timed keys, ``late``. Below,
    the target is an ``orphan``, and depth is one more than its least. Null and empty references are
    none. ``period`` is the month of the record's earliest time, ``unknown`` without one; such a record
    is never late. Each finding comes out once. Tables may have other columns; an empty table has no
    references, and every reference to it is absent. The findings of each table are written to the
    shared folder.
    """
    order, circular = _order(keys)
    parents = {k.parent for k in keys}
    found: dict[str, DataFrame] = {}
    orphans: dict[str, DataFrame] = {}
    for name in order:
        found[name] = written(_judged(tables, keys, name, {p: d for p, d in orphans.items() if not (name in circular and p in circular)}), f"orphans-{name}")
        if name in parents:
            orphans[name] = found[name].groupBy("record_id").agg(F.min("depth").alias("depth"))
    if circular:
        _around(tables, [k for k in keys if k.child in circular and k.parent in circular], found)
    every = None
    for f in found.values():
        every = f if every is None else every.unionByName(f)
    return every


def _around(tables: dict[str, Keyed], keys: list[ForeignKey], found: dict[str, DataFrame]) -> None:
    """Adds to ``found`` what circles of foreign keys bring: from depth to depth the children of the records that are orphans there first."""
    refs = {k: written(references(tables[k.child], [k.field]), f"references-{k.child}") for k in keys}
    hot = {k: hot_keys(refs[k], "ref") for k in keys}
    least = {n: written(found[n].groupBy("record_id").agg(F.min("depth").alias("depth")), f"least-{n}") for n in {x for k in keys for x in (k.child, k.parent)}}
    last = max((r[0] for r in (df.agg(F.max("depth")).first() for df in least.values()) if r[0] is not None), default=-1)
    fresh: dict[str, DataFrame] = {}
    depth = 0
    while depth <= last or fresh:
        step: dict[str, DataFrame] = {}
        for k in keys:
            here = least[k.parent].where(F.col("depth") == depth)
            here = here.where(F.col("record_id").isNotNull()).select(F.col("record_id").alias("ref"), F.lit(True).alias("there"))
            hit = join_unique(refs[k], here, "ref", "inner", hot=hot[k])
            part = hit.select(F.lit(k.child).alias("table_name"), "field_name", "record_id", month(F.col("at")).alias("period"), F.lit("orphan").alias("reason"), F.lit(depth + 1).alias("depth"))
            step[k.child] = part if k.child not in step else step[k.child].unionByName(part)
        fresh = {}
        for n, part in step.items():
            known = least[n].where(F.col("depth") <= depth).select(F.col("record_id").alias("_r"))
            new = written(part.distinct().join(known, part.record_id.eqNullSafe(known._r), "left_anti"), f"orphans-{n}-{depth + 1}")
            if not new.isEmpty():
                fresh[n], found[n] = new, found[n].unionByName(new)
                least[n] = written(least[n].unionByName(new.select("record_id", "depth")).groupBy("record_id").agg(F.min("depth").alias("depth")), f"least-{n}")
        depth += 1


def direct(found: DataFrame) -> DataFrame:
    """(table_name, field_name, record_id, period, reason) of the findings of ``cascade`` that have no target in time themselves."""
    return found.where(F.col("depth") == 0).drop("depth")


def records(found: DataFrame) -> DataFrame:
    """(table_name, record_id, period, origin, depth) of the findings of ``cascade``: each orphaned record once, ``direct`` or ``inherited``, at its least depth."""
    per = found.groupBy("table_name", "record_id", "period").agg(F.min("depth").alias("depth"))
    return per.select("table_name", "record_id", "period", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("origin"), "depth")
