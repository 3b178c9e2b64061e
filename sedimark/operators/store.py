"""Tables with keys: upserts, deletes, lookups, over immutable Parquet versions.

A store has ``Versions`` of all its tables together: parts of rows by table, and one manifest that is
put up in one step, so readers see every table's old rows or every table's new ones. Upserts and deletes
write only what they change, as a part of its own with a mark for deleted keys, and reading takes the
last part that has a key; after ``MOST_PARTS`` parts a table is written anew as one. A transaction
stages changes of several tables on the version that it began with; if another writer has put up the
next one meanwhile, it fails and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.errors import DuplicateKey, ReadOnlyError, StorageError
from sedimark.operators.incremental import Versions, new_part

SCHEMAS = {
    "files": ("file_id", "file_id string, path string, hash string, size long, modified long, extension string, last_indexed long"),
    "chunks": ("chunk_id", "chunk_id string, file_id string, content string, heading string, page long, slide long, sheet string, block_type string, content_hash string, created_at long, embedding array<float>, model string, dimension long"),
    "nodes": ("id", "id string, node_type string, ref_id string, label string, file_id string, created_at long"),
    "edges": ("edge_id", "edge_id string, from_id string, to_id string, relation string, weight double, metadata string, file_id string, created_at long"),
    "state": ("file_id", "file_id string, hash string, last_indexed long, status string"),
    "moves": ("", "file_id string, old_path string, new_path string, timestamp long"),
}


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of new rows with one key the greatest."""
    rest = [c for c in old.columns if c != key]
    last = new.select(key, *rest).groupBy(key).agg(F.max(F.struct(*[F.col(c) for c in rest])).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last)


def needs_update(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """Scanned files that are missing, or whose hash or time of change differs, by path."""
    s = stored.groupBy("path").agg(F.max_by(F.struct("hash", "modified"), F.coalesce("last_indexed", F.lit(-1))).alias("s"))
    met = scanned.join(s, "path", "left")
    same = F.col("s.hash").eqNullSafe(F.col("hash")) & F.col("s.modified").eqNullSafe(F.col("modified"))
    return met.where(F.col("s").isNull() | ~same).drop("s")


MOST_PARTS = 16
GONE = "_gone"


class Table:
    def __init__(self, store: Store, name: str, key: str, schema: str):
        self.store, self.name, self.key, self.schema = store, name, key, schema
        self.columns = [f.split()[0] for f in schema.split(", ")]

    def _parts(self) -> list[str]:
        """Paths of the parts that are read now: the version in force, or that the transaction began with, and what it staged."""
        whole, own = self.store._staged.get(self.name, (False, []))
        return ([] if whole else [f"{self.store.folder}/{n}" for n in self.store.names(self.name)]) + own

    def read(self) -> DataFrame:
        spark, parts = self.store.spark, self._parts()
        if not parts:
            return spark.createDataFrame([], self.schema)
        frames = [spark.read.schema(f"{self.schema}, {GONE} boolean").parquet(p) for p in parts]
        every = None
        for n, df in enumerate(frames):
            df = df.withColumn("_n", F.lit(n))
            every = df if every is None else every.unionByName(df)
        if self.key and len(frames) > 1:
            last = F.max(F.struct("_n", GONE, *[c for c in self.columns if c != self.key])).alias("m")
            every = every.groupBy(self.key).agg(last).select(self.key, F.col(f"m.{GONE}").alias(GONE), *[F.col(f"m.{c}").alias(c) for c in self.columns if c != self.key])
        return every.where(~F.coalesce(F.col(GONE), F.lit(False))).select(*self.columns)

    def _change(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Stages new rows, and keys that go."""
        self.store.check_writable()
        part = rows.select(*self.columns).withColumn(GONE, F.lit(False))
        if gone is not None:
            marks = gone.select(self.key).distinct()
            for c in self.columns:
                if c != self.key:
                    marks = marks.withColumn(c, F.lit(None).cast(dict(rows.select(*self.columns).dtypes)[c]))
            marks = marks.select(*self.columns).withColumn(GONE, F.lit(True))
            part = part.unionByName(marks.join(part.select(self.key), self.key, "left_anti"))
        self.store._stage(self, self.store.versions.stage(part), False)

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew."""
        self.store.check_writable()
        self.store._stage(self, self.store.versions.stage(rows.select(*self.columns).withColumn(GONE, F.lit(False))), True)

    def append(self, rows: DataFrame) -> None:
        """New rows; a key that is there already is an error."""
        if self.key and (rows.join(self.read().select(self.key), self.key, "left_semi").limit(1).count() or rows.groupBy(self.key).count().where("count > 1").limit(1).count()):
            raise DuplicateKey(self.name)
        self._change(rows)

    def upsert(self, rows: DataFrame, instead_of: DataFrame | None = None) -> None:
        """Rows in place of those with the same key, and of those with the keys of ``instead_of``; of several rows with one key the greatest."""
        self._change(upserted(rows.select(*self.columns).limit(0), rows, self.key), instead_of)

    def delete(self, where: Column) -> int:
        """The number of rows that the condition held for; null is none."""
        hit = self.read().where(F.coalesce(where, F.lit(False)))
        n = hit.count()
        if n and self.key:
            self._change(self.read().limit(0), hit)
        elif n:
            self.replace(self.read().where(~F.coalesce(where, F.lit(False))))
        return n

    def clear(self) -> None:
        self.replace(self.read().limit(0))

    def get(self, value) -> DataFrame:
        return self.read().where(F.col(self.key) == value)

    def where(self, **values) -> DataFrame:
        """The rows with these values in the order of their keys; None asks for rows without a value."""
        rows = self.read()
        for c, v in values.items():
            rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
        return rows.orderBy(self.key) if self.key else rows

    def among(self, wanted: DataFrame) -> DataFrame:
        """The rows whose values of the columns of ``wanted`` are a row of it; null is a value."""
        met = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in wanted.columns]
        return self.read().alias("r").join(wanted.distinct().alias("w"), met, "left_semi")

    def count(self) -> int:
        return self.read().count()


class Store:
    """The five tables and the moves of files under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False):
        self.spark, self.folder, self.read_only = spark, folder.rstrip("/"), read_only
        self.versions = Versions(spark, f"{self.folder}")
        self._depth = 0
        self._base: int | None = None
        self._staged: dict[str, tuple[bool, list[str]]] = {}
        self.tables = {name: Table(self, name, key, schema) for name, (key, schema) in SCHEMAS.items()}

    def __getattr__(self, name: str) -> Table:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def check_writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError(self.folder)

    def names(self, table: str, version: int | None = None) -> list[str]:
        """The parts of a table in the version in force, or in the one that the transaction began with."""
        v = version if version is not None else self._base if self._base is not None else self.versions.current()
        return [n for n in self.versions.names(v) if n.startswith(f"{table}/")]

    def _stage(self, table: Table, path: str, whole: bool) -> None:
        before = self._staged.get(table.name, (False, []))
        self._staged[table.name] = (True, [path]) if whole else (before[0], [*before[1], path])
        if not self._depth:
            self._publish(self.versions.current())

    def _publish(self, base: int) -> None:
        names, staged = self.versions.names(base), {}
        for table, (whole, paths) in self._staged.items():
            names = [n for n in names if not (whole and n.startswith(f"{table}/"))]
            own = {new_part(f"{table}/"): path for path in paths}
            names, staged = [*names, *own], {**staged, **own}
        changed, self._staged = list(self._staged), {}
        if not staged:
            return
        version = self.versions.publish(names, staged, base)
        for t in changed:
            if len(self.names(t, version)) > MOST_PARTS:
                self.tables[t].replace(self.tables[t].read())

    def begin(self) -> None:
        self.check_writable()
        if not self._depth:
            self._base = self.versions.current()
        self._depth += 1

    def commit(self) -> None:
        if not self._depth:
            raise StorageError("no transaction")
        self._depth -= 1
        if not self._depth:
            base, self._base = self._base, None
            self._publish(base)

    def rollback(self) -> None:
        if not self._depth:
            raise StorageError("no transaction")
        self._depth, self._base = 0, None
        for _, paths in self._staged.values():
            for path in paths:
                self.versions.drop(path)
        self._staged = {}

    def __enter__(self) -> Store:
        self.begin()
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()

    def edges_of(self, node: str, direction: str = "both") -> DataFrame:
        """The edges that leave a node (``forward``), reach it (``backward``), or either."""
        out, into = F.col("from_id") == node, F.col("to_id") == node
        met = {"forward": out, "backward": into, "both": out | into}.get(direction.lower())
        if met is None:
            raise StorageError(f"no such direction: {direction}")
        return self.edges.read().where(met).orderBy("edge_id")

    def pending(self) -> DataFrame:
        """The states that aren't Indexed, by file."""
        done = F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")) == "indexed"
        return self.state.read().where(~F.coalesce(done, F.lit(False))).orderBy("file_id")

    def files_in_order(self) -> DataFrame:
        return self.files.read().orderBy("path", "file_id")

    def record_move(self, file_id: str, old_path: str, new_path: str, timestamp: int) -> None:
        self.moves.append(self.spark.createDataFrame([(file_id, old_path, new_path, timestamp)], SCHEMAS["moves"][1]))

    def delete_file(self, file_id: str) -> dict[str, int]:
        """Everything of a file, in one transaction; the numbers of rows by table."""
        with self:
            return {n: self.tables[n].delete(F.col("file_id") == file_id) for n in ("files", "chunks", "nodes", "edges", "state")}

    def counts(self) -> dict[str, int]:
        return {n: self.tables[n].count() for n in ("files", "chunks", "nodes", "edges")}


def count_all(files: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the four counts."""
    parts = [df.agg(F.count("*").alias(n)) for n, df in (("files", files), ("chunks", chunks), ("nodes", nodes), ("edges", edges))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # single rows
    return out
