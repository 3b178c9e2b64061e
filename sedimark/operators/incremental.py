"""Processing only new or changed records.

The state is a table of (key, hash) in numbered versions. A run hashes its current rows, joins them
with the version in force, works on what is new or changed, writes those rows as a part of its own,
and puts up the manifest of the next version in one step. A run that fails before that leaves the old
version in force, so its records come again; after it, they don't.
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.errors import StorageError
from sedimark.storage_paths import filesystem, written

LOWEST = -(2**63)


def clean_hash(c: Column) -> Column:
    """A content hash as it is compared: trimmed, lower case, without ``sha256:``; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^sha256:\s*", "")
    return F.when(bare != "", bare)


def current_rows(scans: DataFrame, key: str, hash_col: str, order: str) -> DataFrame:
    """(key, hash) of each key's row with the greatest ``order``; null is lowest.

    Rows with a null key are left out. Of rows that tie, the greatest hash counts, so that the
    result doesn't depend on the order of rows. One aggregation with partial results in each task.
    """
    first = F.struct(F.coalesce(F.col(order).cast("long"), F.lit(LOWEST)).alias("at"), clean_hash(F.col(hash_col)).alias("hash"))
    return scans.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(first).alias("m")).select("key", F.col("m.hash").alias("hash"))


def last_success(log: DataFrame, key: str, hash_col: str, order: str, status: str, success: str) -> DataFrame:
    """(key, hash) of each key's last row in the log that succeeded and names a hash."""
    ok = F.lower(F.regexp_replace(F.col(status), r"^\s+|\s+$", "")) == success.lower()
    return current_rows(log.where(ok & clean_hash(F.col(hash_col)).isNotNull()), key, hash_col, order)


def changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """(key, hash, change) of the current rows that the state lacks (``new``) or has otherwise (``changed``).

    Both sides have each key once and are distributed by it already, so the join adds no shuffle.
    A current row without hash can't be processed and is left out. Empty inputs give an empty result.
    """
    old = state.select("key", F.col("hash").alias("old_hash"))
    joined = current.where(F.col("hash").isNotNull()).join(old, "key", "left")
    return joined.where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("hash"))).select("key", "hash", F.when(F.col("old_hash").isNull(), "new").otherwise("changed").alias("change"))


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of several columns; null and empty differ, and so do values that only join alike."""
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


class Versions:
    """Numbered versions in a folder: which parts make up each, and which is in force.

    A version is a manifest that names parts, folders of Parquet files, older ones first; the one with
    the highest number is in force. Parts have names of their own, so writers don't touch each other's.
    ``publish`` moves the staged parts to their places and puts up the manifest by a step that only one
    of several writers can win, a link on a local disk and a rename that doesn't overwrite on HDFS; who
    loses has changed nothing. Readers see a version whole or not at all. An object store whose rename
    isn't atomic needs a lock around ``publish``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known = 0

    def _read_text(self, name: str) -> str | None:
        fs, p = filesystem(self.spark, f"{self.folder}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> bool:
        """Writes a small file whole, in one step, unless it is there."""
        fs, temp = filesystem(self.spark, f"{self.folder}/_new-{uuid.uuid4().hex}")
        _, target = filesystem(self.spark, f"{self.folder}/{name}")
        out = fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() != "file":
                return not fs.exists(target) and bool(fs.rename(temp, target))
            os.link(temp.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(temp, False)

    @staticmethod
    def manifest(version: int) -> str:
        return f"MANIFEST-{version:010d}"

    def current(self) -> int:
        """The version in force; 0 before the first. It is looked for from the last one that was seen, or from the hint that writers leave."""
        at = max(self._known, int(self._read_text("HINT") or 0))
        while True:
            fs, p = filesystem(self.spark, f"{self.folder}/{self.manifest(at + 1)}")
            if not fs.exists(p):
                self._known = at
                return at
            at += 1

    def names(self, version: int) -> list[str]:
        """The parts of a version, below the folder."""
        return (self._read_text(self.manifest(version)) or "").split() if version else []

    def parts(self, version: int) -> list[str]:
        """The paths of a version's parts."""
        return [f"{self.folder}/{n}" for n in self.names(version)]

    def stage(self, rows: DataFrame) -> str:
        path = f"{self.folder}/_staged-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def drop(self, path: str) -> None:
        fs, p = filesystem(self.spark, path)
        fs.delete(p, True)

    def publish(self, names: list[str], staged: dict[str, str], base: int) -> int:
        """Makes ``names`` version ``base`` + 1, where ``staged`` has the staged path of each new name; an error if there is such a version already."""
        for name, path in staged.items():
            fs, target = filesystem(self.spark, f"{self.folder}/{name}")
            fs.mkdirs(target.getParent())
            if not fs.rename(filesystem(self.spark, path)[1], target):
                raise StorageError(f"can't move {path}")
        if not self._put(self.manifest(base + 1), "\n".join(names)):
            for name in staged:
                self.drop(f"{self.folder}/{name}")
            raise StorageError(f"version {base} is no longer in force")
        self._known = max(self._known, base + 1)
        with contextlib.suppress(Exception):  # a hint may be lost or old
            fs, p = filesystem(self.spark, f"{self.folder}/HINT")
            out = fs.create(p, True)
            out.write(bytearray(str(base + 1).encode()))
            out.close()
        return base + 1


def new_part(prefix: str = "") -> str:
    return f"{prefix}part-{uuid.uuid4().hex}"


class KeyedState:
    """Versions of a (key, hash) table in a folder that all executors reach.

    ``select`` gives a run's records, ``commit`` ends it. Between the two the caller processes the
    records; that work should be idempotent by key, since a run that dies before ``commit`` is
    repeated. Two runs at once: the one that commits second fails and changes nothing, as its
    base version is gone.

    A commit writes its own rows only, as one more part; the last part that has a key counts. After
    ``MOST_PARTS`` the state is written anew as one.
    """

    MOST_PARTS = 16

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def version(self) -> int:
        return self.versions.current()

    def read(self, version: int | None = None) -> DataFrame:
        parts = self.versions.parts(self.version() if version is None else version)
        if not parts:
            return self.spark.createDataFrame([], "key string, hash string")
        if len(parts) == 1:
            return self.spark.read.parquet(parts[0])
        every = None
        for n, p in enumerate(parts):
            df = self.spark.read.parquet(p).withColumn("n", F.lit(n))
            every = df if every is None else every.unionByName(df)
        return every.groupBy("key").agg(F.max_by("hash", "n").alias("hash"))

    def select(self, current: DataFrame) -> DataFrame:
        """(key, hash, change) of what is new or changed, held in the shared folder so that ``commit`` ends exactly this selection."""
        return written(changed(current, self.read()), "changed")

    def commit(self, done: DataFrame, base: int) -> int:
        """Makes ``done`` (key, hash) part of the state that was ``base``, and that the version in force."""
        new, part, names = done.select("key", "hash"), new_part(), self.versions.names(base)
        if len(names) < self.MOST_PARTS:
            return self.versions.publish([*names, part], {part: self.versions.stage(new)}, base)
        kept = self.read(base).join(new, "key", "left_anti")
        return self.versions.publish([part], {part: self.versions.stage(kept.unionByName(new))}, base)


def indexed_state(spark: SparkSession, folder: str, index_state: DataFrame) -> KeyedState:
    """A state in an empty folder whose first version is what the log says was indexed successfully."""
    state = KeyedState(spark, folder)
    state.commit(last_success(index_state, "file_id", "hash", "last_indexed", "status", "Indexed"), state.version())
    return state


def pending_files(file_meta: DataFrame, index_state: DataFrame) -> DataFrame:
    """(key, hash, change): files whose present hash hasn't been indexed successfully."""
    current = current_rows(file_meta, "file_id", "hash", "modified")
    return changed(current, last_success(index_state, "file_id", "hash", "last_indexed", "status", "Indexed"))
