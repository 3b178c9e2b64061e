"""Files of a directory tree: metadata, hashes, kinds, moves."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.errors import HashError, ScanError
from sedimark.functions import text as T

FILES = "file_id string, path string, hash string, size long, modified long, extension string"
MAX_HASHED = 4 * 1024**3
_BLOCK = 1 << 20


def hash_file(path: str, largest: int = MAX_HASHED) -> str:
    """SHA-256 of a file, read in blocks."""
    try:
        if os.path.getsize(path) > largest:
            raise HashError(f"larger than {largest} bytes: {path}")
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(_BLOCK):
                h.update(block)
        return h.hexdigest()
    except OSError as e:
        raise HashError(str(e)) from e


def verify_hash(path: str, expected: str) -> bool:
    try:
        return hash_file(path) == expected.strip().lower()
    except HashError:
        return False


def ignored_directory(name: str, patterns: tuple[str, ...] = ()) -> bool:
    low = name.lower()
    return low in T.IGNORED_DIRECTORIES or any(fnmatch.fnmatch(name, p) for p in patterns)


def listed(root: str, patterns: tuple[str, ...] = (), predicate: Callable[[str], bool] | None = None) -> Iterator[str]:
    """Paths of the supported files under a directory, without hidden files, links and ignored directories."""
    if not os.path.isdir(root):
        raise ScanError(f"no directory: {root}")
    for folder, names, files in os.walk(root, followlinks=False):
        names[:] = sorted(n for n in names if not n.startswith(".") and not ignored_directory(n, patterns) and not os.path.islink(os.path.join(folder, n)))
        for name in sorted(files):
            path = os.path.join(folder, name)
            ext = os.path.splitext(name)[1][1:].lower()
            if not name.startswith(".") and ext in T.SUPPORTED_EXTENSIONS and not os.path.islink(path) and (predicate is None or predicate(path)):
                yield path


def readable_files(root: str) -> list[str]:
    """All files that a parser reads, sorted, also in hidden and ignored directories."""
    return sorted(os.path.join(d, n) for d, _, files in os.walk(root) for n in files if os.path.splitext(n)[1][1:].lower() in T.READABLE_EXTENSIONS)


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), predicate: Callable[[str], bool] | None = None, hashed: bool = True) -> DataFrame:
    """``FILES`` of a directory that all executors reach. The driver lists paths only; executors read. Unreadable files are left out; those too large to be hashed have no hash."""
    paths = [(p,) for p in listed(root, patterns, predicate)]
    if not paths:
        return spark.createDataFrame([], FILES)
    names, largest = [f.split()[0] for f in FILES.split(", ")], MAX_HASHED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    s = os.stat(path)
                    rows.append((hashlib.sha256(path.encode()).hexdigest(), path, hash_file(path) if hashed and s.st_size <= largest else None, s.st_size, int(s.st_mtime * 1000), os.path.splitext(path)[1][1:].lower()))
                except (OSError, HashError):
                    continue
            if rows:
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    parts = min(len(paths), max(spark.sparkContext.defaultParallelism, len(paths) // 500))
    return spark.createDataFrame(paths, "path string").repartition(parts).mapInArrow(run, FILES)


def verified(files: DataFrame) -> DataFrame:
    """``files`` (path, hash, ...) with ``verified``: whether the file has that hash now. Null for a null path or hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("path"), b.schema.get_field_index("hash")
            ok = [None if p is None or h is None else verify_hash(p, h) for p, h in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist())]
            yield b.append_column("verified", pa.array(ok, pa.bool_()))

    return files.mapInArrow(run, T.schema_of(files) + ", verified boolean")


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size, content) by Spark's own reader, for storage that only it reaches; names that begin with ``_`` or ``.`` are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select("path", F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def include(path: Column) -> Column:
    """Whether a scan takes a file by its path alone."""
    return T.is_supported(T.extension(path)) & ~T.is_hidden(path) & ~T.in_ignored_directory(path)


def normalise(files: DataFrame) -> DataFrame:
    """``files`` with mime type and category."""
    return files.withColumns({"mime_type": T.mime_type(F.col("extension")), "category": T.category(F.col("extension"))})


def within(root: str, path: str, extensions: tuple[str, ...] = (), links: bool = False) -> str:
    """The real path of ``path`` if it lies under ``root``; links out of it, and other extensions where some are named, are an error."""
    base, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, real]) != base:
        raise ScanError(f"outside {root}: {path}")
    if not links and os.path.islink(os.path.join(root, path)):
        raise ScanError(f"a link: {path}")
    if extensions and os.path.splitext(real)[1][1:].lower() not in extensions:
        raise ScanError(f"not allowed: {path}")
    return real


MOVES = "file_id string, old_path string, new_path string, timestamp long"


def resolved_paths(moves: DataFrame) -> DataFrame:
    """(file_id, path): where each file was moved last; ties by the greater path."""
    return moves.groupBy("file_id").agg(F.max_by("new_path", F.struct("timestamp", "new_path")).alias("path"))


def move_history(moves: DataFrame, file_id: str) -> DataFrame:
    return moves.where(F.col("file_id") == file_id).orderBy("timestamp")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(event_type, path, old_path, hash) between two scans: Created, Modified, Deleted, Renamed.

    A file that is gone and one that is new with the same hash are a rename; of several candidates
    the first by path on either side are matched one to one. Files without a hash are no renames, and
    don't meet in one task.
    """
    from pyspark.sql import Window as W

    b = before.select(F.col("path").alias("p"), F.col("hash").alias("bh"))
    a = after.select(F.col("path").alias("q"), F.col("hash").alias("ah"))
    both = b.join(a, F.col("p") == F.col("q"), "full_outer")
    modified = both.where(F.col("p").isNotNull() & F.col("q").isNotNull() & ~F.col("bh").eqNullSafe(F.col("ah"))).select(F.lit("Modified").alias("event_type"), F.col("q").alias("path"), F.lit(None).cast("string").alias("old_path"), F.col("ah").alias("hash"))
    gone = both.where(F.col("q").isNull()).select("p", F.col("bh").alias("h"), F.row_number().over(W.partitionBy("bh", F.when(F.col("bh").isNull(), F.col("p"))).orderBy("p")).alias("n"))
    new = both.where(F.col("p").isNull()).select("q", F.col("ah").alias("h"), F.row_number().over(W.partitionBy("ah", F.when(F.col("ah").isNull(), F.col("q"))).orderBy("q")).alias("n"))
    pairs = gone.join(new, ["h", "n"], "full_outer")
    kind = F.when(F.col("p").isNull(), "Created").when(F.col("q").isNull(), "Deleted").otherwise("Renamed")
    rest = pairs.select(kind.alias("event_type"), F.coalesce("q", "p").alias("path"), F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.col("p")).alias("old_path"), F.col("h").alias("hash"))
    return modified.unionByName(rest)
