"""Places that all executors share, and tables written there to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and executors are
threads of this process, as in local tests, a folder of this process is used instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sedimark.errors import StorageError

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise StorageError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sedimark-"))
    return "file://" + _LOCAL[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    Later plans start at the files, so a lost executor costs at most the running stage, and the
    rows are computed once however often they are used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as the JVM has it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote with ``written``; results that still read them must be stored before. Their number."""
    n = 0
    while _WRITTEN:
        fs, p = filesystem(spark, _WRITTEN.pop())
        n += bool(fs.delete(p, True))
    return n
