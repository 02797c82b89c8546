"""Intermediate tables in the folder that all executors share.

A lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``; a lost executor then
costs only the tasks it was running. The folder is taken from the session. Where it is unset, a session of
one machine (tests, a laptop) uses a temporary folder; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="symloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before; the folder is left to whoever cleans the shared one
        pass


def _tables(spark: SparkSession) -> str:
    """The application's own folder below the shared one; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/symloom-tables/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_remove, spark, path)
    return path


def write_table(df: DataFrame, name: str = "t") -> str:
    """Writes ``df`` as Parquet below the shared folder; returns the path."""
    path = f"{_tables(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once and read back: everything above reads the table, not the lineage.

    Results are lazy and may read the table at any later time, so it stays until the driver ends.
    """
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, name))
