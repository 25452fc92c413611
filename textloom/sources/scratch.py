"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STANDING: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder that checkpoints go to. Only where driver and executors are one process may both be unset:
    then it is a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir: unset; tables between jobs need a folder that all executors share")
        path = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` and read it back, so that it is computed once however often it is read; with ``by``, in a folder for each value of that
    column, so that a filter on it reads no other. The table goes with ``drop`` or the process."""
    spark = df.sparkSession
    path = folder(spark)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder's path there, for files of any kind; it goes like a stored table."""
    path = f"{shared_dir(spark)}/textloom-tables/{uuid.uuid4().hex}"
    if not _STANDING:
        atexit.register(drop)
    _STANDING[path] = spark
    return path


def whole_folders(spark: SparkSession, at: str, prefix: str) -> list[str]:
    """Names of the folders below ``at`` that begin with ``prefix`` and were written to their end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in names if n.startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS")))


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop() -> None:
    """Remove all tables that ``stored`` has written; frames that read them cannot be read any more."""
    while _STANDING:
        path, spark = _STANDING.popitem()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended already
            continue
