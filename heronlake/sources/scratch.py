"""A folder for what queries leave between their steps, which all machines see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()
_ONCE: dict[tuple, DataFrame] = {}


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return f"file://{tempfile.gettempdir()}/heronlake"
    raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines see")


def files(spark: SparkSession, path: str):
    """(Hadoop's file system, its Path) of a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder, which is deleted when its driver ends."""
    run = f"{base(spark)}/heronlake-run-{spark.sparkContext.applicationId}"
    if run not in _MADE:
        fs, target = files(spark, run)
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _MADE.add(run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder, read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, folder: str, table: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives of a folder's table, stored once for an application and a state of the table."""
    fs, target = files(spark, f"{folder}/{table}.parquet")
    key = spark.sparkContext.applicationId, folder, name, fs.getFileStatus(target).getModificationTime(), fs.getContentSummary(target).getLength()
    if key not in _ONCE:
        _ONCE[key] = stored(make(), name)
    return _ONCE[key]
