"""Intermediate tables where the driver and every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's part of the cluster's folder of spark.checkpoint.dir.

    Where that is unset, a temporary one if all runs on one machine, else an error: executors don't see a machine's own folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and reread: lineage ends there, so a lost executor costs no recomputation before it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file system and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def clear_stored(spark: SparkSession) -> None:
    """Deletes all tables that ``stored`` wrote for this application. Results that still read them must be written before."""
    fs, path = file_system(spark, shared_folder(spark))
    fs.delete(path, True)
