"""Staged tables: what several parts of a plan read is written to the shared folder once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) behind a path of any store that Spark reaches."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder under ``spark.checkpoint.dir``; it goes when the driver ends. Without that setting
    only a local master may use a temporary folder; on a cluster it is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        where = context._staging_dir = getattr(context, "_staging_dir", None) or "file://" + tempfile.mkdtemp(prefix="staged-")
    path = f"{where.rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    fs, folder = hadoop_path(spark, path)
    fs.mkdirs(folder.getParent())
    fs.deleteOnExit(folder)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut, sizes known to the
    planner. The files go when the driver ends."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, path: str, **metrics: Column) -> dict[str, int]:
    """Writes ``df`` to a folder; aggregates of it that are observed meanwhile."""
    watch = Observation()
    df.observe(watch, *(F.coalesce(c, F.lit(0)).alias(n) for n, c in metrics.items())).write.parquet(path)
    return dict(watch.get)


def staged_with(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """staged(), and aggregates of ``df`` that are observed while it is written: nothing runs twice for
    them."""
    watch = Observation()
    out = staged(df.observe(watch, *(F.coalesce(c, F.lit(0)).alias(n) for n, c in metrics.items())), name)
    return out, dict(watch.get)
