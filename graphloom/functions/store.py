"""Lineage cuts that survive the loss of an executor.

``materialize`` writes a DataFrame as Parquet below the folder which the cluster names in
``spark.checkpoint.dir`` and reads it back. Only where that setting is absent, as in local tests,
is a folder of our own made and set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage that all executors share."""
    there = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(SETTING, "file://" + own)
    return "file://" + own


def materialize(df: DataFrame, name: str = "cut", partitions: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again; ``partitions`` coalesces the files written."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._graphloom_path = at
    return back


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table made by ``materialize`` once nothing reads it any more."""
    at = getattr(df, "_graphloom_path", None)
    if at:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that many and one."""
    return df.limit(limit + 1).count() <= limit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
