"""Folders that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "logloom-"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of our own in local mode (tests), and an
    error on a cluster, whose executors have no folder in common then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = getattr(spark, "_logloom_dir", None)
        if base is None:
            base = spark._logloom_dir = "file://" + tempfile.mkdtemp(prefix=_PREFIX)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{_PREFIX}{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, read again: later reads survive the loss of any executor. by: columns
    that the files are dealt by, so that a filter on them reads only its own."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later step reads."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        while "=" in folder.getName():  # a folder of one value
            folder = folder.getParent()
        if folder.getName().startswith(_PREFIX):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
