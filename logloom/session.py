"""A session with the settings that the operators expect."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(name: str = "logloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and the state store that streams with timers need; anything else comes from the
    cluster or from conf (dots written as __)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


#: Bytes after which a batch of rows for a Python task ends; Spark's own bound is a number of rows, 10,000 contents of 64 KiB or more.
BATCH = 1 << 22


def mapped(rows: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """rows.mapInArrow() in batches that end at BATCH bytes too, so that a worker's memory follows the largest row and not
    the number of rows of its task. The bound is a setting of the session; one that is set stays."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH))
    return rows.mapInArrow(f, schema)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files made on the way, in spark.checkpoint.dir; where that is unset, in a temporary folder in
    local mode (tests), and an error on a cluster, whose executors have no folder in common then. It goes with the driver's JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/') if base else 'file://' + tempfile.mkdtemp(prefix='logloom-')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def dropped(spark: SparkSession, *folders: str) -> None:
    """Delete work folders whose files nothing reads any more, before the driver's JVM ends."""
    for folder in folders:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a work folder, read again: its lineage ends there."""
    path = f"{work_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
