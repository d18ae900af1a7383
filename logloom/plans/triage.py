"""Triage: what kind of evidence a path is, and what each log in it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.integrity import findings
from logloom.session import written
from logloom.sources import logs as L
from logloom.sources import ranges


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def kind_of(spark: SparkSession, path: str) -> str:
    """directory, image (EWF), log or blob: by what the path is, and by its name."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return "directory"
    ending = target.getName().rsplit(".", 1)[-1].lower()
    return {"e01": "image", "ex01": "image", "evtx": "log"}.get(ending, "blob")


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """source, how (filesystem or carved), content: the logs of a folder or file; a blob is swept for chunks, and
    each becomes a source of its own. EWF images can't be opened."""
    kind = kind_of(spark, path)
    if kind == "image":
        raise ValueError(f"{path} is an EWF image: mount it or give its logs")
    if kind != "blob":
        return L.files(spark, path).select("source", F.lit("filesystem").alias("how"), "content")
    found = ranges.sweep_chunks(spark, path) if ranges.readable(path) else L.swept(spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content"))
    return found.select(F.concat("source", F.lit("#"), "chunk_offset").alias("source"), F.lit("carved").alias("how"), "content")


def triage(spark: SparkSession, path: str) -> DataFrame:
    """source, how, size, sha256, chunks, records and integrity codes (array) of every log at a path."""
    logs = evidence(spark, path)
    carved = kind_of(spark, path) == "blob"
    # Facts are needed twice, and small beside the contents, which are read for them once, and once for hashes.
    facts = written(L.facts_of_chunks(logs.withColumn("chunk_offset", F.lit(0).cast("long"))) if carved else L.facts(logs), "facts")
    codes = findings(facts).groupBy("source").agg(F.array_sort(F.collect_set("code")).alias("findings"))
    stats = facts.filter("found").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("records").alias("records"))
    shown = logs.select("source", "how", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
    out = shown.join(stats, "source", "left").join(codes, "source", "left").fillna(0, ["chunks", "records"])
    return out.withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))
