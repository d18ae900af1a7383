"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logloom.llm.shared import dropped, written


def _marked(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells whether they changed."""
    seen = Observation()
    out = written(e.observe(seen, F.count("u").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: every node with an edge and the smallest node it reaches. Edges are pairs of long.

    Each round links the larger neighbours of a node, and then the smaller ones, to its smallest; it ends
    when the edges are stars. Minima are pre-aggregated, and the joins have one row a key on one side, so a
    node with very many edges is no burden for a single task. Nulls and self-loops link nothing.
    """
    spark = edges.sparkSession
    e = edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, mark = _marked(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new, now = _marked(small.filter("u <> v").distinct())
        dropped(spark, e)
        e = new
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
