"""Greedy bursts: at least so many hits within a time, each hit in one burst at most."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.session import written


#: Buckets of time that are ordered at once, and hits from which on a run is no single task's work.
BUCKETS, LONG_RUN = 4096, 1 << 18


def _runs(rows: DataFrame, width_us: int, by: list[str]) -> DataFrame:
    """by, bucket, run, size, offset of every bucket with hits; run is the first bucket of its run, offset the hits before it.

    Two levels of windows, over BUCKETS buckets and over what these come to: nothing is ordered that grows with the hits.
    """
    buckets = rows.groupBy(*by, "bucket").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("size"))
    before = buckets.select(*by, (F.col("bucket") + 1).alias("bucket"), F.col("last").alias("before"))
    buckets = buckets.join(before, [*by, "bucket"], "left").withColumn("start", F.when(F.coalesce(F.col("first") - F.col("before") > width_us, F.lit(True)), F.col("bucket")))
    buckets = buckets.withColumn("part", F.floor(F.col("bucket") / BUCKETS))
    parts = buckets.groupBy(*by, "part").agg(F.max("start").alias("start"), F.sum("size").alias("size"))
    w = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.last("start", ignorenulls=True).over(w).alias("carried"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias("shift"))
    w = Window.partitionBy(*by, "part").orderBy("bucket")
    inner = buckets.select(*by, "bucket", "part", "size", F.last("start", ignorenulls=True).over(w).alias("own"), (F.sum("size").over(w) - F.col("size")).alias("behind"))
    return inner.join(parts, [*by, "part"]).select(*by, "bucket", F.coalesce("own", "carried").alias("run"), "size", (F.col("shift") + F.col("behind")).alias("offset"))


def bursts(hits: DataFrame, width_us: int, least: int, by: list[str], long_run: int = LONG_RUN) -> DataFrame:
    """by, start_ts, n, and event_id, channel, record_id of the last hit and `shown` of all hits of each burst.

    From the first hit on: if the hits up to width_us later (inclusive) are at least `least`, they are a
    burst and the search goes on after them, else at the next hit. hits: ts, event_id, channel, record_id,
    shown; hits without ts take no part.

    Runs of hits whose gaps are within width_us can't affect each other. Hits less than width_us apart are in
    one bucket of time or in neighbouring ones, so runs are told from the first and last hit of each bucket
    (_runs). Runs of up to long_run hits are streamed through in order, a run in one task; longer ones are searched by
    pointer doubling over all tasks (_long_bursts).
    """
    by = by or ["_all"]
    rows = (hits if by != ["_all"] else hits.withColumn("_all", F.lit(0))).select(*by, "ts", "event_id", "channel", "record_id", "shown").filter("ts is not null")
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("bucket", F.floor(F.col("us") / (width_us + 1)))
    buckets = written(_runs(rows, width_us, by), "runs")
    # Runs that are too short can't hold a burst.
    runs = buckets.groupBy(*by, "run").agg(F.sum("size").alias("n_run")).filter(F.col("n_run") >= least)
    buckets = buckets.join(runs, [*by, "run"])
    found = _short_bursts(rows.join(buckets.filter(F.col("n_run") <= long_run).select(*by, "bucket", "run"), [*by, "bucket"]), width_us, least, by)
    long = buckets.filter(F.col("n_run") > long_run)
    if not long.isEmpty():
        found = found.unionByName(_long_bursts(rows.join(long.drop("n_run"), [*by, "bucket"]), width_us, least, by))
    return found.drop("_all")


def _long_bursts(rows: DataFrame, width_us: int, least: int, by: list[str]) -> DataFrame:
    """The bursts of rows (by, us, bucket, run, size, offset, ...), by pointer doubling.

    place counts the hits of a value of `by`. Each hit points to the one at which the search goes on after it:
    the running count of hits in the bucket where its width ends tells that. With jumps of 2^k hits, those
    known to be reached from a run's first hit within 2^k steps lead to those within 2^(k + 1): a join each.
    Bursts start more than width_us apart, so a bucket holds the start of one at most, and hits find theirs
    among their bucket's and the one before.
    """
    place = F.col("offset") + F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("us", "record_id"))
    rows = written(rows.withColumn("place", place), "places")  # hits that are alike in both keep the places they got
    reach = F.floor((F.col("us") + width_us) / (width_us + 1))
    base = F.when(reach == F.col("bucket"), F.col("offset")).otherwise(F.col("offset") + F.col("size"))
    probes = rows.select(*by, "run", "place", "bucket", reach.alias("at"), (F.col("us") + width_us).alias("us"), base.alias("base"), F.lit(1).alias("probe"))
    marks = rows.select(*by, F.col("bucket").alias("at"), "us", F.lit(0).alias("probe"))
    upto = F.sum(1 - F.col("probe")).over(Window.partitionBy(*by, "at").orderBy("us", "probe").rowsBetween(Window.unboundedPreceding, 0))
    counted = probes.unionByName(marks, allowMissingColumns=True).withColumn("end", F.col("base") + upto).filter("probe = 1")
    counted = counted.withColumn("n", F.col("end") - F.col("place") + 1)
    counted = written(counted.select(*by, "run", "bucket", "place", "n", F.when(F.col("n") >= least, F.col("end") + 1).otherwise(F.col("place") + 1).alias("next")), "steps")
    jump = counted.select(*by, "run", "place", "next").filter("next is not null")
    # A run ends at its last hit: what points beyond it has no row to meet there.
    reached = written(counted.groupBy(*by, "run").agg(F.min("place").alias("place")), "reached")
    while True:
        more = reached.join(jump, [*by, "run", "place"]).select(*by, "run", F.col("next").alias("place"))
        more = written(more.join(counted.select(*by, "run", "place"), [*by, "run", "place"], "left_semi"), "more")
        if more.isEmpty():
            break
        reached = written(reached.unionByName(more), "reached")
        ahead = jump.select(*by, "run", F.col("place").alias("next"), F.col("next").alias("following"))
        jump = written(jump.join(ahead, [*by, "run", "next"]).select(*by, "run", "place", F.col("following").alias("next")), "jumps")
    starts = counted.filter(F.col("n") >= least).join(reached, [*by, "run", "place"], "left_semi").select(*by, F.col("bucket").alias("b"), F.col("place").alias("start"), "n")
    starts = starts.select(*by, "start", "n", F.explode(F.array("b", F.col("b") + 1)).alias("bucket"))
    members = rows.join(starts, [*by, "bucket"]).filter("place between start and start + n - 1")
    last = {c: F.max_by(c, "place").alias(c) for c in ("event_id", "channel", "record_id")}
    shown = F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]).alias("shown")
    return members.groupBy(*by, "start").agg(F.min("ts").cast("timestamp_ntz").alias("start_ts"), F.count(F.lit(1)).alias("n"), *last.values(), shown).drop("start")


def settled(held: list[dict], now: int | None, width_us: int, least: int) -> Iterator[list[dict]]:
    """Decide about the hits of held (in order of us) whose width is over at `now`, or with None about all; they leave
    held, and those that are a burst come out together."""
    while held and (now is None or now > held[0]["us"] + width_us):
        n = next((i for i, h in enumerate(held) if h["us"] > held[0]["us"] + width_us), len(held))
        if n >= least:
            yield held[:n]
        del held[: n if n >= least else 1]


def _short_bursts(runs: DataFrame, width_us: int, least: int, by: list[str]) -> DataFrame:
    """The bursts of rows with their run; runs are streamed through, a task holds the hits of one width at a time."""
    rows = runs.drop("bucket")
    # A fixed number: what is small in bytes may still be much work, and adaptive execution only sees bytes.
    ordered = runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "run").sortWithinPartitions(*by, "run", "us", "record_id")
    kinds = {f.name: f for f in rows.schema.fields}
    fields = [*[kinds[c] for c in by], T.StructField("start_ts", T.TimestampNTZType()), T.StructField("n", T.LongType()), *[kinds[c] for c in ("event_id", "channel", "record_id")], T.StructField("shown", T.ArrayType(T.StringType()))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run, held, out, schema = None, [], [], None

        def settle(now: int | None) -> None:
            for burst in settled(held, now, width_us, least):
                first, last = burst[0], burst[-1]
                out.append({c: first[c] for c in by} | {"start_ts": first["ts"], "n": len(burst), "event_id": last["event_id"], "channel": last["channel"], "record_id": last["record_id"], "shown": [h["shown"] for h in burst]})

        def done() -> pa.RecordBatch:
            arrays = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return arrays

        for batch in batches:
            if schema is None:
                of = batch.schema
                schema = pa.schema([*[of.field(c) for c in by], ("start_ts", pa.timestamp("us")), ("n", pa.int64()), of.field("event_id"), of.field("channel"), of.field("record_id"), ("shown", pa.list_(pa.string()))])
            for hit in batch.to_pylist():
                run = (*[hit[c] for c in by], hit["run"])
                settle(None if run != open_run else hit["us"])
                open_run = run
                held.append(hit)
            if out:
                yield done()
        settle(None)
        if out:
            yield done()

    ordered = ordered.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return ordered.mapInArrow(search, T.StructType(fields))
