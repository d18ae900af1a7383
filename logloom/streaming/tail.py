"""Operators over growing inputs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from logloom.operators.clusters import settled
from logloom.schema import SILVER
from logloom.sources import logs as L


def silver_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a silver table as a stream."""
    return spark.readStream.schema(SILVER).parquet(folder)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream (in append mode) has given so far, after all that is there now was worked off. The folder holds its
    rows and its checkpoint: the same stream over the same folder goes on where it ended."""
    rows = f"{folder.rstrip('/')}/rows"
    run = stream.writeStream.format("parquet").outputMode("append").option("path", rows).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The silver rows of binary logs as they appear in a folder, a file whole and once."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[eE][vV][tT][xX]").load(folder)
    return L.decoded(L.chunks(found.select(F.col("path").alias("source"), "content")))


def frequency_windows(evt: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by id and tumbling window; what comes later than `late` is dropped and its state freed."""
    timed = evt.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_id", "n")


def burst_sessions(evt: DataFrame, gap: str = "60 seconds", least: int = 3, late: str = "10 minutes") -> DataFrame:
    """Runs of events of one computer and id whose gaps are below `gap`, with at least `least` events."""
    timed = evt.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    runs = timed.groupBy(F.session_window("at", gap), "computer", "event_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= least).select(F.col("session_window.start").alias("start"), "computer", "event_id", "n")


class _Timed(StatefulProcessor):
    """Rows of a key wait in state until the watermark has passed them, so that they are seen in order of time
    however they come. One timer a key, at the next time at which something can be decided."""

    waits = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.names = [x.split()[0] for x in self.waits.split(", ")]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        for part in rows:
            self.waiting.appendList([tuple(None if pd.isna(x) else x for x in r) for r in part[self.names].astype(object).itertuples(index=False)])
        self._wake([r[0] for r in self.waiting.get()])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted((dict(zip(self.names, r, strict=True)) for r in self.waiting.get()), key=lambda r: (r["us"], r["record_id"]))
        out = self.decide(key, held, timerValues.getCurrentWatermarkInMs() * 1000)
        self.waiting.put([tuple(r.values()) for r in held]) if held else self.waiting.clear()
        self._wake([r["us"] for r in held])
        yield pd.DataFrame(out, columns=self.columns)

    def _wake(self, waiting: list[int]) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        times = [t for t in (self.next(min(waiting)) if waiting else None, self.forgets()) if t is not None]
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def next(self, us: int) -> int:
        """When something can be decided about the first row that waits."""
        return us

    def forgets(self) -> int | None:
        """When other state of the key ends."""
        return None

    def decide(self, key: tuple, held: list[dict], now: int) -> list[tuple]:
        """The result rows of what the watermark has passed, which leaves held."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Pairs(_Timed):
    waits, columns = "us long, record_id long, event_id int", ["logon_id", "logon_us", "logoff_us"]

    def __init__(self, keep_us: int) -> None:
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.opened = handle.getValueState("opened", "us long")

    def forgets(self) -> int | None:
        return self.opened.get()[0] + self.keep_us if self.opened.exists() else None

    def decide(self, key: tuple, held: list[dict], now: int) -> list[tuple]:
        opened, out = self.opened.get()[0] if self.opened.exists() else None, []
        while held and held[0]["us"] < now:
            r = held.pop(0)
            if opened is not None and r["us"] > opened + self.keep_us:
                opened = None
            if r["event_id"] == 4624:
                opened = r["us"]
            elif opened is not None:
                out.append((key[0], opened, r["us"]))
                opened = None
        if opened is None or now > opened + self.keep_us:
            self.opened.clear()
        else:
            self.opened.update((opened,))
        return out


def logon_pairs(evt: DataFrame, late: str = "10 minutes", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """logon_id, logon_us, logoff_us of sessions, once the watermark has passed their end: one open logon is kept for
    each id, a new one replaces it. Events count in order of time; what comes later than `late` is dropped. A logon
    that nothing has ended after `keep` is forgotten, so state ends. Needs session.STATE_STORE."""
    at = F.col("ts").cast("timestamp")
    keyed = evt.filter(F.col("event_id").isin(4624, 4634, 4647) & at.isNotNull()).select(F.col("data")["TargetLogonId"].alias("logon_id"), "event_id", F.unix_micros(at).alias("us"), "record_id", at.alias("at"))
    keyed = keyed.filter("logon_id is not null").withWatermark("at", late)
    pairs = _Pairs(keep // timedelta(microseconds=1))
    return keyed.groupBy("logon_id").transformWithStateInPandas(pairs, "logon_id string, logon_us long, logoff_us long", "Append", "EventTime")


class _Bursts(_Timed):
    waits = "us long, record_id long, shown string"
    columns = ["computer", "start_us", "n", "record_id", "shown"]

    def __init__(self, width_us: int, least: int) -> None:
        self.width_us, self.least = width_us, least

    def next(self, us: int) -> int:
        return us + self.width_us

    def decide(self, key: tuple, held: list[dict], now: int) -> list[tuple]:
        return [(key[0], b[0]["us"], len(b), b[-1]["record_id"], [h["shown"] for h in b]) for b in settled(held, now, self.width_us, self.least)]


def burst_alarms(hits: DataFrame, width_us: int, least: int, late: str = "10 minutes") -> DataFrame:
    """computer, start_us, n, record_id (of the last hit), shown of the bursts that operators.clusters.bursts() finds on each
    computer, once the watermark has passed their width. hits: computer, ts, record_id, shown. A computer's state
    is the hits of its last width."""
    at = F.col("ts").cast("timestamp")
    timed = hits.filter(at.isNotNull() & F.col("computer").isNotNull()).select("computer", F.unix_micros(at).alias("us"), "record_id", "shown", at.alias("at")).withWatermark("at", late)
    return timed.groupBy("computer").transformWithStateInPandas(_Bursts(width_us, least), "computer string, start_us long, n long, record_id long, shown array<string>", "Append", "EventTime")
