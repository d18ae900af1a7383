"""Integrity of logs: checksums, gaps, clocks, spoofed providers, tampered tracing sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.columns import normal_guid
from logloom.schema import EPOCH_TICKS
from logloom.sources import logs as L

ANOMALY = ("source", "code", "severity", "verify_severity", "chunk_offset", "record_id", "expected", "found", "details")

# ---- Fixed values ----
SEVERITY = {
    "SURGICAL_RECORD_DELETION": ("Critical", "critical"),
    "RECORD_ID_GAP": ("High", "critical"),
    "CHUNK_CHECKSUM_MISMATCH": ("High", "warning"),
    "RECORD_CHECKSUM_MISMATCH": ("High", "warning"),
    "FILE_HEADER_CHECKSUM_MISMATCH": ("High", "warning"),
    "LOG_FILE_GUID_MISMATCH": ("High", "warning"),
    "NEXT_RECORD_ID_INCONSISTENCY": ("High", "warning"),
    "CHUNK_COUNT_MISMATCH": ("High", "warning"),
    "INVALID_CHUNK_DATA_LENGTH": ("High", "warning"),
    "TRUNCATED_FILE": ("High", "warning"),
    "TRAILING_DATA": ("High", "warning"),
    "OVERLAPPING_CHUNKS": ("High", "warning"),
    "PHANTOM_RECORD_INJECTION": ("High", "error"),
    "TIMESTAMP_ANOMALY": ("Medium", "critical"),
    "EXPORT_TIMESTAMP_CORRUPTION": ("Medium", "info"),
    "FILE_NOT_CLEANLY_SHUTDOWN": ("Medium", "warning"),
    "FILE_FULL": ("Medium", "warning"),
    "EMPTY_LOG": ("Medium", "info"),
    "LOG_CLEARED": ("Medium", "info"),
}
RANK = {"Critical": 3, "High": 2, "Medium": 1, "critical": 3, "error": 2, "warning": 1, "info": 0}
PROVIDERS = [
    (
        "Microsoft-Windows-Security-Auditing",
        "54849625-5478-4994-A5BA-3E3B0328C30D",
        "Security",
        [
            1100, 1102, 1104, 4608, 4616, 4624, 4625, 4634, 4647, 4648, 4649, 4656, 4657, 4660, 4663, 4670, 4672, 4673, 4674, 4688, 4689, 4698, 4699, 4700, 4702,
            4719, 4720, 4722, 4723, 4724, 4725, 4726, 4728, 4729, 4732, 4733, 4740, 4741, 4742, 4743, 4756, 4757, 4767, 4768, 4769, 4770, 4771, 4776, 4798, 4799,
        ],
    ),
    ("Microsoft-Windows-PowerShell", "A0C1853B-5C40-4B15-8766-3CF1C58F985A", "Microsoft-Windows-PowerShell/Operational", [4100, 4103, 4104, 4105, 4106]),
    ("Microsoft-Windows-Sysmon", "5770385F-C22A-43E0-BF4C-06F5698FFBD9", "Microsoft-Windows-Sysmon/Operational", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29]),
    (
        "Microsoft-Windows-TaskScheduler",
        "DE7B24EA-73C8-4A09-985D-5BDADCFA9017",
        "Microsoft-Windows-TaskScheduler/Operational",
        [100, 101, 102, 103, 104, 106, 107, 108, 110, 111, 118, 119, 120, 121, 122, 123, 124, 125, 126, 127, 129, 130, 140, 141, 200, 201, 202, 203],
    ),
]
ETW_SESSIONS = ("EventLog-Application", "EventLog-Security", "EventLog-System")
# ---- End of fixed values ----


# ---- gaps, clocks: windows over one ordering each ----
def id_gaps(rows: DataFrame, by: list[str], order: str, first: str, last: str) -> DataFrame:
    """Neighbours in `order` where `first` isn't the `last` before plus one: expected and found."""
    before = F.lag(last).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("expected", before + 1).withColumn("found", F.col(first)).filter("found <> expected")


def backward_clocks(rows: DataFrame, by: list[str], order: str, ts: str) -> DataFrame:
    """Rows that are earlier than the one before them in `order`."""
    before = F.lag(ts).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("previous_ts", before).filter(F.col(ts) < F.col("previous_ts"))


def phantom_gaps(rows: DataFrame, by: list[str], record: str = "record_id", ns: str = "ts_ns", least_ns: int = 1_000_000) -> DataFrame:
    """Gaps in record ids that the clock has no room for: less than least_ns for each missing record, or time
    running backwards. Repeated ids are no gap."""
    w = Window.partitionBy(*by).orderBy(record)
    out = rows.withColumn("prev_id", F.lag(record).over(w)).withColumn("delta_ns", F.col(ns) - F.lag(ns).over(w))
    out = out.withColumn("missing", F.col(record) - F.col("prev_id") - 1).filter("missing > 0")
    return out.filter((F.col("delta_ns") <= 0) | (F.col("delta_ns") / F.col("missing") < least_ns))


def changed_values(rows: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Rows whose value differs from that of the first row of their group."""
    first = F.first_value(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("first_value", first).filter(F.col(column) != F.col("first_value"))


# ---- whole logs ----
def _finding(code: str, when: Column, expected: Column | None = None, found: Column | None = None) -> Column:
    said = [F.lit(None).cast("string") if x is None else x.cast("string") for x in (expected, found)]
    return F.when(when, F.struct(F.lit(code).alias("code"), *(F.lit(x).alias(n) for x, n in zip(SEVERITY[code], ("severity", "verify_severity"), strict=True)), said[0].alias("expected"), said[1].alias("found")))


def _of_file() -> list[Column]:
    c = F.col
    return [
        _finding("TRUNCATED_FILE", c("length") < 128),
        _finding("FILE_HEADER_CHECKSUM_MISMATCH", c("checksum") != c("computed"), c("computed"), c("checksum")),
        _finding("FILE_NOT_CLEANLY_SHUTDOWN", c("flags").bitwiseAND(1) != 0),
        _finding("FILE_FULL", c("flags").bitwiseAND(2) != 0),
        _finding("EMPTY_LOG", c("chunk_count") == 0),
        _finding("CHUNK_COUNT_MISMATCH", c("chunk_count") != c("chunks"), c("chunk_count"), c("chunks")),
        _finding("NEXT_RECORD_ID_INCONSISTENCY", c("next_id") <= c("top"), c("top") + 1, c("next_id")),
        _finding("TRAILING_DATA", c("used_end") > c("chunks_end"), c("chunks_end"), c("length") - c("chunks_end")),
    ]


def _of_chunk() -> list[Column]:
    c, whole = F.col, F.col("whole")
    return [
        _finding("CHUNK_CHECKSUM_MISMATCH", whole & (c("head_sum") != c("head_computed")), c("head_computed"), c("head_sum")),
        _finding("RECORD_CHECKSUM_MISMATCH", whole & (c("records_sum") != c("records_computed")), c("records_computed"), c("records_sum")),
        _finding("INVALID_CHUNK_DATA_LENGTH", whole & ~c("free_at").between(512, 65536), None, c("free_at")),
        _finding("RECORD_ID_GAP", whole & (c("first_number") != c("before") + 1), c("before") + 1, c("first_number")),
        _finding("LOG_FILE_GUID_MISMATCH", whole & (c("guid") != c("first_guid")), c("first_guid"), c("guid")),
        _finding("OVERLAPPING_CHUNKS", c("covered") > c("chunk_offset"), c("covered"), c("chunk_offset")),
    ]


def _of_record() -> list[Column]:
    c, delta = F.col, F.col("ts_ns") - F.col("prev.ts_ns")
    missing = F.col("record_id") - F.col("prev.record_id") - 1
    return [
        _finding("SURGICAL_RECORD_DELETION", c("nested_at").isNotNull(), None, c("nested_at")),
        _finding("EXPORT_TIMESTAMP_CORRUPTION", c("filetime") == 0),
        _finding("TIMESTAMP_ANOMALY", (c("filetime") != 0) & (c("earlier.chunk_offset") == c("chunk_offset")) & (c("filetime") < c("earlier.filetime")), c("earlier.filetime"), c("filetime")),
        _finding("PHANTOM_RECORD_INJECTION", (missing > 0) & ((delta <= 0) | (delta / missing < 1_000_000)), missing, delta),
    ]


_FULL_ONLY = ("EMPTY_LOG", "LOG_FILE_GUID_MISMATCH", "INVALID_CHUNK_DATA_LENGTH", "TIMESTAMP_ANOMALY", "PHANTOM_RECORD_INJECTION")


def findings(facts: DataFrame, mode: str = "full", least: str | None = None) -> DataFrame:
    """source, code, severity, verify_severity, chunk_offset, record_id, expected, found, details: all anomalies, each once,
    of the rows that sources.logs.facts() and its like give of files, chunks and records.

    One pass: rows meet their neighbours in windows over one shuffle by source, then each yields an array of what is
    wrong with it. Among chunks these are the one before (numbers), the first (GUID) and the furthest end of all
    before (overlaps); of a file, its chunks; among records those with a time, by place within a chunk (clocks) and by id (gaps
    that the clock has no room for; times too far away to fit into nanoseconds say nothing of gaps).
    mode "carve" leaves out clocks, phantom gaps, GUIDs, extents and empty logs. least: the lowest severity to
    report, on either scale (High, say, or warning).
    """
    if least is not None and least not in RANK:
        raise ValueError(f"no severity {least!r}; there are {', '.join(RANK)}")
    a_chunk, whole = F.col("kind") == 1, F.col("whole")
    timed = (F.col("kind") == 2) & (F.col("filetime") != 0)
    # From 1970, so that nanoseconds fit.
    ns = F.when(timed, F.try_multiply(F.try_subtract("filetime", F.lit(EPOCH_TICKS)), F.lit(100).cast("long")))
    rows = facts.filter("kind < 3").drop("found", "records").withColumn("ts_ns", ns)
    log = Window.partitionBy("source")
    place = Window.partitionBy("source", "kind").orderBy("chunk_offset", "record_offset")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "before": F.last(F.when(whole, F.col("last_number")), ignorenulls=True).over(before),
            "first_guid": F.first(F.when(whole, F.col("guid")), ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0)),
            "covered": F.max(F.when(whole, F.col("chunk_offset") + F.col("size"))).over(before),
            "earlier": F.last(F.when(timed, F.struct("chunk_offset", "filetime")), ignorenulls=True).over(before),
        }
    )
    fits = F.col("ts_ns").isNotNull()
    by_id = Window.partitionBy("source", "kind", fits).orderBy("record_id")
    rows = rows.withColumn("prev", F.when(fits, F.lag(F.struct("record_id", "ts_ns")).over(by_id)))
    rows = rows.withColumns({"chunks": F.count_if(a_chunk).over(log), "top": F.max(F.when(a_chunk, F.col("last_id"))).over(log), "chunks_end": F.max(F.when(whole, F.col("chunk_offset") + F.col("size"))).over(log)})
    said = F.when(F.col("kind") == 0, F.array(*_of_file())).when(a_chunk, F.array(*_of_chunk())).otherwise(F.array(*_of_record()))
    out = rows.select("source", "chunk_offset", "record_id", F.inline(F.array_compact(said)))
    out = out.select("source", "code", "severity", "verify_severity", "chunk_offset", "record_id", "expected", "found", F.lit(None).cast("string").alias("details"))
    if mode == "carve":
        out = out.filter(~F.col("code").isin(*_FULL_ONLY))
    if least is not None:
        scale = "severity" if least in ("Critical", "High", "Medium") else "verify_severity"
        out = out.filter(F.col(scale).isin([s for s in {v[0 if scale == "severity" else 1] for v in SEVERITY.values()} if RANK[s] >= RANK[least]]))
    return out.dropDuplicates()


def verify(logs: DataFrame, found_chunks: DataFrame | None = None, recs: DataFrame | None = None, mode: str = "full", least: str | None = None) -> DataFrame:
    """findings() of logs (source, content), which are read once. Where chunk rows are given, they and their records
    (those of recs, if given) count instead of the logs' own: chunks that were carved, say."""
    facts = L.facts(logs, inside=found_chunks is None)
    if found_chunks is not None:
        facts = facts.unionByName(L.facts_of_chunks(found_chunks).filter("kind = 1" if recs is not None else "true"))
    if recs is not None:
        facts = facts.unionByName(recs.select("source", F.lit(2).alias("kind"), "chunk_offset", "record_offset", "record_id", "filetime", "nested_at"), allowMissingColumns=True)
    return findings(facts, mode, least)


def cleared_logs(evt: DataFrame) -> DataFrame:
    return evt.filter(((F.col("event_id") == 1102) & (F.col("channel") == "Security")) | ((F.col("event_id") == 104) & (F.col("channel") == "System")))


def provider_inconsistencies(evt: DataFrame) -> DataFrame:
    """record_id, code, expected, found: providers whose GUID, event id or channel is not theirs. One pass: each event
    meets what is known of its provider's name and of its GUID, a constant table of a few rows."""
    known = evt.sparkSession.createDataFrame([(n, "{" + g.lower() + "}", c, i) for n, g, c, i in PROVIDERS], "name string, guid string, channel string, ids array<int>")
    by_name = F.broadcast(known.select(F.col("name").alias("n_name"), F.col("guid").alias("n_guid"), F.col("ids").alias("n_ids")))
    by_guid = F.broadcast(known.select(F.col("guid").alias("g_guid"), F.col("channel").alias("g_channel")))
    rows = evt.select("record_id", "event_id", "provider", "channel", normal_guid(F.col("provider_guid")).alias("own_guid"))
    rows = rows.join(by_name, F.col("provider") == F.col("n_name"), "left").join(by_guid, F.col("own_guid") == F.col("g_guid"), "left")
    said = lambda code, when, expected, found: F.when(when, F.struct(F.lit(code).alias("code"), expected.cast("string").alias("expected"), F.col(found).cast("string").alias("found")))
    odd = F.array(
        said("GUID_SPOOFING", F.col("own_guid") != F.col("n_guid"), F.col("n_guid"), "own_guid"),
        said("UNEXPECTED_EVENT_ID", ~F.array_contains("n_ids", F.col("event_id")), F.lit(None), "event_id"),
        said("CHANNEL_MISMATCH", F.col("channel") != F.col("g_channel"), F.col("g_channel"), "channel"),
    )
    return rows.select("record_id", F.inline(F.array_compact(odd)))


def tracing_tampering(sessions: DataFrame) -> DataFrame:
    """session, code of tracing sessions (name, running, events_lost, log_mode, buffers) that look tampered with."""
    spark = sessions.sparkSession
    required = spark.createDataFrame([(n,) for n in ETW_SESSIONS], "name string")
    ours = F.startswith("name", F.lit("EventLog-"))
    parts = [
        required.join(sessions.select("name"), "name", "left_anti").select("name", F.lit("SESSION_MISSING").alias("code")),
        sessions.filter("events_lost > 1000").select("name", F.lit("EVENTS_LOST").alias("code")),
        sessions.filter("log_mode = 0").select("name", F.lit("LOG_MODE_ZERO").alias("code")),
        sessions.filter(ours & ~F.col("running")).select("name", F.lit("SESSION_STOPPED").alias("code")),
        sessions.filter(F.col("running") & (F.col("buffers") == 0)).select("name", F.lit("NO_BUFFERS").alias("code")),
    ]
    return reduce(DataFrame.unionByName, parts)
