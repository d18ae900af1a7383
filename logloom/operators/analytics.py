"""Timelines, sessions, graphs, frequencies, searches, indicators and differences of event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import columns as C

LOGON, LOGOFF = 4624, (4634, 4647)


# ---- timelines and limits ----
def timeline(evt: DataFrame, event_ids: list[int] | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """The events in a half-open time range. Filters stay below any sort, so they reach the scan."""
    out = evt
    if event_ids:
        out = out.filter(F.col("event_id").isin(event_ids))
    if after:
        out = out.filter(F.col("ts") >= F.lit(after).cast("timestamp_ntz"))
    if before:
        out = out.filter(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return out.select("record_id", "ts", "event_id", "level", "channel", "computer", "provider")


def first_events(evt: DataFrame, n: int) -> DataFrame:
    """The n earliest events; ties by record id (a heap per task, no full sort)."""
    return evt.orderBy("ts", "record_id").limit(n)


# ---- sessions ----
def _with_next(rows: DataFrame, by: list[str], hot_rows: int) -> DataFrame:
    """rows with next_id and next_ts: event_id and ts of the next row of the same key, by ts and record_id.

    One shuffle by key, but for keys with more than hot_rows rows. Those are cut into slices of time of about
    hot_rows rows each; a slice gives its first row, and the next slice's first row follows a slice's last.
    So what is ordered for a whole hot key is one row a slice. At most count / hot_rows keys are hot, and
    broadcast. Rows at one instant stay in one slice.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    slices = F.ceil(F.col("_n") / hot_rows)
    hot = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(us).alias("_from"), F.max(us).alias("_to")).filter(F.col("_n") > hot_rows)
    hot = F.broadcast(hot.select(*by, "_from", F.greatest(F.ceil((F.col("_to") - F.col("_from") + 1) / slices), F.lit(1)).alias("_width")))

    def following(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("ts", "record_id")
        return df.withColumn("_next", F.lead(F.struct("event_id", "ts")).over(w))

    plain = following(rows.join(hot, by, "left_anti"), *by)
    cut = rows.join(hot, by).withColumn("_slice", F.coalesce(F.floor((us - F.col("_from")) / F.col("_width")), F.lit(-1))).drop("_from", "_width")
    firsts = cut.groupBy(*by, "_slice").agg(F.min_by(F.struct("event_id", "ts"), F.struct("ts", "record_id")).alias("_first"))
    firsts = firsts.select(*by, "_slice", F.lead("_first").over(Window.partitionBy(*by).orderBy("_slice")).alias("_first"))
    sliced = following(cut, *by, "_slice").join(firsts, [*by, "_slice"]).withColumn("_next", F.coalesce("_next", "_first"))
    both = plain.unionByName(sliced.select(*plain.columns))
    return both.withColumn("next_id", F.col("_next.event_id")).withColumn("next_ts", F.col("_next.ts")).drop("_next")


def logon_sessions(evt: DataFrame, by_host: bool = False, hot_rows: int = 1_000_000, logon_type: int | None = None) -> DataFrame:
    """Logons (of a type, if given) with the logoff that ends them, if any.

    A logon with the same id before a logoff discards the earlier one; logoffs without logon or id are
    dropped. One shuffle by id (and computer, with by_host, which also keeps well-known ids apart); ids with
    more than hot_rows events are paired in slices of time (_with_next).
    """
    key = F.coalesce(F.col("data")["TargetLogonId"], F.when(F.col("event_id") == LOGON, F.lit("-")))
    rows = evt.filter(F.col("event_id").isin(LOGON, *LOGOFF)).withColumn("logon_id", key).filter("logon_id is not null")
    rows = _with_next(rows, ["logon_id", *(["computer"] if by_host else [])], hot_rows)
    rows = rows.filter((F.col("event_id") == LOGON) & (F.col("next_id").isNull() | (F.col("next_id") != LOGON)))
    kind = F.coalesce(F.col("data")["LogonType"].try_cast("int"), F.lit(0))
    if logon_type is not None:
        rows = rows.filter(kind == logon_type)
    ip = F.col("data")["IpAddress"]
    return rows.select(
        "logon_id",
        "computer",
        F.col("data")["TargetUserName"].alias("username"),
        F.col("data")["TargetDomainName"].alias("domain"),
        kind.alias("logon_type"),
        F.when(~ip.isin("", "-"), ip).alias("ip_address"),
        F.col("ts").alias("logon_ts"),
        F.when(F.col("next_id").isNotNull(), F.col("next_ts")).alias("logoff_ts"),
        F.floor((F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000).cast("long").alias("duration_secs"),
    )


# ---- graphs ----
def logon_edges(evt: DataFrame) -> DataFrame:
    """source, target, logon_type, n over all logons that say where they came from."""
    kind = F.coalesce(F.col("data")["LogonType"].try_cast("int"), F.lit(0))
    rows = evt.filter(F.col("event_id") == LOGON).select(C.logon_source(kind, F.col("data")["WorkstationName"], F.col("data")["IpAddress"]).alias("source"), F.col("computer").alias("target"), kind.alias("logon_type"))
    return rows.filter("source is not null").groupBy("source", "target", "logon_type").agg(F.count(F.lit(1)).alias("n"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Both ends of each edge, once; exploded, so the edges are computed once."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def process_nodes(evt: DataFrame) -> DataFrame:
    """pid, ppid, image, command_line and ts of every process creation."""
    d, audit = F.col("data"), F.col("event_id") == 4688
    return evt.filter(F.col("event_id").isin(4688, 1)).select(
        "record_id",
        "ts",
        "computer",
        F.when(audit, C.hex_number(d["NewProcessId"])).otherwise(C.decimal_number(d["ProcessId"])).alias("pid"),
        F.when(audit, C.hex_number(d["ProcessId"])).otherwise(C.decimal_number(d["ParentProcessId"])).alias("ppid"),
        F.coalesce(F.when(audit, d["NewProcessName"]).otherwise(d["Image"]), F.lit("-")).alias("image"),
        F.coalesce(d["CommandLine"], F.lit("")).alias("command_line"),
    )


def process_parents(nodes: DataFrame) -> DataFrame:
    """Each process with the latest earlier process on its computer that had its ppid as pid.

    An as-of join in one window: rows of both roles are sorted by time within (computer, pid), and the last
    parent row before a child is carried forward. One shuffle, no range join.
    """
    parents = nodes.select("computer", F.col("pid").alias("key"), "ts", "record_id", F.lit(0).alias("child"), F.col("image").alias("p_image"), F.col("record_id").alias("p_record"))
    children = nodes.select("computer", F.col("ppid").alias("key"), "ts", "record_id", F.lit(1).alias("child"), F.lit(None).cast("string").alias("p_image"), F.lit(None).cast("long").alias("p_record"))
    w = Window.partitionBy("computer", "key").orderBy("ts", "record_id", F.desc("child")).rowsBetween(Window.unboundedPreceding, -1)
    both = parents.unionByName(children).withColumn("parent_image", F.last("p_image", ignorenulls=True).over(w)).withColumn("parent_record", F.last("p_record", ignorenulls=True).over(w))
    return both.filter("child = 1").select("record_id", "parent_record", "parent_image")


# ---- frequencies ----
def frequency(evt: DataFrame, key: str = "event_id") -> DataFrame:
    return evt.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def z_scores(counts: DataFrame, least: float = 2.0, n: str = "n") -> DataFrame:
    """Counts whose distance from the mean of all is at least `least` population standard deviations.

    The mean and deviation are one row, joined to the counts (which are small beside the events)."""
    stats = counts.agg(F.avg(n).alias("_mean"), F.stddev_pop(n).alias("_sd"))
    z = F.when(F.col("_sd") > 0, (F.col(n) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return counts.crossJoin(F.broadcast(stats)).withColumn("z", z).filter(F.abs("z") >= least).drop("_mean", "_sd")


def rare(evt: DataFrame, keys: list[str], below: int) -> DataFrame:
    """Keys with fewer than `below` events, with their first and last time."""
    return evt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).filter(F.col("n") < below)


def rare_processes(evt: DataFrame, below: int) -> DataFrame:
    return rare(process_nodes(evt), ["image"], below)


def field_values(evt: DataFrame, name: str) -> DataFrame:
    """How often each value of a field occurs: one of the data, or with System. before it one of the System part.
    With a column leaves (sources.logs) it is any string of that name, or path, at any depth."""
    if "leaves" in evt.columns:
        each = evt.select(F.explode(F.filter("leaves", lambda x: (x["name"] == name) | (x["path"] == name))).alias("x"))
        return each.groupBy(F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    value = F.col(name.removeprefix("System.")).cast("string") if name.startswith("System.") else F.col("data")[name]
    return evt.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


# ---- search ----
_SAID = ("channel", "computer", "provider", "provider_guid", "user_sid")


def _holds(text: Column | str, query: str) -> Column:
    """Whether text holds the query, whatever the case of ASCII letters: what Java's flag without Unicode folds."""
    return F.rlike(text, F.lit("(?i)\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"))


def search_text(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows with the query in any of the text columns, whatever the case of ASCII letters."""
    return df.filter(reduce(Column.__or__, [F.coalesce(_holds(F.col(c), query), F.lit(False)) for c in columns]))


def search_events(evt: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Events with the query in any of their strings. Without regex, whatever the case of ASCII letters.

    With a column leaves (sources.logs) those are all strings at any depth, names given as attributes too; without
    it, values of data and what the System part says."""

    def hit(text: Column) -> Column:
        return text.rlike(query) if regex else _holds(text, query)

    if "leaves" in evt.columns:
        return evt.filter(F.exists("leaves", lambda x: hit(x["value"])))
    found = [F.coalesce(hit(F.col(c)), F.lit(False)) for c in _SAID]
    return evt.filter(reduce(Column.__or__, found) | F.coalesce(F.exists(F.map_values("data"), hit), F.lit(False)))


def search_regex(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    return df.filter(reduce(Column.__or__, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns]))


# ---- indicators ----
IOC_KINDS = {"ip_address": C.IPV4, "sha256": C.SHA256, "sha1": C.SHA1, "md5": C.MD5, "file_path": C.FILE_PATH}


def _matches(text: Column, kind: str) -> Column:
    fold = kind in ("md5", "sha1", "sha256")
    hits = F.regexp_extract_all(text, F.lit(IOC_KINDS[kind]), F.lit(0))
    return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), (F.lower(h) if fold else h).alias("value")))


def indicators(rows: DataFrame, text: str, record: str = "record_id", ts: str | None = "ts", kinds: list[str] | None = None, keep_records: int = 10) -> DataFrame:
    """kind, value, n (matches), first_seen, last_seen and the first record ids of every indicator in a text.

    Hashes are in lower case; 0.0.0.0, 255.255.255.255 and 127.0.0.1 are left out. Record ids are those of
    the first keep_records matching records, once each (a display limit; n counts all). They are kept small
    while aggregating: matches are counted by record first, then ranked.
    """
    found = []
    for kind in kinds or list(IOC_KINDS):
        found.append(_matches(F.col(text), kind))
    hits = rows.select(F.col(record).alias("r"), (F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")).alias("t"), F.explode(F.concat(*found)).alias("i")).select("r", "t", "i.*")
    hits = hits.filter(~((F.col("kind") == "ip_address") & F.col("value").isin("0.0.0.0", "255.255.255.255", "127.0.0.1")))
    by_record = hits.groupBy("kind", "value", "r").agg(F.count(F.lit(1)).alias("c"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    # The first records of a value are cut in every task before they meet, so no value gathers all of its rows in one.
    rank = F.row_number().over(Window.partitionBy("kind", "value").orderBy("t0", "r"))
    first = by_record.withColumn("k", rank).filter(F.col("k") <= keep_records)
    first = first.groupBy("kind", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda s: s["r"]).alias("record_ids"))
    counts = by_record.groupBy("kind", "value").agg(F.sum("c").cast("long").alias("n"), F.min("t0").alias("first_seen"), F.max("t1").alias("last_seen"))
    return counts.join(first, ["kind", "value"])


# ---- script blocks ----
def script_blocks(evt: DataFrame) -> DataFrame:
    """PowerShell scripts put together from their 4104 fragments, in the order of their numbers."""
    d = F.col("data")
    parts = evt.filter(F.col("event_id") == 4104).select(
        d["ScriptBlockId"].alias("script_id"), F.coalesce(d["MessageNumber"].try_cast("int"), F.lit(1)).alias("part"), "record_id", "ts", F.coalesce(d["ScriptBlockText"], F.lit("")).alias("text"), d["Path"].alias("path")
    )
    return joined_parts(parts.filter("script_id is not null"), ["script_id"], ["part", "record_id"], "text", "").withColumn("decoded", C.decoded_command(F.col("text")))


def joined_parts(parts: DataFrame, keys: list[str], order: list[str], text: str, between: str) -> DataFrame:
    """keys, parts (their number), path (of the first, if there) and the texts of a key joined in order."""
    first = [F.min_by("path", F.struct(*order)).alias("path")] if "path" in parts.columns else []
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda s: s["_t"]), between)
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), *first, whole.alias("text"))


# ---- differences ----
def difference(a: DataFrame, b: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """What b has and a lacks, and the reverse, by key."""
    return b.join(a.select(key), key, "left_anti"), a.join(b.select(key), key, "left_anti")


# ---- summary ----
def summary(evt: DataFrame, top: int = 5) -> DataFrame:
    """source, n_events, first and last time, and the most frequent event ids of each source."""
    counts = evt.groupBy("source", "event_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_id", "n"))), 1, top)
    return counts.groupBy("source").agg(F.sum("n").cast("long").alias("n_events"), F.min("t0").alias("first_ts"), F.max("t1").alias("last_ts"), F.transform(ranked, lambda s: F.struct(s["event_id"].alias("event_id"), s["n"].alias("n"))).alias("top_ids"))


def info(logs: DataFrame, stats: DataFrame, evt: DataFrame, findings: DataFrame, iocs: DataFrame | None = None, top: int = 5) -> DataFrame:
    """A row for each log (source, content): its SHA-256, counts of chunks and records, events, time range, most
    frequent ids, integrity findings and distinct indicators. stats: sources.logs.carve_stats; findings: rows by
    source; iocs: rows (source, kind, value), by default those in the values of evt's data."""
    if iocs is None:
        text = F.array_join(F.map_values("data"), "\n")
        found = F.concat(*[_matches(text, kind) for kind in IOC_KINDS])
        iocs = evt.select("source", F.explode(found).alias("i")).select("source", "i.*")
        iocs = iocs.filter(~((F.col("kind") == "ip_address") & F.col("value").isin("0.0.0.0", "255.255.255.255", "127.0.0.1")))
    counted = iocs.select("source", "kind", "value").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_iocs"))
    odd = findings.groupBy("source").agg(F.count(F.lit(1)).alias("n_findings"))
    out = logs.select("source", F.sha2("content", 256).alias("sha256")).join(stats, "source", "left").join(summary(evt, top), "source", "left").join(odd, "source", "left").join(counted, "source", "left")
    return out.fillna(0, ["n_events", "n_findings", "n_iocs"])
