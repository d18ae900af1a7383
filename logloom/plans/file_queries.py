"""Registered queries whose data go through files: repaired logs, manifests, sinks that are read back, triage, streams."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.container import evtx
from logloom.functions.columns import overlaid
from logloom.operators import analytics as A
from logloom.operators import detect as D
from logloom.operators import integrity as I
from logloom.operators.manifest import load_manifests, named_fields
from logloom.plans.adapter import events as raw_events
from logloom.plans.adapter import silver
from logloom.plans.log_queries import _in_files, _user, _with_bytes, made_logs
from logloom.plans.registry import query
from logloom.plans.triage import triage
from logloom.session import STATE_STORE, dropped, work_folder, written
from logloom.sinks import writers as W
from logloom.sources import logs as L
from logloom.sources import ranges as R
from logloom.streaming import tail


def _name() -> Column:
    return F.regexp_extract("source", "[^/]*$", 0).alias("source")


# ---- logs as files ----
@query("SELECT concat(logon_id, '.evtx') AS source, CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS n_mended, TRUE AS sound, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM evt GROUP BY logon_id, user_id")
def evtx_repair_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with a bit wrong in the file's header, or in the first chunk's, or nowhere, are repaired part by part, written, and
    read again: no checksum is wrong then, and all records are there. Slices of the logs come one after the other, and their
    files go when they are done with, so disk holds AT_ONCE bytes of logs twice, and not all of them."""
    out, n = f"{work_folder(spark, 'mended')}/rows", _slices(spark, sf_dir)
    with ThreadPoolExecutor(1) as beside:
        going = beside.submit(dropped, spark)
        for i in range(n):
            logs = made_logs(spark, sf_dir, of=F.pmod(F.xxhash64("source"), F.lit(n)) == i, streamed=True)
            third = _user() % 3
            logs = _with_bytes(logs, F.when(third == 0, 0x7C).when(third == 1, 4096 + 0x78).otherwise(8).cast("int"), F.when(third < 2, "00000000").otherwise(""))
            broken = _in_files(logs, "broken", ".evtx")
            going.result()
            folder = work_folder(spark, "repaired")
            named = W.repaired_parts(spark, broken, chunksPerTask="8").select(_name(), "chunk_offset", "content", "mended")
            mended = written(W.write_parts(named, folder, order="chunk_offset", count="mended"), "counts")
            # Many small files take a while to go: that is done beside the next step.
            going = beside.submit(dropped, spark, broken)
            _read_again(spark, folder, mended).write.mode("append").parquet(out)
            going.result()
            going = beside.submit(dropped, spark, folder)
        going.result()
    return spark.read.parquet(out)


def _read_again(spark: SparkSession, folder: str, mended: DataFrame) -> DataFrame:
    """The repaired logs in a folder: whether their checksums are right, and their records; mended: what write_parts() gave."""
    sums = F.col("code").isin("FILE_HEADER_CHECKSUM_MISMATCH", "CHUNK_CHECKSUM_MISMATCH", "RECORD_CHECKSUM_MISMATCH")
    # Checksums are facts of files and chunks; records need no windows for them.
    wrong = I.findings(R.log_ranges(spark, folder, rows="facts").filter("kind < 2"), mode="carve").filter(sums).select(_name()).distinct().withColumn("wrong", F.lit(True))
    events = R.log_ranges(spark, folder, columns="source string, record_id long", mode="FAILFAST").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))
    counts = mended.select(F.regexp_extract("path", "[^/]*$", 0).alias("source"), F.col("mended").cast("int").alias("n_mended"))
    found = counts.join(events.select(_name(), "n", "ids"), "source").join(wrong, "source", "left")
    return found.select("source", "n_mended", F.col("wrong").isNull().alias("sound"), "n", "ids")


#: Bytes of logs that evtx_repair_parts has on disk at once, twice (as they were made, and repaired).
AT_ONCE = 1 << 34


def _slices(spark: SparkSession, sf_dir: str) -> int:
    """Into how many slices, of whole logs, the logs of all users go: by their number and that of their records, each taken for a KiB."""
    n, users = raw_events(spark, sf_dir).agg(F.count(F.lit(1)), F.approx_count_distinct("user_id")).first()
    return max(1, -(-(users * (evtx.HEADER_BLOCK + evtx.CHUNK) + (n << 10)) // AT_ONCE))


@query("SELECT concat(logon_id, '.evtx') AS source, octet_length(encode(string_agg(n, ',' ORDER BY n))) AS length, sha256(string_agg(n, ',' ORDER BY n)) AS sha256 FROM evt GROUP BY logon_id")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files reached by two paths, each once, with the hash of all its bytes."""
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("record_id")), lambda n: n.cast("string")), ",")
    rows = silver(spark, sf_dir).groupBy(F.col("data")["TargetLogonId"].alias("source")).agg(F.encode(numbers, "UTF-8").alias("content"))
    folder = _in_files(rows, "found", ".evtx")
    return L.files(spark, folder, f"{folder}/*").select(_name(), "length", "sha256")


@query("SELECT logon_id AS source, record_id, CAST(event_id AS INT) AS event_id, target_user FROM (SELECT *, min(record_id) OVER (PARTITION BY logon_id) AS first_id FROM evt) WHERE NOT (user_id % 3 = 0 AND record_id = first_id)")
def evtx_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every third log the first record has no valid payload; it is left out, what follows is read."""
    logs = _with_bytes(made_logs(spark, sf_dir), 4096 + 512 + 24, F.when(_user() % 3 == 0, "AA").otherwise("0F"))
    return L.decoded(L.chunks(logs)).select("source", "record_id", "event_id", F.col("data")["TargetUserName"].alias("target_user"))


@query("SELECT concat(logon_id, '.evtx') AS source, 'filesystem' AS how, count(*) AS records, CASE user_id % 4 WHEN 0 THEN 'FILE_HEADER_CHECKSUM_MISMATCH' WHEN 1 THEN 'FILE_NOT_CLEANLY_SHUTDOWN' WHEN 2 THEN 'FILE_FULL' ELSE '' END AS findings FROM evt GROUP BY logon_id, user_id")
def triage_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a folder of logs, three in four of which have something wrong with their header. Clocks and gaps
    are as the events have them, and left out."""
    kind = _user() % 4
    logs = _with_bytes(made_logs(spark, sf_dir), F.when(kind == 0, 36).otherwise(0x78).cast("int"), F.when(kind == 0, "FF").when(kind == 1, "01").when(kind == 2, "02").otherwise(""))
    found = triage(spark, _in_files(logs, "triage", ".evtx"))
    shown = F.filter("findings", lambda c: F.startswith(c, F.lit("FILE_")))
    return found.select(_name(), "how", "records", F.array_join(shown, ",").alias("findings"))


@query("SELECT logon_id AS source, record_id, CASE record_id % 7 WHEN 0 THEN 'TOO_SHORT' WHEN 1 THEN 'INVALID_FRAGMENT_HEADER' WHEN 2 THEN 'UNKNOWN_OPCODE' WHEN 3 THEN 'STRING_TABLE_OVERFLOW' WHEN 4 THEN 'TRUNCATED' END AS problem, CASE record_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 4 END AS problem_at FROM evt")
def evtx_payload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of all records of binary logs, of which five in seven are cut off or have bytes laid over them."""
    p, kind = F.col("payload"), F.pmod("record_id", F.lit(7))
    over = lambda at, digits: overlaid(p, at, F.unhex(F.lit(digits)), len(digits) // 2)
    done = F.when(kind == 0, F.substring(p, 1, 2)).when(kind == 1, over(0, "AA")).when(kind == 2, over(4, "FF")).when(kind == 3, over(10, "FFFFFFFF")).when(kind == 4, F.substring(p, 1, 12)).otherwise(p)
    found = L.problems(L.records(L.chunks(made_logs(spark, sf_dir))).select("source", "record_id", done.alias("payload")))
    return found.select("source", "record_id", "problem", "problem_at")


# ---- manifests ----
@query("SELECT record_id, CASE WHEN event_id % 2 = 0 THEN concat('A', user_id % 3, '-', event_id) ELSE 'Param1' END AS name, target_user AS value, ip AS other FROM evt")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of three providers, a file each, which define the events with even ids by two fields; a second file of each,
    later in order, defines them otherwise, and doesn't count. Values of events are read by the names found."""
    evt = silver(spark, sf_dir).withColumn("provider_guid", F.concat(F.lit("{00000000-0000-0000-0000-00000000000"), F.substring("source", 4, 1), F.lit("}")))
    ids = evt.filter("event_id % 2 = 0").select("source", "provider_guid", "event_id").distinct()

    def manifest(name: str, first: str, fields: int) -> DataFrame:
        i, data = F.col("event_id"), F.lit('<data name="Address"/>' * (fields - 1))
        template = F.concat(F.lit('<template tid="t'), i, F.lit(f'"><data name="{first}'), F.substring("source", 4, 1), F.lit("-"), i, F.lit('"/>'), data, F.lit("</template>"))
        event = F.concat(F.lit('<event value="'), i, F.lit('" template="t'), i, F.lit('"/>'))
        inner = F.concat(F.lit("<events>"), F.array_join(F.collect_list(event), ""), F.lit("</events><templates>"), F.array_join(F.collect_list(template), ""), F.lit("</templates></provider></m>"))
        text = ids.groupBy("source", "provider_guid").agg(inner.alias("inner"))
        return text.select(F.concat(F.lit(name), "source").alias("source"), F.encode(F.concat(F.lit('<m xmlns="u"><provider guid="'), "provider_guid", F.lit('">'), "inner"), "UTF-8").alias("content"))

    known = load_manifests(spark, _in_files(manifest("1", "A", 2).unionByName(manifest("2", "B", 1)), "manifests", ".man"))
    d = F.col("data")
    rows = named_fields(evt.withColumn("data", F.create_map(F.lit("Param1"), d["TargetUserName"], F.lit("Param2"), d["IpAddress"])), known)
    name = F.element_at(F.filter(F.map_keys("data"), lambda k: ~k.isin("Address", "Param2")), 1)
    return rows.select("record_id", name.alias("name"), F.element_at("data", name).alias("value"), F.coalesce(d["Address"], d["Param2"]).alias("other"))


# ---- operators by the shell's options ----
@query("SELECT logon_id, CAST(logon_type AS INT) AS logon_type, count(*) AS n FROM (SELECT *, lead(event_id) OVER (PARTITION BY logon_id ORDER BY ts, record_id) AS next_id FROM evt WHERE event_id IN (4624, 4634, 4647)) WHERE event_id = 4624 AND logon_type = 10 AND next_id IS DISTINCT FROM 4624 GROUP BY ALL")
def logons_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.logon_sessions(silver(spark, sf_dir), logon_type=10)
    return found.groupBy("logon_id", "logon_type").agg(F.count(F.lit(1)).alias("n"))


OWN_RULES = (
    D.Rule("own_share", "T1135", "Discovery", lambda: F.col(D.EVENT).isin(5140, 5145) & F.endswith(F.col("data")["ShareName"], F.lit("public")), ("ShareName",)),
    D.Rule("own_service", "T1543.003", "Persistence", lambda: (F.col(D.EVENT) == 7045) & (F.lower(F.col("data")["ServiceName"]) == "w32time"), ("ServiceName",)),
)


@query("SELECT record_id, CASE WHEN event_id = 7045 THEN 'own_service' ELSE 'own_share' END AS kind, CASE WHEN event_id = 7045 THEN 'T1543.003' ELSE 'T1135' END AS technique FROM evt WHERE (event_id IN (5140, 5145) AND ends_with(share, 'public')) OR (event_id = 7045 AND service = 'w32time')")
def detect_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that aren't bundled, in one scan."""
    return D.detect_events(silver(spark, sf_dir), OWN_RULES).select("record_id", "kind", "technique")


# ---- sinks, read back ----
@query("SELECT record_id, CAST(ts AS VARCHAR) AS ts, event_id, target_user, CASE WHEN ip = '-' THEN NULL ELSE ip END AS ip FROM (SELECT record_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CAST(event_id AS INT) AS event_id, target_user, ip FROM evt)")
def ndjson_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table as NDJSON; a null stays a null."""
    d = F.col("data")
    folder = f"{work_folder(spark, 'ndjson')}/rows"
    evt = silver(spark, sf_dir)
    W.write_ndjson(evt.select("record_id", "ts", "event_id", F.struct(d["TargetUserName"].alias("user"), F.nullif(d["IpAddress"], F.lit("-")).alias("ip")).alias("who")), folder)
    found = spark.read.schema("record_id long, ts timestamp_ntz, event_id int, who struct<user: string, ip: string>").json(folder)
    return found.select("record_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "event_id", F.col("who.user").alias("target_user"), F.col("who.ip").alias("ip"))


@query("SELECT record_id, CASE WHEN k % 2 = 0 THEN concat('''=', command_line) ELSE concat(command_line, ', \"', target_user, '\"') END AS cell, concat('{\"u\":\"', target_user, '\"}') AS who FROM evt")
def csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with commas, quotes and formulas as CSV; structs are JSON there."""
    d = F.col("data")
    folder = f"{work_folder(spark, 'csv')}/rows"
    cell = F.when(d["k"].cast("long") % 2 == 0, F.concat(F.lit("="), d["CommandLine"])).otherwise(F.concat(d["CommandLine"], F.lit(', "'), d["TargetUserName"], F.lit('"')))
    W.write_csv(silver(spark, sf_dir).select("record_id", cell.alias("cell"), F.struct(d["TargetUserName"].alias("u")).alias("who")), folder)
    return spark.read.schema("record_id long, cell string, who string").option("header", "true").option("escape", '"').csv(folder)


# ---- streams ----
def _in_two_runs(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What a stream gives of the earlier half of the events, and, after a restart from its checkpoint, of all of them."""
    evt, folder = silver(spark, sf_dir), work_folder(spark, name)
    middle = evt.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("m"))
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= F.lit(middle.first()["m"])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = None
    for half in (early, ~early):
        evt.filter(half).write.mode("append").parquet(f"{folder}/silver")
        out = tail.drained(make(tail.silver_stream(spark, f"{folder}/silver")), f"{folder}/out")
    return out


_SEEN = "SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS wm FROM evt"


@query(f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, CAST(event_id AS INT) AS event_id, count(*) AS n FROM evt, ({_SEEN}) AS w WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= wm GROUP BY ALL")
def stream_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the windows that the watermark has closed, over a restart."""
    return _in_two_runs(spark, sf_dir, "frequency", tail.frequency_windows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""SELECT logon_id, epoch_us(prev_ts) AS logon_us, epoch_us(ts) AS logoff_us
FROM (SELECT logon_id, ts, event_id, lag(event_id) OVER w AS prev_id, lag(ts) OVER w AS prev_ts FROM evt WHERE event_id IN (4624, 4634, 4647) WINDOW w AS (PARTITION BY logon_id ORDER BY ts, record_id)), ({_SEEN} WHERE event_id IN (4624, 4634, 4647))
WHERE event_id <> 4624 AND prev_id = 4624 AND ts < wm AND ts <= prev_ts + INTERVAL 3 DAY""")
def stream_logons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of up to three days that have ended before the watermark, which follows logons and logoffs alone, over a restart."""
    return _in_two_runs(spark, sf_dir, "logons", lambda evt: tail.logon_pairs(evt, keep=timedelta(days=3)))


@query("""WITH RECURSIVE b AS (SELECT user_id % 5 AS host, event_id AS record_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
w AS (SELECT b.host, b.i, b.t, count(*) AS n, max(c.i) AS last_i FROM b JOIN b c ON c.host = b.host AND c.i >= b.i AND c.t <= b.t + 43200000000 GROUP BY ALL),
r AS (SELECT host, i, t, n, last_i FROM w WHERE i = 1 UNION ALL SELECT w.host, w.i, w.t, w.n, w.last_i FROM r JOIN w ON w.host = r.host AND w.i = r.i + CASE WHEN r.n >= 5 THEN r.n ELSE 1 END)
SELECT concat('host', r.host) AS computer, r.t AS start_us, r.n, b.record_id FROM r JOIN b ON b.host = r.host AND b.i = r.last_i
WHERE r.n >= 5 AND r.t + 43200000000 < (SELECT max(t) // 1000 * 1000 - 600000000 FROM b)""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five logoffs or more of a computer within half a day, once the watermark has passed the half day, over a restart."""
    hits = lambda evt: evt.filter("event_id in (4634, 4647)").select("computer", "ts", "record_id", F.lit("").alias("shown"))
    return _in_two_runs(spark, sf_dir, "bursts", lambda evt: tail.burst_alarms(hits(evt), 43_200_000_000, 5)).select("computer", "start_us", "n", "record_id")


@query("SELECT concat(logon_id, '.evtx') AS source, record_id, ts, CAST(event_id AS INT) AS event_id, target_user FROM evt")
def stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary logs as a stream over a folder that gets them in two goes."""
    folder, out = work_folder(spark, "tail"), None
    for half in (_user() % 2 == 0, _user() % 2 == 1):
        W.write_files(made_logs(spark, sf_dir, of=half), f"{folder}/logs", ".evtx").write.format("noop").mode("overwrite").save()
        rows = tail.log_stream(spark, f"{folder}/logs").select("source", "record_id", "ts", "event_id", F.col("data")["TargetUserName"].alias("target_user"))
        out = tail.drained(rows, f"{folder}/out")
    return out.select(_name(), "record_id", "ts", "event_id", "target_user")
