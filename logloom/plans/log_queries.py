"""Registered queries over binary logs, which our own writer makes of the `events` table, and their SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.container import binxml, evtx
from logloom.operators import analytics as A
from logloom.operators import integrity as I
from logloom.plans.adapter import events, silver
from logloom.plans.registry import query
from logloom.session import work_folder, written
from logloom.sinks.writers import built, log_parts, logs_of, repaired, write_files, write_parts
from logloom.sources import logs as L
from logloom.sources import ranges as R


def _event(event_id: str, computer: str, user: str, ip: str) -> binxml.Element:
    text = lambda name, x: binxml.Element(name, {}, [x])
    field = lambda name, x: binxml.Element("Data", {"Name": name}, [x])
    system = binxml.Element("System", {}, [binxml.Element("Provider", {"Name": "Made-Up"}), text("EventID", event_id), text("Channel", "Security"), text("Computer", computer)])
    return binxml.Element("Event", {}, [system, binxml.Element("EventData", {}, [field("TargetUserName", user), field("IpAddress", ip)])])


def made_logs(spark: SparkSession, sf_dir: str, templates: bool = False, of: Column | None = None, streamed: bool = False) -> DataFrame:
    """source, content: binary logs of the events of every user (or of sources for which `of` is true), made by our own writer.

    A fragment holds offsets of names and templates, so each record is encoded for the place it gets. streamed: from rows that
    Spark sorts, not from a group in pandas for each log, which is much of the work where logs are many and short."""
    import pandas as pd

    mold = binxml.Mold(_event)

    def build(rows: Iterable[tuple]) -> bytes:
        packed, chunk, used, number, known, top = [], [], 0, 1, {}, 0

        def encoded(record_id: int, ticks: int, *values: str) -> bytes:
            at = evtx.RECORDS_AT + used + 24
            return evtx.record_bytes(record_id, ticks, mold.encode_template(values, at, known) if templates else mold.encode(values, at))

        for _, *r in rows:
            raw = encoded(*r)
            if evtx.RECORDS_AT + used + len(raw) > evtx.CHUNK:
                packed.append(evtx.chunk_bytes(chunk, number))
                number, chunk, used, known = number + len(chunk), [], 0, {}
                raw = encoded(*r)
            chunk.append(raw)
            used, top = used + len(raw), r[0]
        packed.append(evtx.chunk_bytes(chunk, number))
        return evtx.file_header(len(packed), top + 1) + b"".join(packed)

    def grouped(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("record_id")
        return pd.DataFrame({"source": [group["source"].iloc[0]], "content": [build(zip(*(group[c].tolist() for c in group), strict=True))]})

    d = F.col("data")
    rows = silver(spark, sf_dir).select(d["TargetLogonId"].alias("source"), "record_id", "ts_ticks", F.col("event_id").cast("string"), "computer", d["TargetUserName"].alias("user"), d["IpAddress"].alias("ip"))
    rows = rows if of is None else rows.filter(of)
    if streamed:
        return built(rows, build)
    # A fixed number: few bytes, but much work, which adaptive execution would put into one task.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source")
    return rows.groupBy("source").applyInPandas(grouped, "source string, content binary")


@query("SELECT logon_id AS source, record_id, ts, CAST(event_id AS INT) AS event_id, computer, target_user FROM evt")
def evtx_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.decoded(L.chunks(made_logs(spark, sf_dir)), "FAILFAST")
    return found.select("source", "record_id", "ts", "event_id", "computer", F.col("data")["TargetUserName"].alias("target_user"))


@query("SELECT logon_id AS source, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM evt GROUP BY logon_id")
def evtx_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = made_logs(spark, sf_dir).withColumn("content", F.concat(F.unhex(F.lit("00" * 40)), F.substring("content", 4097, 1 << 30)))
    recs = L.records(L.chunks(blobs, carve=True))
    return recs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))


@query("SELECT DISTINCT logon_id AS source, 'FILE_HEADER_CHECKSUM_MISMATCH' AS code FROM evt")
def evtx_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag bit is flipped in every file header; nothing else is wrong but the clocks, which are left out."""
    logs = _with_bytes(made_logs(spark, sf_dir), 36, "FF")
    return I.verify(logs, mode="carve").select("source", "code")


@query("SELECT DISTINCT logon_id AS source, TRUE AS header_repaired, CAST(0 AS BIGINT) AS chunks_repaired FROM evt")
def evtx_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _with_bytes(made_logs(spark, sf_dir), 36, "FF")
    return repaired(logs).select("source", "header_repaired", "chunks_repaired")


@query("SELECT logon_id AS source, count(*) AS n FROM evt GROUP BY logon_id")
def evtx_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir).select(F.col("data")["TargetLogonId"].alias("source"), "record_id", F.col("ts_ticks").alias("filetime"), F.unhex(F.lit("0F010200")).alias("payload"))
    return L.records(L.chunks(logs_of(rows))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('src', user_id % 3) AS source, count(*) AS n, min(record_id) AS first_id, CAST(sum(record_id) AS BIGINT) AS ids FROM evt GROUP BY user_id % 3")
def evtx_write_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three long logs, each built by many tasks, chunk by chunk."""
    rows = silver(spark, sf_dir).select("source", "record_id", F.col("ts_ticks").alias("filetime"), F.unhex(F.concat(F.lit("0F010200"), F.repeat(F.lit("AB"), (F.col("record_id") % 90).cast("int")))).alias("payload"))
    parts = log_parts(rows).filter("part > 0").select("source", ((F.col("part") - 1) * evtx.CHUNK + evtx.HEADER_BLOCK).alias("chunk_offset"), "content")
    return L.records(parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.sum("record_id").alias("ids"))


@query("SELECT logon_id AS source, count(*) AS n FROM evt GROUP BY logon_id")
def memory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.memory_records(made_logs(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT record_id, CAST(event_id AS INT) AS event_id, computer, target_user, CAST(logon_type AS VARCHAR) AS logon_type FROM evt")
def evtx_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways of writing attributes, by turns, are read back alike."""
    d = F.col("data")
    evt = silver(spark, sf_dir).withColumn("user", d["TargetUserName"]).withColumn("type", d["LogonType"])
    head = F.concat(F.lit('{"Event":{"System":{"EventID":'), F.when(F.col("record_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('{"#text":'), F.col("event_id"), F.lit("}"))), F.lit(',"Computer":"'), F.col("computer"), F.lit('"},"EventData":{"Data":'))
    at = F.concat(F.lit('[{"@Name":"TargetUserName","#text":"'), F.col("user"), F.lit('"},{"@Name":"LogonType","#text":'), F.col("type"), F.lit("}]}}}"))
    inner = F.concat(F.lit('[{"#attributes":{"Name":"TargetUserName"},"#text":"'), F.col("user"), F.lit('"},{"#attributes":{"Name":"LogonType"},"#text":"'), F.col("type"), F.lit('"}]}}}'))
    rows = evt.select("record_id", F.concat(head, F.when(F.col("record_id") % 2 == 0, at).otherwise(inner)).alias("json"))
    return L.from_json(rows).select("record_id", "event_id", "computer", F.col("data")["TargetUserName"].alias("target_user"), F.col("data")["LogonType"].alias("logon_type"))


@query("SELECT logon_id AS source, record_id, ts, CAST(event_id AS INT) AS event_id, computer, target_user, ip FROM evt")
def evtx_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that fill templates, which stand in the first record of their chunk."""
    found = L.decoded(L.chunks(made_logs(spark, sf_dir, templates=True)), "FAILFAST")
    d = F.col("data")
    return found.select("source", "record_id", "ts", "event_id", "computer", d["TargetUserName"].alias("target_user"), d["IpAddress"].alias("ip"))


@query("SELECT record_id FROM evt WHERE contains(target_user, 'ser3') OR contains(ip, 'SER3') OR contains(computer, 'ser3')")
def leaves_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary logs searched in all their strings, by a query in other letters."""
    evt = L.decoded(L.chunks(made_logs(spark, sf_dir)), leaves=True)
    return A.search_events(evt, "SeR3").select("record_id")


@query("SELECT record_id FROM evt")
def leaves_search_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that every record gives as an attribute, which data has as a key only."""
    return A.search_events(L.decoded(L.chunks(made_logs(spark, sf_dir)), leaves=True), "^IpAddre.s$", regex=True).select("record_id")


@query("SELECT value, count(*) AS n FROM (SELECT target_user AS value FROM evt UNION ALL SELECT ip FROM evt) GROUP BY value")
def field_values_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a name that stands inside list items of the JSON form."""
    json = L.json_records(L.chunks(made_logs(spark, sf_dir)))
    return A.field_values(L.with_leaves(json.select("json")), "#text")


@query("SELECT logon_id AS source, record_id, concat('{\"Event\":{\"System\":{\"Provider\":{\"@Name\":\"Made-Up\"},\"EventID\":\"', event_id, '\",\"Channel\":\"Security\",\"Computer\":\"', computer, '\"},\"EventData\":{\"Data\":[{\"@Name\":\"TargetUserName\",\"#text\":\"', target_user, '\"},{\"@Name\":\"IpAddress\",\"#text\":\"', ip, '\"}]}}}') AS json FROM evt")
def evtx_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.json_records(L.chunks(made_logs(spark, sf_dir))).select("source", "record_id", "json")


@query("SELECT logon_id AS source, count(*) AS records_recovered, CAST(0 AS BIGINT) AS records_corrupt, CAST(0 AS BIGINT) AS chunks_corrupt, TRUE AS all_valid FROM evt GROUP BY logon_id")
def carve_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = L.carve_stats(L.chunks(made_logs(spark, sf_dir)))
    return stats.select("source", "records_recovered", "records_corrupt", "chunks_corrupt", (F.col("chunks_found") == F.col("chunks_valid")).alias("all_valid"))


@query("SELECT logon_id AS source, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM evt GROUP BY logon_id")
def evtx_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as images that begin amid zeros."""
    blobs = made_logs(spark, sf_dir).withColumn("content", F.concat(F.unhex(F.lit("00" * 64)), F.col("content")))
    recs = L.records(L.swept(blobs))
    return recs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))


def _in_files(rows: DataFrame, name: str, ending: str = "") -> str:
    """The folder in which the contents of rows were written, a file each."""
    folder = work_folder(rows.sparkSession, name)
    write_files(rows, folder, ending).write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT concat(logon_id, '.evtx') AS source, record_id, ts, CAST(event_id AS INT) AS event_id, computer, target_user, ip FROM evt")
def evtx_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as files, read by ranges of one chunk a task."""
    found = R.log_ranges(spark, _in_files(made_logs(spark, sf_dir), "logs", ".evtx"), mode="FAILFAST", chunksPerTask="8")
    d = F.col("data")
    return found.select(F.regexp_extract("source", "[^/]*$", 0).alias("source"), "record_id", "ts", "event_id", "computer", d["TargetUserName"].alias("target_user"), d["IpAddress"].alias("ip"))


@query("SELECT concat('image', user_id % 5) AS source, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM evt GROUP BY user_id % 5")
def image_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of many logs in strides a quarter of a chunk long. The unused end of a log's last chunk holds a chunk's
    magic, which a search that comes from the chunk's beginning, three strides before, must not find."""
    size, zeros = F.octet_length("content"), F.unhex(F.lit("00" * 16))
    spare = F.substring("content", size - 15, F.lit(16)) == zeros
    logs = made_logs(spark, sf_dir).withColumn("content", F.when(spare, F.concat(F.substring("content", F.lit(1), size - 16), F.lit(evtx.CHUNK_MAGIC), F.unhex(F.lit("00" * 8)))).otherwise(F.col("content")))
    recs = L.records(R.sweep_chunks(spark, _images(silver(spark, sf_dir), logs, "images"), stride=1 << 14))
    return recs.groupBy(F.regexp_extract("source", "[^/]*$", 0).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))


def _images(evt: DataFrame, logs: DataFrame, name: str) -> str:
    """The folder in which the logs of every fifth user of evt are written as five images, one log behind the other."""
    image = lambda source: F.concat(F.lit("image"), _user(source) % 5).alias("source")
    before = evt.select(F.col("data")["TargetLogonId"].alias("log")).select(image("log")).distinct().select("source", F.lit("").alias("log"), F.unhex(F.lit("00" * 64)).alias("content"))
    folder = work_folder(evt.sparkSession, name)
    write_parts(logs.select(image("source"), F.col("source").alias("log"), "content").unionByName(before), folder, order="log").write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT concat('image', user_id % 5) AS source, count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM evt GROUP BY user_id % 5")
def memory_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of records in strides of 1,000 bytes; each record holds a whole one with another id in its body, often
    in another stride, which a search that comes from the outer one's beginning must not find."""
    inner = F.concat(F.unhex(F.lit("2A2A000020000000" + "FF" * 16 + "0F010100")), F.unhex(F.lit("20000000")))
    filler = F.substring(F.unhex(F.repeat(F.lit("AB"), 700)), 1, (F.col("record_id") % 700).cast("int"))
    rows = silver(spark, sf_dir).select(F.col("data")["TargetLogonId"].alias("source"), "record_id", F.col("ts_ticks").alias("filetime"), F.concat(F.unhex(F.lit("0F010100")), filler, inner).alias("payload"))
    found = R.sweep_records(spark, _images(silver(spark, sf_dir), logs_of(rows), "memory"), stride=1000)
    # Names are cut out of paths once an image, not once a record.
    each = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))
    return each.select(F.regexp_extract("source", "[^/]*$", 0).alias("source"), "n", "ids")


@query("SELECT concat('image', user_id % 5) AS source, 'evtx-chunk' AS format, 'memory' AS method, CAST(0.95 AS DOUBLE) AS confidence, count(DISTINCT user_id) AS logs FROM evt WHERE user_id % 3 <> 0 GROUP BY user_id % 5")
def image_carvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First chunks and file headers by two carvers in one sweep. Where a bit of the chunk's header is flipped (every third user), its checksum keeps it out."""
    third = F.regexp_extract("source", "x([0-9]+)", 1).cast("int") % 3 == 0
    logs = made_logs(spark, sf_dir).withColumn("content", F.substring("content", 1, evtx.HEADER_BLOCK + evtx.CHUNK))
    logs = logs.withColumn("content", F.when(third, F.concat(F.substring("content", 1, 4096 + 0x60), F.unhex(F.lit("5A")), F.substring("content", F.lit(4096 + 0x62), F.lit(1 << 30)))).otherwise(F.col("content")))
    heads = R.Carver("evtx-header", (evtx.FILE_MAGIC,), evtx.HEADER_BLOCK, lambda b: [("header", 0.9)] if evtx.FileHeader.parse(b) else [])
    found = R.carve(spark, _images(silver(spark, sf_dir), logs, "carved"), carvers=(R.EVTX_CHUNK, heads), method="memory", stride=1 << 15)
    return found.filter("format = 'evtx-chunk'").groupBy(F.regexp_extract("source", "[^/]*$", 0).alias("source"), "format", "method", "confidence").agg(F.count(F.lit(1)).alias("logs"))


@query("""SELECT source, CAST(sum(n) AS BIGINT) AS n_events, min(t0) AS first_ts, max(t1) AS last_ts, string_agg(concat(event_id, ':', n), ',' ORDER BY n DESC, event_id) FILTER (r <= 5) AS top_ids, any_value(n_iocs) AS n_iocs, CAST(sum(n) AS BIGINT) AS records_recovered, CAST(1 AS BIGINT) AS n_findings
FROM (SELECT logon_id AS source, event_id, count(*) AS n, min(ts) AS t0, max(ts) AS t1, row_number() OVER (PARTITION BY logon_id ORDER BY count(*) DESC, event_id) AS r FROM evt GROUP BY logon_id, event_id)
JOIN (SELECT logon_id AS source, count(DISTINCT ip) FILTER (ip <> '-') AS n_iocs FROM evt GROUP BY ALL) USING (source) GROUP BY source""")
def info_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is known of each log, after a bit of its header was flipped. Hashes of made logs have no SQL."""
    # Logs and events are looked at more than once, and made once.
    logs = written(_with_bytes(made_logs(spark, sf_dir), 36, "FF"), "logs")
    found = L.chunks(logs)
    findings = I.verify(logs, mode="carve")
    shown = A.info(logs, L.carve_stats(found), written(L.decoded(found), "events"), findings)
    top = F.array_join(F.transform("top_ids", lambda x: F.concat(x["event_id"], F.lit(":"), x["n"])), ",")
    return shown.select("source", "n_events", "first_ts", "last_ts", top.alias("top_ids"), "n_iocs", "records_recovered", "n_findings")


def _with_bytes(logs: DataFrame, at: int | Column, digits: str | Column) -> DataFrame:
    """logs with bytes (hex digits) laid over their content."""
    at, over = (F.lit(at) if isinstance(at, int) else at), F.unhex(F.lit(digits) if isinstance(digits, str) else digits)
    return logs.withColumn("content", F.concat(F.substring("content", 1, at), over, F.substring("content", at + F.length(over) + 1, F.lit(1 << 30))))


#: Damage by the last digit of the user's number: where, which bytes, and what is found.
DAMAGE = (
    (0x78, "01", ("FILE_NOT_CLEANLY_SHUTDOWN",)),
    (0x78, "02", ("FILE_FULL",)),
    (0x2A, "0000", ("EMPTY_LOG", "CHUNK_COUNT_MISMATCH", "FILE_HEADER_CHECKSUM_MISMATCH")),
    (0x2A, "FF00", ("CHUNK_COUNT_MISMATCH", "FILE_HEADER_CHECKSUM_MISMATCH")),
    (0x18, "0000000000000000", ("FILE_HEADER_CHECKSUM_MISMATCH", "NEXT_RECORD_ID_INCONSISTENCY")),
    (0x7C, "00000000", ("FILE_HEADER_CHECKSUM_MISMATCH",)),
    (4096 + 0x34, "00000000", ("CHUNK_CHECKSUM_MISMATCH", "RECORD_CHECKSUM_MISMATCH")),
    (4096 + 0x30, "40000000", ("CHUNK_CHECKSUM_MISMATCH", "INVALID_CHUNK_DATA_LENGTH")),
    (4096 + 512 + 16, "0000000000000000", ("EXPORT_TIMESTAMP_CORRUPTION", "RECORD_CHECKSUM_MISMATCH")),
)
_FOUND = ", ".join(f"({i}, '{code}')" for i, d in enumerate(DAMAGE) for code in d[2])


@query(f"SELECT DISTINCT logon_id AS source, code FROM evt JOIN (VALUES {_FOUND}, (9, 'TRUNCATED_FILE')) AS t(i, code) ON user_id % 10 = i")
def evtx_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log has one kind of damage; clocks and gaps between ids, which are as the events have them, are left out."""
    kind = F.substring("source", -1, 1).cast("int")
    done = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(digits).alias("digits")) for at, digits, _ in DAMAGE], F.struct(F.lit(0).alias("at"), F.lit("").alias("digits")))
    logs = made_logs(spark, sf_dir).withColumn("x", F.element_at(done, kind + 1))
    logs = _with_bytes(logs, F.col("x.at"), F.col("x.digits")).withColumn("content", F.substring("content", F.lit(1), F.when(kind == 9, 100).otherwise(1 << 30)))
    codes = sorted({c for d in DAMAGE for c in d[2]} | {"TRUNCATED_FILE"})
    return I.verify(logs).filter(F.col("code").isin(codes)).select("source", "code").distinct()


def _user(source: str = "source") -> Column:
    return F.regexp_extract(source, "x([0-9]+)", 1).cast("int")


@query("SELECT DISTINCT logon_id AS source, 'TRAILING_DATA' AS code, '48' AS found FROM evt WHERE user_id % 3 = 1")
def evtx_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with 48 bytes behind the last chunk, which in every third are all zero: room that was set aside."""
    more = F.unhex(F.when(_user() % 3 == 1, "00" * 8 + "5A" * 40).when(_user() % 3 == 2, "00" * 48).otherwise(""))
    logs = made_logs(spark, sf_dir).withColumn("content", F.concat("content", more))
    return I.verify(logs).filter("code = 'TRAILING_DATA'").select("source", "code", "found")


@query("SELECT DISTINCT logon_id AS source, 'OVERLAPPING_CHUNKS' AS code, CAST(4096 + 24 AS BIGINT) AS chunk_offset FROM evt WHERE user_id % 4 = 1")
def evtx_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which one, in every fourth log, was found 24 bytes behind the first's beginning."""
    logs = made_logs(spark, sf_dir)
    found = L.chunks(logs)
    other = found.filter((F.col("chunk_offset") == 4096) & (_user() % 4 == 1)).withColumn("chunk_offset", F.col("chunk_offset") + 24)
    return I.verify(logs, found.unionByName(other)).filter("code = 'OVERLAPPING_CHUNKS' and chunk_offset < 65536").select("source", "code", "chunk_offset")


@query("SELECT DISTINCT logon_id AS source, code FROM evt, (VALUES ('RECORD_ID_GAP'), ('LOG_FILE_GUID_MISMATCH'), ('CHUNK_CHECKSUM_MISMATCH'), ('CHUNK_COUNT_MISMATCH')) AS t(code)")
def evtx_transplants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs to whose end a copy of their first chunk was added, with another log's GUID."""
    chunk = lambda at, n: F.substring("content", 4097 + at, n)
    copy = F.concat(chunk(0, 96), F.unhex(F.lit("5A" * 16)), chunk(112, 65536 - 112))
    logs = made_logs(spark, sf_dir).withColumn("content", F.concat("content", copy))
    codes = ("RECORD_ID_GAP", "LOG_FILE_GUID_MISMATCH", "CHUNK_CHECKSUM_MISMATCH", "CHUNK_COUNT_MISMATCH")
    return I.verify(logs).filter(F.col("code").isin(*codes)).select("source", "code").distinct()


@query("SELECT logon_id AS source, 'SURGICAL_RECORD_DELETION' AS code, 'Critical' AS severity, count(*) AS n FROM evt WHERE record_id % 5 = 0 GROUP BY logon_id")
def evtx_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, one in five, that took in the one behind them."""
    inner = F.when(F.col("record_id") % 5 == 0, F.unhex(F.lit("2A2A000020000000" + "01" * 16 + "0F010100" + "20000000"))).otherwise(F.unhex(F.lit("")))
    rows = silver(spark, sf_dir).select(F.col("data")["TargetLogonId"].alias("source"), "record_id", F.col("ts_ticks").alias("filetime"), F.concat(F.unhex(F.lit("0F010100")), inner).alias("payload"))
    found = I.verify(logs_of(rows), least="Critical")
    return found.groupBy("source", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT logon_id AS source, 'carved' AS how, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM evt GROUP BY logon_id")
def evtx_carve_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's header is damaged, so records are searched for at every fourth byte and judged by their payloads."""
    rows = silver(spark, sf_dir).select(F.col("data")["TargetLogonId"].alias("source"), "record_id", F.col("ts_ticks").alias("filetime"), F.unhex(F.lit("0F01010001020304")).alias("payload"))
    found = L.chunks(logs_of(rows))
    found = found.withColumn("content", F.concat(F.substring("content", 1, 0x60), F.unhex(F.lit("5A")), F.substring("content", 0x62, 1 << 16)))
    return L.records(found).groupBy("source", "how").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id"))


@query("SELECT logon_id AS source, max(record_id) AS record_id, 'free' AS how FROM evt GROUP BY logon_id")
def evtx_free_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each log is cut off from its chunk: the header ends the records before it, and is right."""
    found = L.chunks(made_logs(spark, sf_dir))
    last = L.records(found).groupBy("source").agg(F.max(F.struct("chunk_offset", "record_offset")).alias("x")).select("source", "x.*")
    cut = found.join(last, ["source", "chunk_offset"])
    four = lambda n: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))
    cut = cut.withColumn("content", F.concat(F.substring("content", 1, 0x30), four(F.col("record_offset").cast("long")), F.substring("content", 0x35, 1 << 16)))
    cut = cut.withColumn("content", F.concat(F.substring("content", 1, 0x78), four(F.crc32(F.substring("content", 1, 0x78))), F.substring("content", 0x7D, 1 << 16)))
    return L.records(cut, free=True).filter("how like 'free%'").select("source", "record_id", "how")


@query("""SELECT event_id AS record_id, CASE event_id % 6 WHEN 0 THEN 'TOO_SHORT' WHEN 1 THEN 'INVALID_FRAGMENT_HEADER' WHEN 2 THEN 'UNKNOWN_OPCODE' WHEN 3 THEN 'STRING_TABLE_OVERFLOW' WHEN 4 THEN 'TRUNCATED' END AS problem,
CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 4 END AS problem_at FROM events""")
def evtx_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ("0F01", "AA010100", "0F010100FF", "0F010100" + "01FFFF00000000" + "0100FFFFFFFF" + "00", "0F010100" + "01FFFF", "0F010100" + "01FFFF00000000" + "00000000" + "00")
    payload = F.unhex(F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % 6).cast("int") + 1))
    return L.problems(events(spark, sf_dir).select(F.col("event_id").alias("record_id"), payload.alias("payload"))).select("record_id", "problem", "problem_at")


@query("SELECT logon_id AS source, min(user_id) % 7 + 2 AS first_sector, count(*) AS n FROM evt WHERE user_id % 4 <> 3 GROUP BY logon_id")
def disk_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disk images with one log in a partition each: the partition table says where; one in four has another kind."""
    user = F.regexp_extract("source", "x([0-9]+)", 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("07", "17", "27", "83")]), user % 4 + 1)
    entry = F.concat(F.lit("00" * 4), kind, F.lit("00" * 3), F.lpad(F.lower(F.hex(user % 7 + 2)), 2, "0"), F.lit("00" * 7))
    mbr = F.unhex(F.concat(F.lit("00" * 446), F.lit("00" * 16), entry, F.lit("00" * 32), F.lit("55AA")))
    gap = F.unhex(F.repeat(F.lit("00"), (user % 7 + 1) * 512))
    images = made_logs(spark, sf_dir).withColumn("content", F.concat(mbr, gap, F.col("content")))
    # Records carry the sector along, so images are made and read once.
    own = ("first_sector",)
    return L.records(L.chunks(L.ntfs_partitions(images), keep=own), keep=own).groupBy("source", "first_sector").agg(F.count(F.lit(1)).alias("n"))
