"""The registered queries over the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.operators import analytics as A
from logloom.operators import detect as D
from logloom.operators import extract as X
from logloom.operators import integrity as I
from logloom.operators.clusters import bursts
from logloom.operators.manifest import named_fields
from logloom.plans.adapter import events, silver
from logloom.plans.registry import query, table


# ---- counts, timelines ----
@query("SELECT CAST(event_id AS INT) AS event_id, count(*) AS n FROM evt GROUP BY event_id")
def freq_lfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frequency(silver(spark, sf_dir)).orderBy("n", "event_id")


@query("SELECT record_id, ts, CAST(event_id AS INT) AS event_id, computer FROM evt WHERE event_id IN (4624, 4688) AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'")
def timeline_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.timeline(silver(spark, sf_dir), [4624, 4688], "2024-01-03", "2024-01-20").select("record_id", "ts", "event_id", "computer")


@query("SELECT record_id, ts, CAST(event_id AS INT) AS event_id FROM evt ORDER BY ts, record_id LIMIT 100")
def timeline_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_events(silver(spark, sf_dir), 100).select("record_id", "ts", "event_id")


@query("SELECT event_id, n, round((n - m) / s, 6) AS z FROM (SELECT CAST(event_id AS INT) AS event_id, count(*) AS n, avg(count(*)) OVER () AS m, stddev_pop(count(*)) OVER () AS s FROM evt GROUP BY event_id) WHERE abs((n - m) / s) >= 0.5")
def freq_anomaly_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.z_scores(A.frequency(silver(spark, sf_dir)), 0.5).withColumn("z", F.round("z", 6))


@query("SELECT l_suppkey, n, round((n - m) / s, 6) AS z FROM (SELECT l_suppkey, count(*) AS n, avg(count(*)) OVER () AS m, stddev_pop(count(*)) OVER () AS s FROM lineitem GROUP BY l_suppkey) WHERE abs((n - m) / s) >= 1.5")
def anomaly_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.z_scores(A.frequency(table(spark, sf_dir, "lineitem"), "l_suppkey"), 1.5).withColumn("z", F.round("z", 6))


@query("SELECT image, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM evt WHERE event_id = 4688 GROUP BY image HAVING count(*) < 1000000")
def rare_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rare_processes(silver(spark, sf_dir), 1_000_000)


@query("SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey HAVING count(*) < 8")
def rare_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rare(table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "ts"), ["o_custkey"], 8)


@query("SELECT CAST(k AS VARCHAR) AS value, count(*) AS n FROM evt GROUP BY k")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.field_values(silver(spark, sf_dir), "k")


@query("SELECT source, CAST(sum(n) AS BIGINT) AS n_events, min(t0) AS first_ts, max(t1) AS last_ts, string_agg(concat(event_id, ':', n), ',' ORDER BY n DESC, event_id) FILTER (r <= 5) AS top_ids FROM (SELECT source, event_id, count(*) AS n, min(ts) AS t0, max(ts) AS t1, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, event_id) AS r FROM evt GROUP BY source, event_id) GROUP BY source")
def info_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.summary(silver(spark, sf_dir))
    return s.withColumn("top_ids", F.array_join(F.transform("top_ids", lambda x: F.concat(x["event_id"], F.lit(":"), x["n"])), ","))


# ---- sessions and graphs ----
_SESSIONS = """SELECT logon_id, logon_type, ts AS logon_ts, n_ts AS logoff_ts, CAST(floor((epoch_us(n_ts) - epoch_us(ts)) / 1000000) AS BIGINT) AS duration_secs
FROM (SELECT *, lead(event_id) OVER w AS n_eid, lead(ts) OVER w AS n_ts FROM evt WHERE event_id IN (4624, 4634, 4647) WINDOW w AS (PARTITION BY {by} ORDER BY ts, record_id)) WHERE event_id = 4624 AND (n_eid IS NULL OR n_eid <> 4624)"""


@query(_SESSIONS.format(by="logon_id"))
def logon_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.logon_sessions(silver(spark, sf_dir)).select("logon_id", "logon_type", "logon_ts", "logoff_ts", "duration_secs")


@query(_SESSIONS.format(by="logon_id"))
def logon_sessions_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with more than ten events are paired in slices of time."""
    return A.logon_sessions(silver(spark, sf_dir), hot_rows=10).select("logon_id", "logon_type", "logon_ts", "logoff_ts", "duration_secs")


@query(_SESSIONS.format(by="logon_id, computer"))
def logon_sessions_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.logon_sessions(silver(spark, sf_dir), by_host=True).select("logon_id", "logon_type", "logon_ts", "logoff_ts", "duration_secs")


@query(f"SELECT logon_type, count(*) AS n, count(logoff_ts) AS closed, CAST(sum(duration_secs) AS BIGINT) AS total_secs, max(duration_secs) AS longest_secs FROM ({_SESSIONS.format(by='logon_id')}) GROUP BY logon_type")
def session_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.logon_sessions(silver(spark, sf_dir))
    return s.groupBy("logon_type").agg(F.count(F.lit(1)).alias("n"), F.count("logoff_ts").alias("closed"), F.sum("duration_secs").alias("total_secs"), F.max("duration_secs").alias("longest_secs"))


_EDGES = """SELECT source, target, logon_type, count(*) AS n FROM (SELECT CASE WHEN logon_type = 10 THEN nullif(ip, '-') ELSE coalesce(nullif(workstation, '-'), nullif(ip, '-')) END AS source, computer AS target, logon_type FROM evt WHERE event_id = 4624) WHERE source IS NOT NULL GROUP BY ALL"""


@query(_EDGES)
def logon_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.logon_edges(silver(spark, sf_dir))


@query(f"SELECT DISTINCT node FROM (SELECT source AS node FROM ({_EDGES}) UNION ALL SELECT target FROM ({_EDGES}))")
def logon_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.graph_nodes(A.logon_edges(silver(spark, sf_dir)))


@query("""SELECT c.record_id, p.record_id AS parent_record, p.image AS parent_image FROM (SELECT * FROM evt WHERE event_id = 4688) c LEFT JOIN (SELECT * FROM evt WHERE event_id = 4688) p
ON p.computer = c.computer AND p.pid = c.ppid AND (p.ts, p.record_id) < (c.ts, c.record_id) QUALIFY row_number() OVER (PARTITION BY c.record_id ORDER BY p.ts DESC, p.record_id DESC) = 1""")
def process_parent_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.process_parents(A.process_nodes(silver(spark, sf_dir)))


@query("SELECT r_name AS source, n_name AS target, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"))
    joined = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("source"), F.col("n_name").alias("target")).agg(F.sum("c").alias("n"))


# ---- differences, search ----
@query("SELECT record_id FROM evt WHERE record_id % 3 <> 0 AND record_id % 5 = 0")
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    evt = silver(spark, sf_dir)
    return A.difference(evt.filter("record_id % 5 <> 0"), evt.filter("record_id % 3 <> 0"))[0].select("record_id")


@query("SELECT record_id FROM evt WHERE record_id % 5 <> 0 AND record_id % 3 = 0")
def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    evt = silver(spark, sf_dir)
    return A.difference(evt.filter("record_id % 5 <> 0"), evt.filter("record_id % 3 <> 0"))[1].select("record_id")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the and')")
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_text(table(spark, sf_dir, "documents"), ["text"], "The And").select("doc_id", "source")


@query("SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, '[0-9]{2,}|[A-Z][a-z]+tion')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_regex(table(spark, sf_dir, "conversations"), ["text"], "[0-9]{2,}|[A-Z][a-z]+tion").select("conv_id", "turn", "role")


@query("SELECT record_id FROM evt WHERE contains(lower(concat_ws('|', image, parent_image, command_line, share, service, task, script)), 'certutil')")
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_events(silver(spark, sf_dir), "CERTUTIL").select("record_id")


@query("SELECT host, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(concat(url, ' ', html), 'https?://([A-Za-z0-9.-]+)', 1)) AS host FROM pages) GROUP BY host")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit("https?://([A-Za-z0-9.-]+)"), F.lit(1))).alias("host"))
    return hosts.groupBy("host", "page_id").agg(F.count(F.lit(1)).alias("c")).groupBy("host").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_pages"))


# ---- indicators, scripts ----
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"


@query(rf"""SELECT value, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:{_OCTET}\.){{3}}{_OCTET}\b')) AS value FROM documents) WHERE value NOT IN ('0.0.0.0', '255.255.255.255', '127.0.0.1') GROUP BY value""")
def ioc_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.indicators(table(spark, sf_dir, "documents"), "text", "doc_id", None, ["ip_address"])
    return found.select("value", "n", F.array_min("record_ids").alias("first_doc"))


@query("""SELECT kind, value, count(*) AS n FROM (SELECT 'md5' AS kind, md5(p_brand) AS value FROM part UNION ALL SELECT 'sha256', sha256(p_type) FROM part UNION ALL SELECT 'file_path', concat('C:\\Data\\', p_partkey % 40, '.bin') FROM part) GROUP BY ALL""")
def ioc_hashes_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.lit("seen"), F.upper(F.md5("p_brand")), F.lit("and"), F.sha2("p_type", 256), F.concat(F.lit("C:\\Data\\"), F.col("p_partkey") % 40, F.lit(".bin")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), text.alias("text"))
    return A.indicators(rows, "text", ts=None, kinds=["md5", "sha256", "file_path"]).select("kind", "value", "n")


@query("SELECT conv_id, count(*) AS parts, string_agg(text, '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id")
def script_block_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.joined_parts(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], "text", "")


@query("SELECT script_id, count(*) AS parts, string_agg(script, '' ORDER BY part, record_id) AS text FROM evt WHERE event_id = 4104 GROUP BY script_id")
def powershell_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.script_blocks(silver(spark, sf_dir)).select("script_id", "parts", "text")


@query("SELECT p_partkey, concat('run ', p_partkey, ' ', p_name) AS decoded FROM part")
def ps_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat(F.lit("run "), F.col("p_partkey"), F.lit(" "), F.col("p_name"))
    text = F.concat(F.lit("powershell.exe -NoProfile -ENC "), F.base64(F.encode(plain, "UTF-16LE")))
    return table(spark, sf_dir, "part").select("p_partkey", C.decoded_command(F.regexp_replace(text, "\r?\n", "")).alias("decoded"))


# ---- windows ----
@query("SELECT o_orderkey, expected FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) + 1 AS expected FROM orders WHERE o_orderkey % 7 <> 0) WHERE expected <> o_orderkey")
def record_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    return I.id_gaps(rows, ["o_orderstatus"], "o_orderkey", "o_orderkey", "o_orderkey").select("o_orderkey", "expected")


@query("SELECT event_id, ts, previous_ts FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS previous_ts FROM events) WHERE ts < previous_ts")
def ts_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = events(spark, sf_dir).withColumn("at", F.struct("value", "event_id"))
    return I.backward_clocks(ordered, ["user_id"], "at", "ts").select("event_id", "ts", "previous_ts")


@query("SELECT event_id, missing, delta_ns FROM (SELECT event_id, event_id - lag(event_id) OVER w - 1 AS missing, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) * 1000 AS delta_ns FROM events WHERE event_id % 6 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE missing > 0 AND (delta_ns <= 0 OR delta_ns / missing < 200000000000)")
def phantom_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_id % 6 <> 0").withColumn("ts_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return I.phantom_gaps(rows, ["user_id"], "event_id", "ts_ns", 200_000_000_000).select("event_id", "missing", "delta_ns")


@query("SELECT record_id, target_user, first_value FROM (SELECT record_id, target_user, first_value(target_user) OVER (PARTITION BY computer ORDER BY record_id) AS first_value FROM evt) WHERE target_user <> first_value")
def guid_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir).withColumn("target_user", F.col("data")["TargetUserName"])
    return I.changed_values(rows, ["computer"], "record_id", "target_user").select("record_id", "target_user", "first_value")


_BURSTS = """WITH RECURSIVE b AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
w AS (SELECT b.user_id, b.i, b.t, count(*) AS n FROM b JOIN b c ON c.user_id = b.user_id AND c.i >= b.i AND c.t <= b.t + 86400000000 GROUP BY ALL),
r AS (SELECT user_id, i, t, n FROM w WHERE i = 1 UNION ALL SELECT w.user_id, w.i, w.t, w.n FROM r JOIN w ON w.user_id = r.user_id AND w.i = r.i + CASE WHEN r.n >= 3 THEN r.n ELSE 1 END)
SELECT user_id, make_timestamp(t) AS start_ts, n FROM r WHERE n >= 3"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("record_id"), F.lit(4634).alias("event_id"), F.lit("Security").alias("channel"), F.lit("").alias("shown"))


@query(_BURSTS)
def burst_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts(_hits(spark, sf_dir), 86_400_000_000, 3, ["user_id"]).select("user_id", "start_ts", "n")


@query(_BURSTS)
def burst_cluster_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than five hits are searched by pointer doubling."""
    return bursts(_hits(spark, sf_dir), 86_400_000_000, 3, ["user_id"], long_run=5).select("user_id", "start_ts", "n")


# ---- typed extraction, hunts, tags ----
@query("SELECT record_id, subject_user, share AS share_name, ip AS ip_address FROM evt WHERE event_id IN (5140, 5145)")
def extract_smb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.smb_access(silver(spark, sf_dir)).select("record_id", "subject_user", "share_name", "ip_address")


@query("SELECT record_id, pid, ppid AS parent_pid, image, command_line, parent_image, regexp_extract(lower(image), '[^\\\\]*$') IN ('rundll32.exe', 'certutil.exe') AS is_lolbin FROM evt WHERE event_id = 4688")
def extract_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.process_executions(silver(spark, sf_dir)).drop("ts", "event_id")


@query("SELECT record_id, target_user, CASE WHEN event_id = 4648 THEN subject_user END AS source_user, CASE WHEN event_id = 4769 THEN 'Kerberos' END AS auth_package, CASE WHEN event_id = 4769 THEN CASE cipher WHEN '0x17' THEN 'RC4' WHEN '0x1' THEN 'DES' ELSE 'AES' END END AS encryption_type FROM evt WHERE event_id IN (4648, 4769, 4776)")
def extract_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lateral_movement(silver(spark, sf_dir)).select("record_id", "target_user", "source_user", "auth_package", "encryption_type")


@query("SELECT record_id, ts, task AS task_name, subject_user FROM evt WHERE event_id = 4698")
def extract_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scheduled_tasks(silver(spark, sf_dir)).select("record_id", "ts", "task_name", "subject_user")


@query("SELECT record_id, CASE WHEN event_id IN (4648, 4769, 4776) THEN 'LateralMovement' WHEN event_id IN (5140, 5145) THEN 'SmbAccess' WHEN event_id = 4698 THEN 'ScheduledTask' ELSE 'ProcessExecution' END AS kind FROM evt WHERE event_id IN (4648, 4769, 4776, 5140, 5145, 4698, 4688)")
def extract_all_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_all(silver(spark, sf_dir)).select("record_id", "kind")


def _hunt(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.hunt(silver(spark, sf_dir), name).select("record_id", "ts", "computer")

    run.__name__ = "hunt_" + name.replace("-", "_")
    query(f"SELECT record_id, ts, computer FROM evt WHERE {sql}")(run)


_hunt("kerberoast", "event_id = 4769 AND cipher IN ('0x17', '0x12')")
_hunt("asrep", "event_id = 4768 AND preauth = '0'")
_hunt("lateral-smb", "event_id IN (5140, 5145) AND regexp_matches(share, 'ADMIN\\$|\\\\C\\$|IPC\\$')")
_hunt("scheduled-task", "event_id IN (4698, 4702)")

_TAGS = ", ".join(f"({k}, '{v[0]}', '{v[2]}')" for k, v in X.ATTACK.items())


@query(f"SELECT record_id, technique, tactic FROM evt JOIN (VALUES {_TAGS}) AS t(id, technique, tactic) ON id = event_id")
def attack_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.attack_tags(silver(spark, sf_dir)).select("record_id", "technique", "tactic")


@query("SELECT event_id AS record_id, concat('n', event_id % 10) AS package, concat('u', user_id) AS target_user, 'kept' AS other FROM events")
def manifest_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(F.lit("Param1"), F.concat(F.lit("n"), F.col("event_id") % 10), F.lit("Param2"), F.concat(F.lit("u"), F.col("user_id")), F.lit("Param9"), F.lit("kept"))
    rows = events(spark, sf_dir).select(F.col("event_id").alias("record_id"), F.lit(4776).alias("event_id"), F.lit("54849625-5478-4994-A5BA-3E3B0328C30D").alias("provider_guid"), pairs.alias("data"))
    d = F.col("data")
    return named_fields(rows).select("record_id", d["PackageName"].alias("package"), d["TargetUserName"].alias("target_user"), d["Param9"].alias("other"))


@query("""SELECT event_id AS record_id, code FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'GUID_SPOOFING' END AS code FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'UNEXPECTED_EVENT_ID' END FROM events
UNION ALL SELECT event_id, CASE WHEN user_id % 2 = 1 AND event_id % 3 = 0 THEN 'CHANNEL_MISMATCH' END FROM events) WHERE code IS NOT NULL""")
def provider_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    rows = events(spark, sf_dir).select(
        n.alias("record_id"),
        F.when(n % 4 == 1, 9999).otherwise(3).alias("event_id"),
        F.lit("Microsoft-Windows-Sysmon").alias("provider"),
        F.when(user % 2 == 0, "00000000-0000-0000-0000-000000000000").otherwise("5770385F-C22A-43E0-BF4C-06F5698FFBD9").alias("provider_guid"),
        F.when(n % 3 == 0, "Security").otherwise("Microsoft-Windows-Sysmon/Operational").alias("channel"),
    )
    return I.provider_inconsistencies(rows).select("record_id", "code")


@query("SELECT DISTINCT event_id % 14 AS code, CASE event_id % 14 WHEN 0 THEN 'System' WHEN 2 THEN 'Interactive' WHEN 3 THEN 'Network' WHEN 4 THEN 'Batch' WHEN 5 THEN 'Service' WHEN 7 THEN 'Unlock' WHEN 8 THEN 'NetworkCleartext' WHEN 9 THEN 'NewCredentials' WHEN 10 THEN 'RemoteInteractive' WHEN 11 THEN 'CachedInteractive' WHEN 12 THEN 'CachedRemoteInteractive' WHEN 13 THEN 'CachedUnlock' ELSE 'Unknown' END AS name FROM events")
def logon_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = events(spark, sf_dir).select((F.col("event_id") % 14).alias("code")).distinct()
    return codes.select("code", C.logon_type_name(F.col("code")).alias("name"))


# ---- detections ----
_BASE = "regexp_extract(lower({}), '[^\\\\]*$')"
_RULES = {
    "smb_admin_share": "event_id = 5140 AND regexp_extract(lower(share), '[^\\\\]*$') IN ('admin$', 'c$', 'ipc$', 'd$') AND ip <> '-'",
    "explorer_lolbin": f"event_id = 4688 AND {_BASE.format('parent_image')} = 'explorer.exe' AND {_BASE.format('image')} IN ('rundll32.exe', 'certutil.exe')",
    "scheduled_task_creation": "event_id = 4698",
    "byovd_driver_install": "event_id = 7045 AND lower(service) IN ('zam', 'rtcore64')",
    "vssadmin_wmic": f"event_id = 4688 AND {_BASE.format('image')} = 'vssadmin.exe' AND contains(command_line, 'delete shadows')",
    "rpivot_chisel": "event_id = 4688 AND contains(command_line, '--reverse')",
    "sevenz_staging": f"event_id = 4688 AND {_BASE.format('image')} = '7z.exe' AND contains(command_line, '-mhe') AND {_BASE.format('parent_image')} = 'wmiprvse.exe'",
    "webdav_lolbin": f"event_id = 4688 AND {_BASE.format('image')} IN ('rundll32.exe', 'certutil.exe') AND contains(command_line, 'DavWWWRoot')",
}


@query(" UNION ALL ".join(f"SELECT record_id, '{k}' AS kind FROM evt WHERE {v}" for k, v in _RULES.items()))
def detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_events(silver(spark, sf_dir)).select("record_id", "kind")


@query(f"SELECT technique, tactic, count(*) AS n FROM (SELECT CASE kind {' '.join(f'''WHEN '{r.name}' THEN '{r.technique}' ''' for r in D.RULES)} END AS technique, CASE kind {' '.join(f'''WHEN '{r.name}' THEN '{r.tactic}' ''' for r in D.RULES)} END AS tactic FROM ({' UNION ALL '.join(f'''SELECT record_id, '{k}' AS kind FROM evt WHERE {v}''' for k, v in _RULES.items())})) GROUP BY ALL")
def detect_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_events(silver(spark, sf_dir)).groupBy("technique", "tactic").agg(F.count(F.lit(1)).alias("n"))
