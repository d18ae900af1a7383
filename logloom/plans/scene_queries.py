"""Registered queries over scenes: every rule, burst, hunt and extractor, each with rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.operators import analytics as A
from logloom.operators import detect as D
from logloom.operators import extract as X
from logloom.operators import integrity as I
from logloom.plans.adapter import events, silver
from logloom.plans.registry import query, table
from logloom.plans.scenes import SC, scenes
from logloom.schema import DEFENDER, HYPERV, POWERSHELL, SYSMON, WMI_ACTIVITY
from logloom.sinks.writers import flattened_for_csv, mermaid_edges, mermaid_processes

_SYSMON = f"channel = '{SYSMON}'"
_STARTED = f"((event_id = 4688 AND channel = 'Security') OR (event_id = 1 AND {_SYSMON}))"
_SCRIPT = f"event_id = 4104 AND channel = '{POWERSHELL}'"


def _base(*fields: str) -> str:
    return f"regexp_extract(lower(coalesce({', '.join(f'''d['{x}']''' for x in fields)}, '')), '[^\\\\/]*$')"


_IMAGE, _PARENT = _base("Image", "NewProcessName"), _base("ParentImage", "ParentProcessName")
_COMMAND = "coalesce(d['CommandLine'], '')"

#: What each rule looks for, as far as scenes show it.
_RULES = {
    "byovd_driver_install": "((event_id = 7045 AND channel = 'System') OR (event_id = 4697 AND channel = 'Security')) AND lower(d['ServiceName']) IN ('zamguard64', 'zam', 'zemanaantimalware', 'rtcore64')",
    "hvci_registry_tamper": "event_id = 4657 AND channel = 'Security' AND contains(d['ObjectName'], '\\Control\\CI\\Config') AND d['ObjectValueName'] = 'VulnerableDriverBlocklistEnable'",
    "vss_deletion": "event_id IN (8193, 524) AND channel = 'Application'",
    "hyperv_vm_shutdown": f"event_id IN (13002, 13003) AND channel = '{HYPERV}'",
    "scheduled_task_creation": "event_id = 106 AND contains(channel, 'TaskScheduler')",
    "qwcrypt_process": f"{_STARTED} AND {_base('NewProcessName', 'Image')} IN ('rbcw.exe', 'adnotificationmanager.exe')",
    "ps_qwcrypt_patterns": f"{_SCRIPT} AND regexp_matches(lower(d['ScriptBlockText']), 'get-vm|stop-vm|vssadmin delete shadows|wbadmin delete')",
    "webdav_lolbin": f"{_STARTED} AND {_IMAGE} IN ('rundll32.exe', 'msiexec.exe', 'certutil.exe') AND regexp_matches({_COMMAND}, 'DavWWWRoot|@SSL|@80|@443')",
    "ransom_note_creation": f"event_id = 11 AND {_SYSMON} AND {_base('TargetFilename')} IN ('_readme.txt', 'akira_readme.txt', 'lockbit_readme.txt')",
    "webclient_service_start": "event_id = 7036 AND channel = 'System' AND lower(d['param1']) = 'webclient' AND lower(d['param2']) = 'running'",
    "adexplorer_recon": f"event_id IN (12, 13) AND {_SYSMON} AND contains(lower(d['TargetObject']), '\\software\\sysinternals\\active directory explorer')",
    "zemana_driver_load": f"event_id = 6 AND {_SYSMON} AND lower(d['SignatureStatus']) = 'valid' AND contains(upper(d['Hashes']), '96A7749D856CB49DE32005BCDD8621F38E2B4C05') AND NOT contains(lower(d['ImageLoaded']), '\\program files\\zemana')",
    "dll_sideload": f"event_id = 7 AND {_SYSMON} AND {_base('ImageLoaded')} IN ('srvcli.dll', 'netutils.dll') AND NOT starts_with(lower(d['ImageLoaded']), 'c:\\windows\\sys')",
    "ps_history_wipe": f"event_id IN (23, 26) AND {_SYSMON} AND contains(d['TargetFilename'], 'ConsoleHost_history.txt')",
    "rpivot_chisel": f"{_STARTED} AND regexp_matches(lower({_COMMAND}), '--reverse|r:socks|socks5|--tls-skip-verify|cl\\.py|client\\.py|--headless')",
    "wmi_lateral_movement": f"(event_id = 5861 AND channel = '{WMI_ACTIVITY}') OR ({_STARTED} AND contains(lower({_COMMAND}), '\\\\127.0.0.1\\admin$\\__'))",
    "sevenz_staging": f"{_STARTED} AND {_IMAGE} IN ('7z.exe', '7za.exe') AND contains({_COMMAND}, '-mhe') AND {_PARENT} IN ('pcalua.exe', 'wmiprvse.exe')",
    "fake_browser_task": "event_id IN (106, 140) AND contains(channel, 'TaskScheduler') AND regexp_matches(d['TaskName'], 'GoogleUpdateTask|MicrosoftEdgeUpdate')",
    "workers_dev_dns": f"event_id = 22 AND {_SYSMON} AND ends_with(lower(d['QueryName']), '.workers.dev') AND {_base('Image')} NOT IN ('chrome.exe', 'msedge.exe', 'firefox.exe', 'brave.exe')",
    "vssadmin_wmic": f"{_STARTED} AND (({_IMAGE} = 'vssadmin.exe' AND contains(lower({_COMMAND}), 'delete shadows')) OR ({_IMAGE} = 'wmic.exe' AND contains(lower({_COMMAND}), 'shadowcopy delete')))",
    "bcdedit_recovery": f"{_STARTED} AND {_IMAGE} = 'bcdedit.exe' AND regexp_matches(lower({_COMMAND}), 'recoveryenabled no|bootstatuspolicy ignoreallfailures|safeboot network')",
    "wevtutil_cl": f"({_STARTED} AND {_IMAGE} = 'wevtutil.exe' AND regexp_matches(lower({_COMMAND}), ' cl |clear-log')) OR ({_SCRIPT} AND regexp_matches(d['ScriptBlockText'], 'Clear-EventLog|Remove-EventLog|wevtutil cl'))",
    "defender_disable": f"(event_id = 5001 AND channel = '{DEFENDER}') OR ({_SCRIPT} AND regexp_matches(d['ScriptBlockText'], 'Set-MpPreference -DisableRealtimeMonitoring|Add-MpPreference -ExclusionPath'))",
    "comsvcs_lsass": f"({_STARTED} AND contains(lower({_COMMAND}), 'comsvcs') AND contains(lower({_COMMAND}), 'minidump')) OR (event_id = 10 AND {_SYSMON} AND {_base('TargetImage')} = 'lsass.exe')",
    "rmm_install": f"event_id = 11 AND {_SYSMON} AND {_base('TargetFilename')} IN ('anydesk.exe', 'teamviewer.exe') AND NOT starts_with(lower(d['TargetFilename']), 'c:\\program files')",
    "rdp_enable": f"event_id = 13 AND {_SYSMON} AND contains(lower(d['TargetObject']), 'fdenytsconnections') AND regexp_matches(lower(trim(d['Details'])), '^0$|^0x0$|0x00000000|dword \\(0x0\\)')",
    "local_admin_creation": "channel = 'Security' AND (event_id = 4720 OR (event_id = 4732 AND d['GroupSid'] = 'S-1-5-32-544'))",
    "smb_admin_share": "event_id = 5140 AND channel = 'Security' AND regexp_matches(lower(d['ShareName']), '\\\\(admin|c|d|ipc)\\$$') AND d['IpAddress'] NOT IN ('127.0.0.1', '::1', '-', '')",
    "explorer_lolbin": f"{_STARTED} AND {_PARENT} = 'explorer.exe' AND {_IMAGE} IN ('rundll32.exe', 'certutil.exe')",
}


def _hit(rule: D.Rule) -> str:
    shown = ", ".join(f"'{n}=' || left(d['{n}'], 120)" for n in rule.evidence)
    evidence = f"concat_ws('|', {shown})" if shown else "''"
    return f"SELECT record_id, ts, '{rule.name}' AS kind, '{rule.technique}' AS technique, '{rule.tactic}' AS tactic, {evidence} AS evidence FROM sc WHERE {_RULES[rule.name]}"


_EVENTS = "\nUNION ALL ".join(_hit(r) for r in D.RULES)


def _burst(name: str, technique: str, tactic: str, condition: str, least: int) -> tuple[str, str]:
    """Common tables and a query for greedy bursts of the scenes for which a condition holds."""
    b = name[:4]
    tables = f"""{b} AS (SELECT record_id, left({_COMMAND}, 120) AS shown, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, record_id) AS i FROM sc WHERE {_STARTED} AND {condition}),
{b}w AS (SELECT x.i, x.t, count(*) AS n FROM {b} x JOIN {b} y ON y.i >= x.i AND y.t <= x.t + 60000000 GROUP BY ALL),
{b}r AS (SELECT i, t, n FROM {b}w WHERE i = 1 UNION ALL SELECT w.i, w.t, w.n FROM {b}r r JOIN {b}w w ON w.i = r.i + CASE WHEN r.n >= {least} THEN r.n ELSE 1 END)"""
    found = f"""SELECT (SELECT record_id FROM {b} x WHERE x.i = r.i + r.n - 1) AS record_id, make_timestamp(t) AS ts, '{name}' AS kind, '{technique}' AS technique, '{tactic}' AS tactic,
  (SELECT string_agg(shown, '|' ORDER BY x.i) FROM {b} x WHERE x.i BETWEEN r.i AND r.i + r.n - 1) AS evidence FROM {b}r r WHERE n >= {least}"""
    return tables, found


_KILLS = _burst("taskkill_av_cluster", "T1562.001", "Defense Evasion", f"{_IMAGE} = 'taskkill.exe' AND regexp_matches(lower({_COMMAND}), '/im (sqlservr|winword|veeam)\\.exe')", 5)
_STOPS = _burst("service_stop_avset", "T1489", "Impact", f"{_IMAGE} IN ('net.exe', 'net1.exe', 'sc.exe') AND regexp_matches(lower({_COMMAND}), 'stop (gxvss|sqlbrowser)')", 3)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("record_id", "ts", "kind", "technique", "tactic", F.array_join("evidence", "|").alias("evidence"))


@query(_EVENTS)
def detect_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.detect_events(scenes(spark, sf_dir)))


@query(f"WITH RECURSIVE {SC},\n{_KILLS[0]},\n{_STOPS[0]}\n{_KILLS[1]}\nUNION ALL {_STOPS[1]}")
def detect_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.detect_bursts(scenes(spark, sf_dir)))


@query(f"WITH RECURSIVE {SC},\n{_KILLS[0]},\n{_STOPS[0]}\n{_EVENTS}\nUNION ALL {_KILLS[1]}\nUNION ALL {_STOPS[1]}")
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.detect_all(scenes(spark, sf_dir)))


# ---- hunts ----
def _hunt(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.hunt(scenes(spark, sf_dir), name).select("record_id", "ts", "computer")

    run.__name__ = "hunt_" + name.replace("-", "_")
    query(f"SELECT record_id, ts, computer FROM sc WHERE {sql}")(run)


_hunt("dcsync", "event_id = 4662 AND (contains(d['ObjectServer'], 'Directory Service') OR contains(d['AccessMask'], '0x100'))")
_hunt("wmi-persistence", "event_id IN (5860, 5861)")
_hunt("lsass-access", "event_id = 10 AND contains(lower(d['TargetImage']), 'lsass')")
_hunt("defender-tamper", "event_id IN (5007, 5001)")


# ---- extractors ----
@query("SELECT record_id, d['AccountName'] AS user, TRY_CAST(d['SessionID'] AS INT) AS session_id, d['ClientAddress'] AS source_ip FROM sc WHERE event_id IN (4778, 4779)")
def extract_rdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rdp_sessions(scenes(spark, sf_dir)).drop("ts", "event_id")


@query("SELECT record_id, coalesce(d['Threat Name'], d['ThreatName']) AS threat_name, coalesce(d['Severity Name'], d['Severity']) AS severity, d['Path'] AS path, coalesce(d['Action Name'], d['Action']) AS action_taken, coalesce(d['Process Name'], d['ProcessName']) AS process_name FROM sc WHERE event_id IN (1116, 1117)")
def extract_defender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.defender_events(scenes(spark, sf_dir)).drop("ts", "event_id")


@query("""SELECT record_id, d['ProviderName'] AS wmi_provider, CASE event_id WHEN 5861 THEN d['ESS'] WHEN 5860 THEN d['PossibleCause'] WHEN 21 THEN d['Filter'] END AS filter_name,
CASE event_id WHEN 5861 THEN d['CONSUMER'] WHEN 20 THEN d['Name'] WHEN 21 THEN d['Consumer'] END AS consumer_name, d['Query'] AS query FROM sc WHERE event_id IN (5860, 5861, 20, 21)""")
def extract_wmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wmi_events(scenes(spark, sf_dir)).drop("ts", "event_id")


@query("""SELECT record_id, TRY_CAST(d['DiskNumber'] AS BIGINT) AS disk_number, TRY_CAST(d['BusType'] AS BIGINT) AS bus_type, d['Model'] AS model, nullif(trim(d['SerialNumber']), '') AS serial, CAST(d['Capacity'] AS BIGINT) AS capacity,
CASE d['DiskNumber'] WHEN '1' THEN '36B08F15B08EDAAE' END AS ntfs_serial, CASE d['DiskNumber'] WHEN '2' THEN '12345678' WHEN 'x' THEN '89ABCDEF' END AS fat_serial FROM sc WHERE event_id = 1006""")
def extract_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.partition_diagnostics(scenes(spark, sf_dir)).select("record_id", "disk_number", "bus_type", "model", "serial", F.col("capacity").cast("long").alias("capacity"), "ntfs_serial", "fat_serial")


@query("""SELECT CASE WHEN event_id IN (4778, 4779) THEN 'RdpSession' WHEN event_id IN (5140, 5145) THEN 'SmbAccess' WHEN event_id IN (1116, 1117) THEN 'Defender' WHEN event_id IN (5860, 5861, 20, 21) THEN 'Wmi' ELSE 'ProcessExecution' END AS kind, count(*) AS n
FROM sc WHERE event_id IN (4778, 4779, 5140, 1116, 1117, 5860, 5861, 20, 21, 4688, 1) GROUP BY ALL""")
def extract_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_all(scenes(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- search in what the System part says ----
@query("SELECT record_id FROM sc WHERE contains(computer, 'host3') OR event_id = 1006 AND contains(lower(provider), 'host3')")
def search_computers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_events(scenes(spark, sf_dir), "HOST3").select("record_id")


@query("SELECT record_id FROM sc WHERE regexp_matches(channel, 'Sysmon|Defender') OR regexp_matches(coalesce(d['CommandLine'], ''), 'Defender')")
def search_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_events(scenes(spark, sf_dir), "Sysmon|Windows Defender", regex=True).select("record_id")


@query("SELECT channel AS value, count(*) AS n FROM sc GROUP BY channel")
def field_values_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.field_values(scenes(spark, sf_dir), "System.channel")


@query("SELECT kind, value, count(*) AS n FROM (SELECT 'ip_address' AS kind, unnest(regexp_extract_all(d['IpAddress'], '[0-9.]+')) AS value FROM sc UNION ALL SELECT 'sha1', lower(right(d['Hashes'], 40)) FROM sc WHERE d['Hashes'] IS NOT NULL) WHERE value LIKE '10.%' OR length(value) = 40 GROUP BY ALL")
def ioc_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenes(spark, sf_dir).select("record_id", "ts", F.concat_ws(" ", F.col("data")["IpAddress"], F.col("data")["Hashes"]).alias("text"))
    return A.indicators(rows, "text", kinds=["ip_address", "sha1"]).select("kind", "value", "n")


@query("SELECT record_id, event_id, channel, 'LOG_CLEARED' AS code FROM (SELECT event_id AS record_id, CASE user_id % 3 WHEN 0 THEN 1102 WHEN 1 THEN 104 ELSE 1 END AS event_id, CASE event_id % 2 WHEN 0 THEN 'Security' ELSE 'System' END AS channel FROM events) WHERE (event_id = 1102 AND channel = 'Security') OR (event_id = 104 AND channel = 'System')")
def cleared_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id") % 3
    rows = events(spark, sf_dir).select(F.col("event_id").alias("record_id"), F.when(user == 0, 1102).when(user == 1, 104).otherwise(1).alias("event_id"), F.when(F.col("event_id") % 2 == 0, "Security").otherwise("System").alias("channel"))
    return I.cleared_logs(rows).select("record_id", "event_id", "channel", F.lit("LOG_CLEARED").alias("code"))


# ---- names, tracing sessions, sinks ----
@query("""SELECT DISTINCT code, CASE code WHEN '0xC000006A' THEN 'Wrong password' WHEN '0xC0000064' THEN 'User name does not exist' WHEN 'c0000072' THEN 'Account disabled' END AS reason
FROM (SELECT (['0xC000006A', '0xC0000064', 'c0000072', '0xC0FFEE00'])[CAST(event_id % 4 AS INT) + 1] AS code FROM events)""")
def logon_failure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.element_at(F.array(*[F.lit(c) for c in ("0xC000006A", "0xC0000064", "c0000072", "0xC0FFEE00")]), (F.col("event_id") % 4).cast("int") + 1)
    return events(spark, sf_dir).select(codes.alias("code")).distinct().select("code", C.failure_reason(F.col("code")).alias("reason"))


@query("""WITH s AS (SELECT DISTINCT name, event_type <> 'error' AS running, value * 100 AS events_lost, event_id % 5 AS log_mode, event_id % 7 AS buffers FROM (SELECT *, ([ 'EventLog-Application', 'EventLog-System', 'Other'])[CAST(user_id % 3 AS INT) + 1] AS name FROM events))
SELECT name, code, count(*) AS n FROM (SELECT name, 'EVENTS_LOST' AS code FROM s WHERE events_lost > 1000 UNION ALL SELECT name, 'LOG_MODE_ZERO' FROM s WHERE log_mode = 0 UNION ALL SELECT name, 'SESSION_STOPPED' FROM s WHERE name <> 'Other' AND NOT running
UNION ALL SELECT name, 'NO_BUFFERS' FROM s WHERE running AND buffers = 0 UNION ALL SELECT 'EventLog-Security', 'SESSION_MISSING') GROUP BY ALL""")
def etw_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("EventLog-Application"), F.lit("EventLog-System"), F.lit("Other")), (F.col("user_id") % 3).cast("int") + 1)
    sessions = events(spark, sf_dir).select(name.alias("name"), (F.col("event_type") != "error").alias("running"), (F.col("value") * 100).alias("events_lost"), (F.col("event_id") % 5).alias("log_mode"), (F.col("event_id") % 7).alias("buffers")).distinct()
    return I.tracing_tampering(sessions).groupBy("name", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '''=' WHEN c_custkey % 4 = 1 THEN '''@' ELSE '' END || c_name AS name, '{\"n\":' || c_nationkey || '}' AS inner_json FROM customer")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(key == 0, "=").when(key == 1, "@").otherwise(""), "c_name").alias("name"), F.struct(F.col("c_nationkey").alias("n")).alias("inner_json"))
    return flattened_for_csv(rows)


@query("SELECT DISTINCT computer || ' -->|\"type ' || length(channel) || '\"| ' || source AS line FROM sc")
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = scenes(spark, sf_dir).select(F.col("computer").alias("source"), F.col("source").alias("target"), F.concat(F.lit("type "), F.length("channel")).alias("label")).distinct()
    return mermaid_edges(edges)


@query("""SELECT concat('PID_', ppid, ' --> PID_', pid, '["', replace(replace(image, ':', '_'), chr(92), '_'), '"]') AS line FROM evt WHERE event_id = 4688""")
def mermaid_process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mermaid_processes(A.process_nodes(silver(spark, sf_dir)))
