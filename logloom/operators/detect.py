"""Detection rules over the silver table, tagged with MITRE ATT&CK techniques.

All rules of single events are tried in one pass: each is a condition and what it says, and the rows that
match none are filtered before anything is built. Bursts need neighbours and come from clusters.py.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.columns import basename
from logloom.operators import signatures as S
from logloom.operators.clusters import bursts
from logloom.schema import DEFENDER, HYPERV, POWERSHELL, SYSMON, WMI_ACTIVITY

EVENT, CHANNEL = "event_id", "channel"


def _f(name: str) -> Column:
    return F.coalesce(F.col("data")[name], F.lit(""))


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts)


def _has(text: Column, words: tuple[str, ...], fold: bool = True) -> Column:
    return _any([(F.lower(text) if fold else text).contains(w.lower() if fold else w) for w in words])


def _is(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).isin(*[w.lower() for w in words])


def _names(words: tuple[str, ...], whole: bool, suffix: str = "") -> str:
    """A pattern for names in a lower-case command line, whole names or also parts of longer ones. A name that
    ends in * is a prefix. A suffix may be missing in the command line; folders of a path are no names."""
    before, after = r"(?<![\w.$\\/-])", r"(?![\w.$\\/-])"
    stems = [w.lower().removesuffix(suffix) for w in words]
    prefixes = "|".join(re.escape(w[:-1]) for w in stems if w.endswith("*"))
    rest = "|".join(re.escape(w) for w in stems if not w.endswith("*"))
    found = [f"{before}(?:{prefixes})"] if prefixes else []
    found += ([f"{before}(?:{rest})(?:{re.escape(suffix)})?{after}"] if whole else [rest]) if rest else []
    return "|".join(found)


def _under(path: Column, prefixes: tuple[str, ...]) -> Column:
    return _any([F.startswith(F.lower(path), F.lit(p)) for p in prefixes])


def _on(event_id: int | tuple[int, ...], channel: str) -> Column:
    ids = event_id if isinstance(event_id, tuple) else (event_id,)
    return F.col(EVENT).isin(*ids) & (F.col(CHANNEL) == channel)


def image() -> Column:
    return F.coalesce(F.col("data")["Image"], F.col("data")["NewProcessName"], F.lit(""))


def parent() -> Column:
    return F.coalesce(F.col("data")["ParentImage"], F.col("data")["ParentProcessName"], F.lit(""))


def command() -> Column:
    return _f("CommandLine")


def process_created() -> Column:
    return _on(4688, "Security") | _on(1, SYSMON)


def script_block() -> Column:
    return _on(4104, POWERSHELL)


@dataclass(frozen=True)
class Rule:
    name: str
    technique: str
    tactic: str
    condition: Callable[[], Column]
    evidence: tuple[str, ...]


def _rdp() -> Column:
    value = F.lower(F.trim(_f("Details")))
    zero = (value == "0") | (value == "0x0") | value.contains("0x00000000") | value.contains("dword (0x0)")
    return _on(13, SYSMON) & F.lower(_f("TargetObject")).contains("fdenytsconnections") & zero


def _share() -> Column:
    name = F.regexp_extract(_f("ShareName"), r"([^\\]*)$", 1)
    return _on(5140, "Security") & _is(name, S.ADMIN_SHARES) & ~_f("IpAddress").isin("127.0.0.1", "::1", "-", "")


_PROCESS = ("Image", "NewProcessName", "CommandLine", "ParentImage", "ParentProcessName")
RULES: tuple[Rule, ...] = (
    Rule("byovd_driver_install", "T1068", "Privilege Escalation", lambda: (_on(7045, "System") | _on(4697, "Security")) & _is(_f("ServiceName"), S.BYOVD_DRIVERS), ("ServiceName",)),
    Rule("hvci_registry_tamper", "T1562.001", "Defense Evasion", lambda: _on(4657, "Security") & _has(_f("ObjectName"), S.HVCI_KEYS, False) & _f("ObjectValueName").isin(*S.HVCI_VALUES), ("ObjectName", "ObjectValueName")),
    Rule("vss_deletion", "T1490", "Impact", lambda: _on((8193, 524), "Application"), ()),
    Rule("hyperv_vm_shutdown", "T1486", "Impact", lambda: _on((13002, 13003), HYPERV), ("VmName",)),
    Rule("scheduled_task_creation", "T1053.005", "Persistence", lambda: _on(4698, "Security") | ((F.col(EVENT) == 106) & F.col(CHANNEL).contains("TaskScheduler")), ("TaskName", "SubjectUserName")),
    Rule("qwcrypt_process", "T1486", "Impact", lambda: process_created() & _is(basename(F.coalesce(F.col("data")["NewProcessName"], F.col("data")["Image"])), S.QWCRYPT_FILES), _PROCESS),
    Rule("ps_qwcrypt_patterns", "T1059.001", "Execution", lambda: script_block() & _has(_f("ScriptBlockText"), S.QWCRYPT_SCRIPTS), ("ScriptBlockText",)),
    Rule("webdav_lolbin", "T1102", "Command and Control", lambda: process_created() & _is(basename(image()), S.WEBDAV_LOLBINS) & _has(command(), S.WEBDAV_INDICATORS, False), _PROCESS),
    Rule("ransom_note_creation", "T1486", "Impact", lambda: _on(11, SYSMON) & _is(basename(_f("TargetFilename")), S.RANSOM_NOTES), ("TargetFilename",)),
    Rule("webclient_service_start", "T1102", "Command and Control", lambda: _on(7036, "System") & _is(_f("param1"), ("webclient",)) & _is(_f("param2"), ("running",)), ("param1", "param2")),
    Rule("adexplorer_recon", "T1087", "Discovery", lambda: _on((12, 13), SYSMON) & _has(_f("TargetObject"), S.ADEXPLORER_KEYS), ("TargetObject",)),
    Rule(
        "zemana_driver_load",
        "T1068",
        "Privilege Escalation",
        lambda: _on(6, SYSMON) & _is(_f("SignatureStatus"), ("valid",)) & F.upper(_f("Hashes")).contains(S.ZEMANA_THUMBPRINT) & ~F.lower(_f("ImageLoaded")).contains("\\program files\\zemana"),
        ("ImageLoaded", "Hashes"),
    ),
    Rule("dll_sideload", "T1574.002", "Defense Evasion", lambda: _on(7, SYSMON) & _is(basename(_f("ImageLoaded")), S.SIDELOAD_DLLS) & ~_under(_f("ImageLoaded"), S.SIDELOAD_SAFE), ("Image", "ImageLoaded")),
    Rule("ps_history_wipe", "T1070.003", "Defense Evasion", lambda: _on((23, 26), SYSMON) & _f("TargetFilename").contains(S.HISTORY_FILE), ("TargetFilename",)),
    Rule("rpivot_chisel", "T1090", "Command and Control", lambda: process_created() & (_has(command(), S.CHISEL_INDICATORS) | _has(command(), S.RPIVOT_INDICATORS)), _PROCESS),
    Rule("wmi_lateral_movement", "T1047", "Lateral Movement", lambda: _on(5861, WMI_ACTIVITY) | (process_created() & _has(command(), S.IMPACKET_REDIRECTS)), ("CommandLine", "Query")),
    Rule("sevenz_staging", "T1560.001", "Collection", lambda: process_created() & _is(basename(image()), S.ARCHIVERS) & command().contains("-mhe") & _is(basename(parent()), S.STAGING_PARENTS), _PROCESS),
    Rule("fake_browser_task", "T1053.005", "Persistence", lambda: F.col(EVENT).isin(106, 140) & F.col(CHANNEL).contains("TaskScheduler") & _has(_f("TaskName"), S.BROWSER_TASKS, False), ("TaskName",)),
    Rule("workers_dev_dns", "T1102", "Command and Control", lambda: _on(22, SYSMON) & F.endswith(F.lower(_f("QueryName")), F.lit(S.WORKER_SUFFIX)) & ~_is(basename(_f("Image")), S.BROWSERS), ("QueryName", "Image")),
    Rule(
        "vssadmin_wmic",
        "T1490",
        "Impact",
        lambda: process_created() & (((basename(image()) == "vssadmin.exe") & _has(command(), (S.VSSADMIN_PATTERN,))) | ((basename(image()) == "wmic.exe") & _has(command(), (S.WMIC_PATTERN,)))),
        _PROCESS,
    ),
    Rule("bcdedit_recovery", "T1490", "Impact", lambda: process_created() & (basename(image()) == "bcdedit.exe") & _has(command(), S.BCDEDIT_PATTERNS), _PROCESS),
    Rule(
        "wevtutil_cl",
        "T1070.001",
        "Defense Evasion",
        lambda: (process_created() & (basename(image()) == "wevtutil.exe") & _has(command(), S.WEVTUTIL_PATTERNS)) | (script_block() & _has(_f("ScriptBlockText"), S.CLEAR_SCRIPTS, False)),
        (*_PROCESS, "ScriptBlockText"),
    ),
    Rule("defender_disable", "T1562.001", "Defense Evasion", lambda: _on(5001, DEFENDER) | (script_block() & _has(_f("ScriptBlockText"), S.DEFENDER_SCRIPTS, False)), ("ScriptBlockText",)),
    Rule(
        "comsvcs_lsass",
        "T1003.001",
        "Credential Access",
        lambda: (process_created() & F.lower(command()).contains("comsvcs") & F.lower(command()).contains("minidump")) | (_on(10, SYSMON) & (basename(_f("TargetImage")) == "lsass.exe")),
        (*_PROCESS, "SourceImage", "TargetImage", "GrantedAccess"),
    ),
    Rule("rmm_install", "T1219", "Command and Control", lambda: _on(11, SYSMON) & _is(basename(_f("TargetFilename")), S.RMM_BINARIES) & ~_under(_f("TargetFilename"), S.RMM_SAFE), ("TargetFilename",)),
    Rule("rdp_enable", "T1021.001", "Lateral Movement", _rdp, ("TargetObject", "Details")),
    Rule("local_admin_creation", "T1136.001", "Persistence", lambda: _on(4720, "Security") | (_on(4732, "Security") & (_f("GroupSid") == S.ADMINISTRATORS)), ("TargetUserName", "TargetDomainName", "GroupName")),
    Rule("smb_admin_share", "T1021.002", "Lateral Movement", _share, ("SubjectUserName", "ShareName", "IpAddress")),
    Rule("explorer_lolbin", "T1204.002", "Execution", lambda: process_created() & _is(basename(parent()), S.SHELLS) & _is(basename(image()), S.WEBDAV_LOLBINS), _PROCESS),
)
BURST_RULES = ("taskkill_av_cluster", "service_stop_avset")


def detect_events(evt: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the rules of single events say: one scan, no shuffle. A field that is missing counts as empty.

    Conditions give the numbers of the rules that hit; what a hit says comes from a constant table afterwards.
    The conditions stand inside a higher-order function, which keeps them out of whole-stage code: there all of
    them would have to be one method, of more than the 64 KB that the JVM takes; here each has its own.
    """
    hits = F.array(*[F.when(F.coalesce(r.condition(), F.lit(False)), F.lit(i)) for i, r in enumerate(rules)])
    numbers = F.filter(hits, lambda i: i.isNotNull())
    table = F.array(*[F.struct(F.lit(r.name).alias("kind"), F.lit(r.technique).alias("technique"), F.lit(r.tactic).alias("tactic"), F.array(*[F.lit(n) for n in r.evidence]).cast("array<string>").alias("names")) for r in rules])
    some = evt.select(F.explode(numbers).alias("i"), "data", "ts", "event_id", "channel", "record_id")
    out = some.withColumn("x", F.element_at(table, F.col("i") + 1))
    shown = F.transform(F.col("x.names"), lambda n: F.concat(n, F.lit("="), F.substring(F.element_at(F.col("data"), n), 1, 120)))
    evidence = F.filter(shown, lambda e: e.isNotNull())
    return out.select("x.kind", "x.technique", "x.tactic", F.replace(F.col("x.kind"), F.lit("_"), F.lit(" ")).alias("description"), evidence.alias("evidence"), "ts", "event_id", "channel", "record_id")


def kill_hits(evt: DataFrame) -> DataFrame:
    named = _has(command(), S.KILLED_PARTS) | F.lower(command()).rlike(_names(S.KILLED_PROCESSES, True, ".exe"))
    return evt.filter(process_created() & (basename(image()) == "taskkill.exe") & F.lower(command()).contains("/im") & named)


def stop_hits(evt: DataFrame) -> DataFrame:
    # Names of up to four letters stand in too many others.
    short, long = tuple(w for w in S.STOPPED_SERVICES if len(w) <= 4), tuple(w for w in S.STOPPED_SERVICES if len(w) > 4)
    named = _has(command(), S.STOPPED_PARTS) | F.lower(command()).rlike(f"{_names(short, True)}|{_names(long, False)}")
    return evt.filter(process_created() & basename(image()).isin("net.exe", "net1.exe", "sc.exe") & F.lower(command()).contains("stop") & named)


def detect_bursts(evt: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bursts of killed security or database processes (5 in 60 s) and of stopped services (3 in 60 s)."""
    found = []
    for name, technique, tactic, hits, least in (
        ("taskkill_av_cluster", "T1562.001", "Defense Evasion", kill_hits(evt), 5),
        ("service_stop_avset", "T1489", "Impact", stop_hits(evt), 3),
    ):
        groups = bursts(hits.withColumn("shown", F.substring(command(), 1, 120)), 60_000_000, least, by or [])
        found.append(
            groups.select(
                F.lit(name).alias("kind"), F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic"), F.lit(name.replace("_", " ")).alias("description"), F.col("shown").alias("evidence"), F.col("start_ts").alias("ts"), "event_id", "channel", "record_id"
            )
        )
    return found[0].unionByName(found[1])


def detect_all(evt: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All detections, by these rules (RULES and some of your own, say) and of bursts; sort by ts and technique to
    read them."""
    return detect_events(evt, rules).unionByName(detect_bursts(evt))
