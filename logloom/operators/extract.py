"""Typed extractors: one filter and projection for each kind of event, and their union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import columns as C


def _d(name: str) -> Column:
    return F.col("data")[name]


@dataclass(frozen=True)
class Extractor:
    """A kind of event: ids, what else must hold, and the columns that it is told by. Called with events it gives
    record_id, ts, event_id and those columns, by one filter and projection."""

    ids: tuple[int, ...]
    columns: Callable[[], dict[str, Column]]
    where: Callable[[], Column] | None = None
    needs_data: bool = True

    def condition(self) -> Column:
        c = F.col("event_id").isin(*self.ids)
        c = c & F.col("data").isNotNull() if self.needs_data else c
        return c & self.where() if self.where else c

    def __call__(self, evt: DataFrame) -> DataFrame:
        return evt.filter(self.condition()).select("record_id", "ts", "event_id", *(c.alias(n) for n, c in self.columns().items()))


def typed(*ids: int, where: Callable[[], Column] | None = None, needs_data: bool = True) -> Callable[[Callable[[], dict[str, Column]]], Extractor]:
    return lambda columns: Extractor(ids, columns, where, needs_data)


def ticket_encryption(code: Column) -> Column:
    """The cipher family of a Kerberos ticket; unknown codes stay as they are."""
    c = F.lower(code)
    return F.when(c.isin("0x17", "23"), "RC4").when(c.isin("0x1", "0x3", "1", "3"), "DES").when(c.isin("0x11", "0x12", "17", "18"), "AES").otherwise(code)


@typed(4648, 4769, 4776)
def lateral_movement() -> dict[str, Column]:
    e = F.col("event_id")
    return {
        "source_user": F.when(e == 4648, _d("SubjectUserName")),
        "target_user": _d("TargetUserName"),
        "target_host": F.when(e == 4648, _d("TargetServerName")).when(e == 4769, _d("ServiceName")).otherwise(_d("Workstation")),
        "logon_type": F.when(e == 4648, _d("LogonType").try_cast("int")),
        "auth_package": F.when(e == 4769, F.lit("Kerberos")).when(e == 4776, _d("PackageName")),
        "encryption_type": F.when(e == 4769, ticket_encryption(_d("TicketEncryptionType"))),
        "source_ip": F.when(e == 4769, _d("ClientAddress")),
    }


@typed(4778, 4779)
def rdp_sessions() -> dict[str, Column]:
    return {"user": _d("AccountName"), "session_id": _d("SessionID").try_cast("int"), "source_ip": _d("ClientAddress")}


@typed(5140, 5145)
def smb_access() -> dict[str, Column]:
    return {
        "subject_user": _d("SubjectUserName"),
        "share_name": _d("ShareName"),
        "share_path": _d("ShareLocalPath"),
        "relative_target": _d("RelativeTargetName"),
        "ip_address": _d("IpAddress"),
    }


@typed(1006, 1116, 1117, where=lambda: F.coalesce(F.col("provider"), F.lit("")) != "Microsoft-Windows-Partition")
def defender_events() -> dict[str, Column]:
    return {
        "threat_name": C.first_field(F.col("data"), "Threat Name", "ThreatName"),
        "severity": C.first_field(F.col("data"), "Severity Name", "Severity"),
        "path": _d("Path"),
        "action_taken": C.first_field(F.col("data"), "Action Name", "Action"),
        "process_name": C.first_field(F.col("data"), "Process Name", "ProcessName"),
    }


@typed(5857, 5858, 5860, 5861, 19, 20, 21, needs_data=False)
def wmi_events() -> dict[str, Column]:
    e = F.col("event_id")
    named = lambda own, name, last: F.coalesce(_d("ESS" if own == "filter" else "CONSUMER"), _d("FilterName" if own == "filter" else "ConsumerName"), last, F.when(e.isin(*name), F.coalesce(_d("Name"), _d("Filter" if own == "filter" else "Consumer"))))
    return {
        "wmi_provider": _d("ProviderName"),
        "filter_name": named("filter", (19, 21), _d("PossibleCause")),
        "consumer_name": named("consumer", (20, 21), F.lit(None).cast("string")),
        "query": _d("Query"),
    }


@typed(4698, 4702)
def scheduled_tasks() -> dict[str, Column]:
    return {"task_name": _d("TaskName"), "task_content": _d("TaskContent"), "subject_user": _d("SubjectUserName")}


@typed(4688, 1)
def process_executions() -> dict[str, Column]:
    audit = F.col("event_id") == 4688
    image = F.coalesce(F.when(audit, _d("NewProcessName")).otherwise(_d("Image")), F.lit("-"))
    return {
        "pid": F.when(audit, C.hex_number(_d("NewProcessId"))).otherwise(C.decimal_number(_d("ProcessId"))),
        "parent_pid": F.when(audit, C.hex_number(_d("ProcessId"))).otherwise(C.decimal_number(_d("ParentProcessId"))),
        "image": image,
        "command_line": F.coalesce(_d("CommandLine"), F.lit("")),
        "parent_image": F.when(audit, _d("ParentProcessName")).otherwise(_d("ParentImage")),
        "is_lolbin": C.is_lolbin(image),
    }


@typed(1006, where=lambda: F.col("provider") == "Microsoft-Windows-Partition")
def partition_diagnostics() -> dict[str, Column]:
    """Disks that were attached, with the volume serials that their boot sectors hold."""
    vbr = _d("Vbr0")
    return {
        "disk_number": _d("DiskNumber").try_cast("long"),
        "bus_type": _d("BusType").try_cast("long"),
        "model": _d("Model"),
        "serial": F.nullif(F.trim(_d("SerialNumber")), F.lit("")),
        "disk_id": _d("DiskId"),
        "capacity": _d("Capacity").try_cast("decimal(20,0)"),
        "parent_id": _d("ParentId"),
        "vbr0_hex": vbr,
        "ntfs_serial": C.ntfs_serial(vbr),
        "fat_serial": C.fat_serial(vbr),
    }


EXTRACTORS: dict[str, Extractor] = {
    "LateralMovement": lateral_movement,
    "RdpSession": rdp_sessions,
    "SmbAccess": smb_access,
    "Defender": defender_events,
    "Wmi": wmi_events,
    "ScheduledTask": scheduled_tasks,
    "ProcessExecution": process_executions,
}


def extract_all(evt: DataFrame) -> DataFrame:
    """All typed events under one wide schema, told apart by `kind`: one filter and one projection, as no event id
    is of two kinds."""
    parts = {k: x.columns() for k, x in EXTRACTORS.items()}
    kind = reduce(lambda c, k: c.when(EXTRACTORS[k].condition(), k), EXTRACTORS, F)
    rows = evt.withColumn("kind", kind).filter("kind is not null")
    wide = {n: [(k, c[n]) for k, c in parts.items() if n in c] for c in parts.values() for n in c}
    return rows.select("record_id", "ts", "event_id", *(reduce(lambda w, x: w.when(F.col("kind") == x[0], x[1]), of, F).alias(n) for n, of in wide.items()), "kind")


# ---- hunts ----
def _share_hunt() -> Column:
    name = F.upper(_d("ShareName"))
    return name.contains("ADMIN$") | name.contains("\\C$") | name.contains("IPC$")


HUNTS: dict[str, tuple[tuple[int, ...], Callable[[], Column]]] = {
    "kerberoast": ((4769,), lambda: F.lower(_d("TicketEncryptionType")).isin("0x17", "0x12", "23", "18")),
    "asrep": ((4768,), lambda: _d("PreAuthType") == "0"),
    "dcsync": ((4662,), lambda: F.coalesce(_d("ObjectServer").contains("Directory Service"), F.lit(False)) | F.coalesce(_d("AccessMask").contains("0x100"), F.lit(False))),
    "lateral-smb": ((5140, 5145), _share_hunt),
    "wmi-persistence": ((5860, 5861), lambda: F.lit(True)),
    "scheduled-task": ((4698, 4702), lambda: F.lit(True)),
    "lsass-access": ((10,), lambda: F.lower(_d("TargetImage")).contains("lsass")),
    "defender-tamper": ((5007, 5001), lambda: F.lit(True)),
}


def hunt(evt: DataFrame, name: str) -> DataFrame:
    """The events that a named hunt is after."""
    if name not in HUNTS:
        raise ValueError(f"no hunt named {name!r}; there are {', '.join(HUNTS)}")
    ids, condition = HUNTS[name]
    return evt.filter(F.col("event_id").isin(*ids) & condition())


# ---- Fixed values ----
ATTACK = {
    4624: ("T1078", "Valid Accounts", "Initial Access"),
    4625: ("T1110", "Brute Force", "Credential Access"),
    4648: ("T1021", "Remote Services", "Lateral Movement"),
    4771: ("T1558.003", "Steal or Forge Kerberos Tickets: Kerberoasting", "Credential Access"),
    4776: ("T1003.001", "OS Credential Dumping: LSASS Memory", "Credential Access"),
    4672: ("T1078.001", "Valid Accounts: Default Accounts", "Privilege Escalation"),
    4728: ("T1136", "Create Account", "Persistence"),
    4732: ("T1136", "Create Account", "Persistence"),
    4756: ("T1136", "Create Account", "Persistence"),
    4757: ("T1098", "Account Manipulation", "Persistence"),
    1102: ("T1070.001", "Indicator Removal: Clear Windows Event Logs", "Defense Evasion"),
    517: ("T1070.001", "Indicator Removal: Clear Windows Event Logs", "Defense Evasion"),
    4719: ("T1562.002", "Impair Defenses: Disable Windows Event Logging", "Defense Evasion"),
    4104: ("T1059.001", "Command and Scripting Interpreter: PowerShell", "Execution"),
    4688: ("T1059", "Command and Scripting Interpreter", "Execution"),
    4698: ("T1053.005", "Scheduled Task/Job: Scheduled Task", "Execution"),
    4702: ("T1053.005", "Scheduled Task/Job: Scheduled Task", "Execution"),
    7045: ("T1543.003", "Create or Modify System Process: Windows Service", "Persistence"),
    4697: ("T1543.003", "Create or Modify System Process: Windows Service", "Persistence"),
    5145: ("T1021.002", "Remote Services: SMB/Windows Admin Shares", "Lateral Movement"),
    4663: ("T1083", "File and Directory Discovery", "Discovery"),
    4656: ("T1083", "File and Directory Discovery", "Discovery"),
}
# ---- End of fixed values ----


def attack_tags(evt: DataFrame) -> DataFrame:
    """Events with the technique that their id stands for; others are left out. The table is constant and small."""
    rows = [(k, *v) for k, v in ATTACK.items()]
    tags = evt.sparkSession.createDataFrame(rows, "event_id int, technique string, technique_name string, tactic string")
    return evt.join(F.broadcast(tags), "event_id")
