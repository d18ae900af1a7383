"""Events for every rule, hunt and extractor, dealt over the driver's `events` table, in Spark and in DuckDB's SQL.

Each scene is something that a rule is after or that only looks like it. An event plays the scene of its number,
with its own time (a thousand times faster, so that there are bursts), user and host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.adapter import events
from logloom.schema import DEFENDER, HYPERV, POWERSHELL, SYSMON, TASK_SCHEDULER, WMI_ACTIVITY, conform

PARTITION = "Microsoft-Windows-Partition"
_NTFS = "EB5290" + "4E54465320202020" + "00" * 61 + "AEDA8EB0158FB036"
_FAT32 = "00" * 0x43 + "78563412" + "00" * 11 + "4641543332" + "20"
_FAT16 = "00" * 0x27 + "EFCDAB89" + "00" * 11 + "464154313620"


def _process(image: str, command: str = "", parent: str = "", audit: bool = False) -> tuple:
    if audit:
        return 4688, "Security", None, {"NewProcessName": image, "CommandLine": command, "ParentProcessName": parent}
    return 1, SYSMON, None, {"Image": image, "CommandLine": command, "ParentImage": parent, "ProcessId": "77", "ParentProcessId": "5"}


#: event_id, channel, provider, data
SCENES: tuple[tuple[int, str, str | None, dict[str, str]], ...] = (
    (7045, "System", None, {"ServiceName": "ZAMGUARD64"}),
    (7045, "Security", None, {"ServiceName": "zam"}),
    (4697, "Security", None, {"ServiceName": "rtcore64"}),
    (4657, "Security", None, {"ObjectName": "\\REGISTRY\\MACHINE\\SYSTEM\\Control\\CI\\Config", "ObjectValueName": "VulnerableDriverBlocklistEnable"}),
    (4657, "Security", None, {"ObjectName": "\\Other", "ObjectValueName": "VulnerableDriverBlocklistEnable"}),
    (8193, "Application", None, {}),
    (524, "System", None, {}),
    (13002, HYPERV, None, {"VmName": "vm1"}),
    (106, TASK_SCHEDULER, None, {"TaskName": "\\Backup"}),
    (140, TASK_SCHEDULER, None, {"TaskName": "\\GoogleUpdateTaskX"}),
    (140, TASK_SCHEDULER, None, {"TaskName": "\\googleupdatetaskx"}),
    _process("C:\\x\\RBCW.exe"),
    (4104, POWERSHELL, None, {"ScriptBlockText": "get-vm | stop"}),
    (4104, POWERSHELL, None, {"ScriptBlockText": "Clear-EventLog -LogName Security"}),
    (4104, POWERSHELL, None, {"ScriptBlockText": "Add-MpPreference -ExclusionPath C:\\t"}),
    _process("C:\\Windows\\rundll32.exe", "\\\\h@SSL\\DavWWWRoot\\a.dll"),
    (11, SYSMON, None, {"TargetFilename": "C:\\u\\akira_README.txt"}),
    (11, SYSMON, None, {"TargetFilename": "C:\\u\\AnyDesk.exe"}),
    (11, SYSMON, None, {"TargetFilename": "C:\\Program Files\\AnyDesk.exe"}),
    (7036, "System", None, {"param1": "WebClient", "param2": "running"}),
    (7036, "System", None, {"param1": "WebClient", "param2": "stopped"}),
    (12, SYSMON, None, {"TargetObject": "HKCU\\Software\\Sysinternals\\Active Directory Explorer\\EulaAccepted"}),
    (6, SYSMON, None, {"ImageLoaded": "C:\\t\\z.sys", "SignatureStatus": "Valid", "Hashes": "SHA1=96a7749d856cb49de32005bcdd8621f38e2b4c05"}),
    (6, SYSMON, None, {"ImageLoaded": "C:\\Program Files\\Zemana\\z.sys", "SignatureStatus": "Valid", "Hashes": "SHA1=96A7749D856CB49DE32005BCDD8621F38E2B4C05"}),
    (7, SYSMON, None, {"Image": "C:\\t\\a.exe", "ImageLoaded": "C:\\t\\Srvcli.dll"}),
    (7, SYSMON, None, {"Image": "C:\\t\\a.exe", "ImageLoaded": "C:\\Windows\\System32\\srvcli.dll"}),
    (23, SYSMON, None, {"TargetFilename": "C:\\u\\ConsoleHost_history.txt"}),
    _process("C:\\t\\c.exe", "client --reverse R:socks", audit=True),
    (5861, WMI_ACTIVITY, None, {"ESS": "f1", "CONSUMER": "c1", "PossibleCause": "none", "Query": "select * from x"}),
    (5860, WMI_ACTIVITY, None, {"ProviderName": "p", "PossibleCause": "a cause"}),
    (20, SYSMON, None, {"Name": "consumer 20"}),
    (21, SYSMON, None, {"Consumer": "consumer 21", "Filter": "filter 21"}),
    _process("C:\\Windows\\cmd.exe", "cmd /Q /c dir 1> \\\\127.0.0.1\\admin$\\__1"),
    _process("C:\\7z.exe", "a -mhe x", "C:\\wmiprvse.exe"),
    (22, SYSMON, None, {"Image": "C:\\t\\a.exe", "QueryName": "a.Workers.dev"}),
    (22, SYSMON, None, {"Image": "C:\\chrome.exe", "QueryName": "a.workers.dev"}),
    _process("C:\\vssadmin.exe", "vssadmin DELETE shadows /all", audit=True),
    _process("C:\\wbem\\WMIC.exe", "wmic shadowcopy delete"),
    _process("C:\\bcdedit.exe", "/set RecoveryEnabled No"),
    _process("C:\\wevtutil.exe", "wevtutil cl Security"),
    (5001, DEFENDER, None, {}),
    (5007, DEFENDER, None, {"New Value": "x"}),
    (1116, DEFENDER, "Microsoft-Windows-Windows Defender", {"Threat Name": "Bad", "Severity Name": "High", "Path": "C:\\b.exe", "Process Name": "C:\\a.exe"}),
    (1117, DEFENDER, "Microsoft-Windows-Windows Defender", {"ThreatName": "Worse", "Severity": "Severe", "Action": "Remove"}),
    (1006, "Microsoft-Windows-Partition/Diagnostic", PARTITION, {"DiskNumber": "1", "BusType": "7", "Model": "Stick", "SerialNumber": " 12 ", "Capacity": "42949672960", "Vbr0": _NTFS}),
    (1006, "Microsoft-Windows-Partition/Diagnostic", PARTITION, {"DiskNumber": "2", "SerialNumber": " ", "Vbr0": _FAT32}),
    (1006, "Microsoft-Windows-Partition/Diagnostic", PARTITION, {"DiskNumber": "x", "Vbr0": _FAT16}),
    (10, SYSMON, None, {"SourceImage": "C:\\t\\a.exe", "TargetImage": "C:\\Windows\\LSASS.exe", "GrantedAccess": "0x1410"}),
    _process("C:\\Windows\\rundll32.exe", "comsvcs.dll, MiniDump 1 x full", "C:\\Windows\\explorer.exe"),
    (13, SYSMON, None, {"TargetObject": "HKLM\\x\\fDenyTSConnections", "Details": "DWORD (0x00000000)"}),
    (13, SYSMON, None, {"TargetObject": "HKLM\\x\\fDenyTSConnections", "Details": "DWORD (0x00000001)"}),
    (4720, "Security", None, {"TargetUserName": "eve", "TargetDomainName": "d"}),
    (4732, "Security", None, {"GroupSid": "S-1-5-32-544", "GroupName": "Administrators"}),
    (4732, "Security", None, {"GroupSid": "S-1-5-32-545"}),
    (5140, "Security", None, {"SubjectUserName": "u", "ShareName": "\\\\*\\ADMIN$", "IpAddress": "10.0.0.1"}),
    (5140, "Security", None, {"SubjectUserName": "u", "ShareName": "\\\\*\\ADMIN$", "IpAddress": "::1"}),
    (4662, "Security", None, {"ObjectServer": "Directory Service X", "AccessMask": "0x1"}),
    (4662, "Security", None, {"ObjectServer": "DS", "AccessMask": "0x100"}),
    (4662, "Security", None, {"ObjectServer": "DS", "AccessMask": "0x20"}),
    (4778, "Security", None, {"AccountName": "u", "SessionID": "3", "ClientAddress": "10.1.1.1"}),
    (4779, "Security", None, {"AccountName": "u", "SessionID": "three"}),
    (4625, "Security", None, {"SubStatus": "0xC000006A"}),
    _process("C:\\Windows\\taskkill.exe", "taskkill /F /IM sqlservr.exe"),
    _process("C:\\Windows\\taskkill.exe", "taskkill /f /im winword.exe", audit=True),
    _process("C:\\Windows\\taskkill.exe", "taskkill /im other.exe"),
    _process("C:\\Windows\\taskkill.exe", "taskkill /im Veeam.exe"),
    _process("C:\\Windows\\net1.exe", "net stop GxVss"),
    _process("C:\\Windows\\sc.exe", "sc stop SQLBrowser", audit=True),
    _process("C:\\Windows\\net.exe", "net stop myservice1"),
)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silver table; the table of scenes is constant and small, so it is broadcast."""
    rows = [(i, *s[:3], s[3] | {"Scene": str(i)}) for i, s in enumerate(SCENES)]
    constant = spark.createDataFrame(rows, "scene long, s_event int, channel string, provider string, said map<string,string>")
    n, user = F.col("event_id"), F.col("user_id")
    e = events(spark, sf_dir).join(F.broadcast(constant), n % len(SCENES) == F.col("scene"))
    return conform(
        e.select(
            F.concat(F.lit("src"), user % 3).alias("source"),
            n.alias("record_id"),
            F.expr("timestamp_micros(unix_micros(cast(ts as timestamp)) div 1000)").cast("timestamp_ntz").alias("ts"),
            F.col("s_event").alias("event_id"),
            "channel",
            "provider",
            F.concat(F.lit("host"), user % 5).alias("computer"),
            n.alias("seq"),
            F.map_concat("said", F.create_map(F.lit("User"), F.concat(F.lit("user"), user % 9))).alias("data"),
        )
    )


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_ROWS = ",\n    ".join(f"({i}, {s[0]}, {_text(s[1])}, {_text(s[2])}, MAP {{{', '.join(f'{_text(k)}: {_text(v)}' for k, v in (s[3] | {'Scene': str(i)}).items())}}})" for i, s in enumerate(SCENES))

#: DuckDB's form of scenes(): `sc`.
SC = f"""sc AS (SELECT concat('src', user_id % 3) AS source, e.event_id AS record_id, make_timestamp(epoch_us(ts) // 1000) AS ts, s.event_id, channel, provider, concat('host', user_id % 5) AS computer, d, concat('user', user_id % 9) AS who
  FROM events e JOIN (VALUES
    {_ROWS}) AS s(scene, event_id, channel, provider, d) ON e.event_id % {len(SCENES)} = s.scene)"""
