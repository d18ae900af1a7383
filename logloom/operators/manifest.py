"""Names for positional event fields, from provider manifests."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.columns import normal_guid

# ---- Fixed values: field names in the order of the providers' templates ----
SECURITY = "{54849625-5478-4994-a5ba-3e3b0328c30d}"
EVENTLOG = "{fc65ddd8-d6ef-4962-83d5-6e5cfe9ce148}"
POWERSHELL = "{a0c1853b-5c40-4b15-8766-3cf1c58f985a}"
WMI_ACTIVITY = "{1418ef04-b0b4-4623-bf7e-d74ab47bbdaa}"
SYSMON = "{5770385f-c22a-43e0-bf4c-06f5698ffbd9}"
TASK_SCHEDULER = "{de7b24ea-73c8-4a09-985d-5bdadcfa9017}"
REMOTE_CONNECTIONS = "{c76baa63-ae81-421c-b425-340b4b24157f}"
DEFENDER = "{11cd958a-c507-4ef3-b3f2-5fd9dfbd2c78}"
FIELDS = {
    (SECURITY, 4624): [
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "TargetUserSid",
        "TargetUserName",
        "TargetDomainName",
        "TargetLogonId",
        "LogonType",
        "LogonProcessName",
        "AuthenticationPackageName",
        "WorkstationName",
        "LogonGuid",
        "TransmittedServices",
        "LmPackageName",
        "KeyLength",
        "ProcessId",
        "ProcessName",
        "IpAddress",
        "IpPort",
        "ImpersonationLevel",
        "RestrictedAdminMode",
        "TargetOutboundUserName",
        "TargetOutboundDomainName",
        "VirtualAccount",
        "TargetLinkedLogonId",
        "ElevatedToken",
    ],
    (SECURITY, 4625): [
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "TargetUserSid",
        "TargetUserName",
        "TargetDomainName",
        "Status",
        "FailureReason",
        "SubStatus",
        "LogonType",
        "LogonProcessName",
        "AuthenticationPackageName",
        "WorkstationName",
        "TransmittedServices",
        "LmPackageName",
        "KeyLength",
        "ProcessId",
        "ProcessName",
        "IpAddress",
        "IpPort",
    ],
    (SECURITY, 4634): ["TargetUserSid", "TargetUserName", "TargetDomainName", "TargetLogonId", "LogonType"],
    (SECURITY, 4648): [
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "LogonGuid",
        "TargetUserName",
        "TargetDomainName",
        "TargetLogonGuid",
        "TargetServerName",
        "TargetInfo",
        "ProcessId",
        "ProcessName",
        "IpAddress",
        "IpPort",
    ],
    (SECURITY, 4656): [
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "ObjectServer",
        "ObjectType",
        "ObjectName",
        "HandleId",
        "TransactionId",
        "AccessList",
        "AccessReason",
        "AccessMask",
        "PrivilegeList",
        "RestrictedSidCount",
        "ProcessId",
        "ProcessName",
        "ResourceAttributes",
    ],
    (SECURITY, 4663): [
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "ObjectServer",
        "ObjectType",
        "ObjectName",
        "HandleId",
        "AccessList",
        "AccessMask",
        "ProcessId",
        "ProcessName",
        "ResourceAttributes",
    ],
    (SECURITY, 4672): ["SubjectUserSid", "SubjectUserName", "SubjectDomainName", "SubjectLogonId", "PrivilegeList"],
    (SECURITY, 4688): [
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "NewProcessId",
        "NewProcessName",
        "TokenElevationType",
        "ProcessId",
        "CommandLine",
        "TargetUserSid",
        "TargetUserName",
        "TargetDomainName",
        "TargetLogonId",
        "ParentProcessName",
        "MandatoryLabel",
    ],
    (SECURITY, 4689): [
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "Status",
        "ProcessId",
        "ProcessName",
    ],
    (SECURITY, 4698): ["SubjectUserSid", "SubjectUserName", "SubjectDomainName", "SubjectLogonId", "TaskName", "TaskContent"],
    (SECURITY, 4702): ["SubjectUserSid", "SubjectUserName", "SubjectDomainName", "SubjectLogonId", "TaskName", "TaskContentNew"],
    (SECURITY, 4720): [
        "TargetUserName",
        "TargetDomainName",
        "TargetSid",
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "PrivilegeList",
        "SamAccountName",
        "DisplayName",
        "UserPrincipalName",
        "HomeDirectory",
        "HomePath",
        "ScriptPath",
        "ProfilePath",
        "UserWorkstations",
        "PasswordLastSet",
        "AccountExpires",
        "PrimaryGroupId",
        "AllowedToDelegateTo",
        "OldUacValue",
        "NewUacValue",
        "UserAccountControl",
        "UserParameters",
        "SidHistory",
        "LogonHours",
    ],
    (SECURITY, 4732): [
        "MemberName",
        "MemberSid",
        "TargetUserName",
        "TargetDomainName",
        "TargetSid",
        "SubjectUserSid",
        "SubjectUserName",
        "SubjectDomainName",
        "SubjectLogonId",
        "PrivilegeList",
    ],
    (SECURITY, 4768): [
        "TargetUserName",
        "TargetDomainName",
        "TargetSid",
        "ServiceName",
        "ServiceSid",
        "TicketOptions",
        "Status",
        "TicketEncryptionType",
        "PreAuthType",
        "IpAddress",
        "IpPort",
        "CertIssuerName",
        "CertSerialNumber",
        "CertThumbprint",
    ],
    (SECURITY, 4769): [
        "TargetUserName",
        "TargetDomainName",
        "ServiceName",
        "ServiceSid",
        "TicketOptions",
        "TicketEncryptionType",
        "IpAddress",
        "IpPort",
        "Status",
        "LogonGuid",
        "TransmittedServices",
    ],
    (SECURITY, 4776): ["PackageName", "TargetUserName", "Workstation", "Status"],
    (SECURITY, 1102): ["SubjectUserSid", "SubjectUserName", "SubjectDomainName", "SubjectLogonId"],
    (EVENTLOG, 104): ["SubjectUserName", "SubjectDomainName"],
    (POWERSHELL, 4104): ["MessageNumber", "MessageTotal", "ScriptBlockText", "ScriptBlockId", "Path"],
    (POWERSHELL, 4103): ["ContextInfo", "UserData"],
    (WMI_ACTIVITY, 5857): ["ProviderName", "Code", "HostProcess", "ProviderGUID", "IsProvider"],
    (WMI_ACTIVITY, 5858): [
        "NamespaceName",
        "UserName",
        "ClientMachine",
        "ClientMachineFQDN",
        "ClientProcessId",
        "Component",
        "Operation",
        "ResultCode",
        "PossibleCause",
    ],
    (WMI_ACTIVITY, 5860): ["NamespaceName", "Query", "User", "ClientMachine"],
    (WMI_ACTIVITY, 5861): ["NamespaceName", "Query", "Consumer", "PossibleCause"],
    (SYSMON, 1): [
        "RuleName",
        "UtcTime",
        "ProcessGuid",
        "ProcessId",
        "Image",
        "FileVersion",
        "Description",
        "Product",
        "Company",
        "OriginalFileName",
        "CommandLine",
        "CurrentDirectory",
        "User",
        "LogonGuid",
        "LogonId",
        "TerminalSessionId",
        "IntegrityLevel",
        "Hashes",
        "ParentProcessGuid",
        "ParentProcessId",
        "ParentImage",
        "ParentCommandLine",
        "ParentUser",
    ],
    (SYSMON, 3): [
        "RuleName",
        "UtcTime",
        "ProcessGuid",
        "ProcessId",
        "Image",
        "User",
        "Protocol",
        "Initiated",
        "SourceIsIpv6",
        "SourceIp",
        "SourceHostname",
        "SourcePort",
        "SourcePortName",
        "DestinationIsIpv6",
        "DestinationIp",
        "DestinationHostname",
        "DestinationPort",
        "DestinationPortName",
    ],
    (SYSMON, 7): [
        "RuleName",
        "UtcTime",
        "ProcessGuid",
        "ProcessId",
        "Image",
        "ImageLoaded",
        "FileVersion",
        "Description",
        "Product",
        "Company",
        "OriginalFileName",
        "Hashes",
        "Signed",
        "Signature",
        "SignatureStatus",
        "User",
    ],
    (SYSMON, 11): ["RuleName", "UtcTime", "ProcessGuid", "ProcessId", "Image", "TargetFilename", "CreationUtcTime", "User"],
    (TASK_SCHEDULER, 106): ["TaskName", "UserContext"],
    (TASK_SCHEDULER, 200): ["TaskName", "TaskInstanceId", "ActionName", "UserContext"],
    (TASK_SCHEDULER, 201): ["TaskName", "TaskInstanceId", "ActionName", "ResultCode"],
    (REMOTE_CONNECTIONS, 1149): ["Param1", "Param2", "Param3"],
    (DEFENDER, 1116): [
        "Product Name",
        "Product Version",
        "Detection ID",
        "Detection Time",
        "Threat ID",
        "Threat Name",
        "Severity ID",
        "Severity Name",
        "Category ID",
        "Category Name",
        "FWLink",
        "Status Code",
        "Status Description",
        "State",
        "Source ID",
        "Source Name",
        "Process Name",
        "Detection User",
        "Path",
        "Origin ID",
        "Origin Name",
        "Execution ID",
        "Execution Name",
        "Type ID",
        "Type Name",
        "Pre Execution Status",
        "Action ID",
        "Action Name",
        "Remediation User",
        "Error Code",
        "Error Description",
        "Post Clean Status",
        "Additional Actions ID",
        "Additional Actions String",
        "Remediation Type ID",
        "Remediation Type String",
        "Security intelligence Version",
        "Engine Version",
    ],
}
# ---- End of fixed values ----


def parse_manifest(xml: str) -> dict[tuple[str, int], list[str]]:
    """(guid, event id) -> field names of a manifest; the first definition wins, broken XML gives nothing."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return {}
    out: dict[tuple[str, int], list[str]] = {}
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for provider in (e for e in root.iter() if local(e) == "provider"):
        guid = "{" + provider.get("guid", "").strip().strip("{}").lower() + "}"
        templates = {t.get("tid"): [d.get("name", "") for d in t if local(d) == "data"] for t in provider.iter() if local(t) == "template"}
        for event in (e for e in provider.iter() if local(e) == "event"):
            if event.get("template") in templates and event.get("value", "").isdigit():
                out.setdefault((guid, int(event.get("value"))), templates[event.get("template")])
    return out


def load_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """guid, event_id, fields of all *.man files of a folder, parsed by the tasks that read them. What several
    files define is as in the first of them by path; files that are broken, or no manifests, give nothing."""
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("guid", pa.string()), ("event_id", pa.int32()), ("fields", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py() or b""
                found = parse_manifest(raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace"))
                yield pa.RecordBatch.from_pylist([{"path": path, "guid": g, "event_id": i, "fields": f} for (g, i), f in found.items() if i < 1 << 31], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.man").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "path string, guid string, event_id int, fields array<string>")
    return rows.groupBy("guid", "event_id").agg(F.min_by("fields", "path").alias("fields"))


def named_fields(evt: DataFrame, fields: DataFrame | dict[tuple[str, int], list[str]] | None = None) -> DataFrame:
    """evt with Param1, Param2 ... in data renamed to the fields of its provider and event; others stay. fields: the
    bundled ones, a dict, or rows as those of load_manifests(), whose join is Spark's to choose by their size."""
    if isinstance(fields, DataFrame):
        table = fields.select(F.col("guid").alias("m_guid"), F.col("event_id").alias("m_id"), F.col("fields").alias("m_fields"))
    else:
        rows = [(g, i, f) for (g, i), f in (FIELDS if fields is None else fields).items()]
        table = F.broadcast(evt.sparkSession.createDataFrame(rows, "m_guid string, m_id int, m_fields array<string>"))
    joined = evt.join(table, (normal_guid(F.col("provider_guid")) == F.col("m_guid")) & (F.col("event_id") == F.col("m_id")), "left")

    def name(k: Column, _v: Column) -> Column:
        n = F.regexp_extract(k, "^Param([0-9]{1,4})$", 1)
        return F.coalesce(F.when((n != "") & (n != "0"), F.get("m_fields", n.try_cast("int") - 1)), k)

    return joined.withColumn("data", F.transform_keys("data", name)).drop("m_guid", "m_id", "m_fields")
