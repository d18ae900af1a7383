"""The driver's `events` table as a silver table, in Spark and in DuckDB's SQL.

The vocabulary is made up: it exercises the operators and says nothing about real logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schema import POWERSHELL, conform

IMAGES = ("svchost.exe", "cmd.exe", "rundll32.exe", "Certutil.exe", "vssadmin.exe", "7z.exe", "taskkill.exe", "net.exe", "notepad.exe")
PARENTS = ("explorer.exe", "services.exe", "wmiprvse.exe", "cmd.exe")
COMMANDS = ("run", "delete shadows /all", "x -mhe out.7z", "/f /im sqlservr.exe", "stop veeambackupsvc", "client --reverse R:socks", "get \\\\srv@SSL\\DavWWWRoot\\a.dll")
SHARES = ("\\\\*\\ADMIN$", "\\\\*\\C$", "\\\\*\\public", "\\\\*\\IPC$", "\\\\*\\users")
SERVICES = ("zam", "spooler", "RTCORE64", "w32time")
CIPHERS = ("0x17", "0x12", "0x11", "0x1")
LOGON_TYPES = (2, 3, 10, 5)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    event = (
        F.when(kind == "signup", 4624)
        .when(kind == "error", F.when(n % 5 == 0, 4647).otherwise(4634))
        .when(kind == "click", F.when(n % 11 == 0, 4104).otherwise(4688))
        .when(kind == "view", F.when(n % 3 == 0, 5145).otherwise(5140))
        .otherwise(F.when(n % 6 == 0, 4768).when(n % 6 == 1, 4776).when(n % 6 == 2, 4648).when(n % 6 == 3, 4698).when(n % 6 == 4, 7045).otherwise(4769))
    )
    text = {
        "TargetLogonId": F.concat(F.lit("0x"), user),
        "TargetUserName": F.concat(F.lit("user"), user % 9),
        "SubjectUserName": F.concat(F.lit("user"), n % 9),
        "LogonType": _pick(LOGON_TYPES, n).cast("string"),
        "IpAddress": F.when(n % 7 == 0, "-").otherwise(F.concat_ws(".", F.lit("10.0"), user % 4, k % 200)),
        "WorkstationName": F.when(n % 3 == 0, "-").otherwise(F.concat(F.lit("WS"), user % 6)),
        "NewProcessName": F.concat(F.lit("C:\\Windows\\System32\\"), _pick(IMAGES, n)),
        "ParentProcessName": F.concat(F.lit("C:\\Windows\\"), _pick(PARENTS, k)),
        "CommandLine": _pick(COMMANDS, n + k),
        "NewProcessId": F.concat(F.lit("0x"), F.lower(F.hex(n % 97))),
        "ProcessId": F.concat(F.lit("0x"), F.lower(F.hex(k % 97))),
        "ShareName": _pick(SHARES, n),
        "ServiceName": _pick(SERVICES, n + k),
        "TicketEncryptionType": _pick(CIPHERS, k),
        "PreAuthType": (k % 3).cast("string"),
        "TaskName": F.concat(F.lit("\\Task"), k % 12),
        "ScriptBlockId": F.concat(F.lit("b"), n % 40),
        "MessageNumber": (k % 7).cast("string"),
        "ScriptBlockText": F.concat(F.lit("part "), n),
        "k": k.cast("string"),
    }
    e = e.select(
        F.concat(F.lit("src"), user % 3).alias("source"),
        n.alias("record_id"),
        "ts",
        event.cast("int").alias("event_id"),
        F.when(event == 4104, POWERSHELL).when(event == 7045, "System").otherwise("Security").alias("channel"),
        F.concat(F.lit("host"), user % 5).alias("computer"),
        n.alias("seq"),
        F.create_map(*[x for key, c in text.items() for x in (F.lit(key), c)]).alias("data"),
    )
    return conform(e)


def _case(values: tuple, by: str) -> str:
    quoted = ["'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values]
    return f"([{', '.join(quoted)}])[CAST(({by}) % {len(values)} AS INT) + 1]"


#: DuckDB's form of silver(): `evt`, with what is in the map as columns.
EVT = f"""evt AS (SELECT concat('src', user_id % 3) AS source, event_id AS record_id, ts,
  CASE event_type WHEN 'signup' THEN 4624 WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 4647 ELSE 4634 END
    WHEN 'click' THEN CASE WHEN event_id % 11 = 0 THEN 4104 ELSE 4688 END WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 5145 ELSE 5140 END
    ELSE CASE event_id % 6 WHEN 0 THEN 4768 WHEN 1 THEN 4776 WHEN 2 THEN 4648 WHEN 3 THEN 4698 WHEN 4 THEN 7045 ELSE 4769 END END AS event_id,
  concat('host', user_id % 5) AS computer, concat('0x', user_id) AS logon_id, concat('user', user_id % 9) AS target_user, concat('user', event_id % 9) AS subject_user,
  {_case(LOGON_TYPES, "event_id")} AS logon_type, CASE WHEN event_id % 7 = 0 THEN '-' ELSE concat('10.0.', user_id % 4, '.', k % 200) END AS ip,
  CASE WHEN event_id % 3 = 0 THEN '-' ELSE concat('WS', user_id % 6) END AS workstation,
  concat('C:\\Windows\\System32\\', {_case(IMAGES, "event_id")}) AS image, concat('C:\\Windows\\', {_case(PARENTS, "k")}) AS parent_image, {_case(COMMANDS, "event_id + k")} AS command_line,
  event_id % 97 AS pid, k % 97 AS ppid, {_case(SHARES, "event_id")} AS share, {_case(SERVICES, "event_id + k")} AS service, {_case(CIPHERS, "k")} AS cipher, CAST(k % 3 AS VARCHAR) AS preauth,
  concat('\\Task', k % 12) AS task, concat('b', event_id % 40) AS script_id, k % 7 AS part, concat('part ', event_id) AS script, k, user_id, event_id AS n
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
