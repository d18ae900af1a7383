"""The silver event table: a fixed envelope, and what the event says as a map of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SILVER = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ts_ticks", T.LongType()),
        T.StructField("event_id", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("computer", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("provider_guid", T.StringType()),
        T.StructField("user_sid", T.StringType()),
        T.StructField("process_id", T.IntegerType()),
        T.StructField("thread_id", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    ]
)

DETECTION = "kind string, technique string, tactic string, description string, evidence array<string>, ts timestamp_ntz, event_id int, channel string, record_id long"

EPOCH_TICKS = 116_444_736_000_000_000

SYSMON = "Microsoft-Windows-Sysmon/Operational"
POWERSHELL = "Microsoft-Windows-PowerShell/Operational"
TASK_SCHEDULER = "Microsoft-Windows-TaskScheduler/Operational"
DEFENDER = "Microsoft-Windows-Windows Defender/Operational"
WMI_ACTIVITY = "Microsoft-Windows-WMI-Activity/Operational"
HYPERV = "Microsoft-Windows-Hyper-V-VMMS-Admin"


def conform(df: DataFrame) -> DataFrame:
    """df with all silver columns, in order; missing ones are null, ts and ts_ticks come from each other."""
    have = set(df.columns)
    if "ts" in have and "ts_ticks" not in have:
        df = df.withColumn("ts_ticks", F.unix_micros(F.col("ts").cast("timestamp")) * 10 + EPOCH_TICKS)
    if "ts_ticks" in have and "ts" not in have:
        df = df.withColumn("ts", F.timestamp_micros(F.floor((F.col("ts_ticks") - EPOCH_TICKS) / 10)).cast("timestamp_ntz"))
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SILVER.fields])
