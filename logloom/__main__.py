"""The operators from a shell: python -m logloom COMMAND PATH... [--format jsonl|table|csv] [--out FOLDER].

Ends with 0 if nothing was found, 1 if there are findings, 2 after an error, 3 if a path is missing.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import analytics as A
from logloom.operators import detect as D
from logloom.operators import extract as X
from logloom.operators.integrity import findings, verify
from logloom.plans.triage import exists, triage
from logloom.session import session
from logloom.sinks import writers as W
from logloom.sources import logs as L
from logloom.sources import ranges as R

CLEAN, FOUND, ERROR, MISSING = 0, 1, 2, 3


def _verify(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if R.readable(*a.paths):
        return findings(R.log_ranges(spark, *a.paths, rows="facts"), least=a.least)
    return verify(L.files(spark, *a.paths), least=a.least)


def _timeline(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = A.timeline(L.read_logs(spark, *a.paths), a.event_id, a.after, a.before)
    return A.first_events(rows, a.limit) if a.limit else rows.orderBy("ts", "record_id")


def _sessions(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return A.logon_sessions(L.read_logs(spark, *a.paths), by_host=True, logon_type=a.logon_type)


def _frequency(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    counts = A.frequency(L.read_logs(spark, *a.paths))
    return A.z_scores(counts, a.min_z) if a.min_z else counts.orderBy("n", "event_id")


def _diff(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    added, removed = A.difference(*(L.read_logs(spark, p) for p in a.paths[:2]))
    return added.withColumn("side", F.lit("added")).unionByName(removed.withColumn("side", F.lit("removed")))


def _info(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    logs = L.files(spark, *a.paths)
    chunks = L.chunks(logs)
    return A.info(logs, L.carve_stats(chunks), L.decoded(chunks), verify(logs))


def _extract(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    evt = L.read_logs(spark, *a.paths)
    return X.extract_all(evt) if a.what is None else X.EXTRACTORS[a.what](evt)


def _repair(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if not R.readable(*a.paths):
        if a.repaired:
            raise ValueError("logs that Spark's readers alone can open are checked, but not written")
        return W.repaired(L.files(spark, *a.paths)).drop("content")
    parts = W.repaired_parts(spark, *a.paths)
    if a.repaired:
        W.write_parts(parts, a.repaired, ".evtx", "chunk_offset").write.format("noop").mode("overwrite").save()
    of_chunk = F.col("chunk_offset") > 0
    counts = [F.count_if(of_chunk & F.col("mended").isNotNull()).alias("chunks_checked"), F.count_if(of_chunk & F.col("mended")).alias("chunks_repaired")]
    return parts.groupBy("source").agg(*counts, F.coalesce(F.bool_or(~of_chunk & F.col("mended")), F.lit(False)).alias("header_repaired"))


#: What a command gives, and whether rows of it are findings.
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame], bool]] = {
    "verify": (_verify, True),
    "timeline": (_timeline, False),
    "sessions": (_sessions, False),
    "graph": (lambda spark, a: A.logon_edges(L.read_logs(spark, *a.paths)), False),
    "frequency": (_frequency, False),
    "rare": (lambda spark, a: A.rare_processes(L.read_logs(spark, *a.paths), a.below), False),
    "search": (lambda spark, a: A.search_events(L.read_logs(spark, *a.paths, leaves=True), a.query, a.regex), True),
    "hunt": (lambda spark, a: X.hunt(L.read_logs(spark, *a.paths), a.what), True),
    "diff": (_diff, True),
    "processes": (lambda spark, a: A.process_nodes(L.read_logs(spark, *a.paths)), False),
    "scripts": (lambda spark, a: A.script_blocks(L.read_logs(spark, *a.paths)), False),
    "extract": (_extract, False),
    "detect": (lambda spark, a: D.detect_all(L.read_logs(spark, *a.paths)), True),
    "info": (_info, False),
    "repair": (_repair, False),
    "report": (lambda spark, a: triage(spark, a.paths[0]), False),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("logloom")
    p.add_argument("command", choices=list(COMMANDS))
    p.add_argument("paths", nargs="+", help="logs, or folders that hold some")
    p.add_argument("--format", choices=["jsonl", "table", "csv", "markdown"], default="jsonl")
    p.add_argument("--out", help="a folder to write to (jsonl and csv), whatever the size of the result")
    p.add_argument("--repaired", help="a folder to write repaired logs to (repair)")
    p.add_argument("--event-id", type=int, action="append")
    p.add_argument("--after")
    p.add_argument("--before")
    p.add_argument("--limit", type=int)
    p.add_argument("--logon-type", type=int)
    p.add_argument("--least", help="lowest severity (verify)")
    p.add_argument("--min-z", type=float)
    p.add_argument("--below", type=int, default=5)
    p.add_argument("--query", default="")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--what", help="an extractor or hunt")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as x:
        return ERROR if x.code else CLEAN
    spark = spark or session()
    if not all(exists(spark, p) for p in a.paths):
        print("no such path", file=sys.stderr)
        return MISSING
    make, findings = COMMANDS[a.command]
    try:
        rows = make(spark, a)
        if a.out:
            (W.write_csv if a.format == "csv" else W.write_ndjson)(rows, a.out)
        elif a.format == "jsonl":
            for line in W.json_lines(rows):
                print(line)
        elif a.format == "csv":
            flat = W.flattened_for_csv(rows)
            print(",".join(flat.columns))
            for r in flat.select(F.to_csv(F.struct("*"))).toLocalIterator():
                print(r[0])
        else:
            print(W.table(rows) if a.format == "table" else W.markdown_report(a.command, {a.command: rows}))
        return FOUND if findings and not rows.isEmpty() else CLEAN
    except Exception as x:  # noqa: BLE001 - whatever goes wrong is an error of the command
        print(f"{type(x).__name__}: {x}", file=sys.stderr)
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
