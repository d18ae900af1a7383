"""Registered queries against their SQL in DuckDB, over a small table of events."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from logloom.container import binxml
from logloom.operators.manifest import FIELDS, SECURITY
from logloom.sources import logs as L

NAMES = [
    *("detect_scenes", "detect_bursts", "detect_all", "hunt_dcsync", "hunt_wmi_persistence", "hunt_lsass_access", "hunt_defender_tamper"),
    *("extract_rdp", "extract_defender", "extract_wmi", "extract_partitions", "extract_all_kinds", "search_computers", "search_channels", "field_values_system"),
    *("ioc_scenes", "cleared_logs", "logon_failure_names", "etw_tamper", "csv_guard", "mermaid_lines", "phantom_gap"),
    *("evtx_templates", "evtx_projection", "carve_stats", "evtx_sweep", "info_full", "evtx_damage", "evtx_validate", "disk_partitions"),
    *("evtx_repair_parts", "source_files", "evtx_lenient", "triage_folder", "manifest_files", "logons_of_type", "detect_own_rules", "ndjson_read_back", "csv_read_back"),
    *("stream_frequency", "stream_logons", "stream_bursts", "stream_logs", "evtx_payload_problems"),
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("tables"), random.Random(1)
    n = 1500
    at = sorted(r.uniform(0, 4.0 * 86400) for _ in range(n))
    ts = [datetime(2024, 1, 1) + timedelta(microseconds=int(s * 1e6)) for s in at]
    kinds = ["signup", "error", "click", "view", "purchase"]
    columns = {"event_id": list(range(n)), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [r.randrange(30) for _ in range(n)], "event_type": [r.choice(kinds) for _ in range(n)], "value": [r.randrange(30000) / 100 for _ in range(n)], "props": ['{"k": %d}' % r.randrange(100) for _ in range(n)]}
    pq.write_table(pa.table(columns), folder / "events.parquet")
    pq.write_table(pa.table({"c_custkey": pa.array(range(20), pa.int64()), "c_name": [f"c{i}" for i in range(20)], "c_nationkey": pa.array([i % 5 for i in range(20)], pa.int32())}), folder / "customer.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, tables, name):
    found = __spark_entry__.queries()[name](spark, f"file://{tables}")
    names = sorted(found.columns)
    got = sorted(tuple(str(row[c]) for c in names) for row in found.collect())
    db = duckdb.connect()
    for t in ("events", "customer"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    sql = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(c) for c in names]
    want = sorted(tuple(str(row[i]) for i in at) for row in sql.fetchall())
    assert got == want and want


def test_logs_are_repaired_in_slices_that_go(spark, tables, monkeypatch):
    """Slices of the logs give the same as all at once, and none of their files is left, nor are two slices there together."""
    from pathlib import Path

    from logloom.plans import file_queries, log_queries

    folders, there, plain = [], [], file_queries.work_folder

    def noted(spark, name):
        there.append([p for p in folders if list(Path(p.removeprefix("file:")).glob("*.evtx"))])
        folders.append(plain(spark, name))
        return folders[-1]

    monkeypatch.setattr(file_queries, "work_folder", noted)
    monkeypatch.setattr(log_queries, "work_folder", noted)
    monkeypatch.setattr(file_queries, "AT_ONCE", 1_300_000)
    found = file_queries.evtx_repair_parts(spark, f"file://{tables}")
    of_logs = [p for p in folders if "/broken-" in p or "/repaired-" in p]
    assert len(of_logs) == 6 and not any(Path(p.removeprefix("file:")).exists() for p in of_logs) and max(map(len, there)) == 1
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    want = db.sql(f"SELECT source, n_mended, sound, n, ids FROM ({__spark_entry__.oracle_sql()['evtx_repair_parts']})").fetchall()
    assert sorted(map(tuple, found.select("source", "n_mended", "sound", "n", "ids").collect())) == sorted(want) and want


def test_logs_are_made_alike_from_groups_and_sorted_rows(spark, tables):
    from logloom.plans.log_queries import made_logs

    for templates in (False, True):
        one, other = ({r["source"]: bytes(r["content"]) for r in made_logs(spark, f"file://{tables}", templates, streamed=s).collect()} for s in (False, True))
        assert one == other and len(one) == 30


def test_every_query_has_sql_or_is_known_to_have_none():
    without = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert {n for n in without if not n.startswith("op") and n != "pipeline"} == set()


def test_bundled_manifests():
    assert len(FIELDS) == 33 and len({g for g, _ in FIELDS}) == 8
    assert FIELDS[SECURITY, 4624][5] == "TargetUserName" and FIELDS[SECURITY, 4624][18] == "IpAddress"


def test_projection_of_repeated_children():
    e = binxml.Element
    tree = e("Event", {"x": "1"}, [e("A", {}, ["one"]), e("B", {}, ["two"]), e("A", {"k": "v"}, ["three"]), e("C", {}, [])])
    assert binxml.projected(tree) == {"A": ["one", {"@k": "v", "#text": "three"}], "B": "two", "C": "", "@x": "1"}


def test_files_once_each(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/one.evtx", "a/b/TWO.EVTX", "a/other.txt"):
        (tmp_path / name).write_bytes(b"ElfFile\x00" + name.encode())
    found = L.files(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/a/b")
    assert sorted((r["source"].rsplit("/", 1)[-1], r["length"], len(r["sha256"])) for r in found.collect()) == [("TWO.EVTX", 20, 64), ("one.evtx", 18, 64)]
    for paths in (["a"], ["a/one.evtx", "a/b"], ["a/*", "a"], ["a/*.evtx", "a/on*", "a/b/"], ["a/b/../b", "a/b", "a/one.evtx"]):
        names = sorted(r["source"].rsplit("/", 1)[-1] for r in L.files(spark, *(f"{tmp_path}/{p}" for p in paths)).select("source").collect())
        assert names == ["TWO.EVTX", "one.evtx"], paths


def test_triage_and_shell(spark, tmp_path, capsys):
    import json

    from logloom.__main__ import main
    from logloom.container import evtx

    def event(i):
        field = binxml.Element("Data", {"Name": "TargetUserName"}, [f"user{i}"])
        text = lambda name, x: binxml.Element(name, {}, [x])
        system = binxml.Element("System", {}, [text("EventID", "4698"), text("Channel", "Security"), text("Computer", "pc")])
        return binxml.Element("Event", {}, [system, binxml.Element("EventData", {}, [field])])

    chunk, used = [], 0
    for i in range(1, 6):
        raw = evtx.record_bytes(i, 132700000000000000 + i * 10_000_000, binxml.encode(event(i), evtx.RECORDS_AT + used + 24))
        chunk.append(raw)
        used += len(raw)
    log = evtx.file_header(1, 6) + evtx.chunk_bytes(chunk, 1)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.evtx").write_bytes(log)
    (tmp_path / "blob.bin").write_bytes(bytes(4096 + 40) + log[4096:])
    (tmp_path / "image.E01").write_bytes(b"EVF\x09\x0d\x0a\xff\x00")

    def run(*arguments):
        code = main(list(arguments), spark)
        return code, capsys.readouterr().out.splitlines()

    code, out = run("report", f"file://{tmp_path}/logs")
    assert code == 0 and [(r["how"], r["size"], r["records"], r["findings"]) for r in map(json.loads, out)] == [("filesystem", len(log), 5, [])]
    code, out = run("report", f"file://{tmp_path}/blob.bin")
    assert code == 0 and [(r["how"], r["chunks"], r["records"]) for r in map(json.loads, out)] == [("carved", 1, 5)]
    assert run("report", f"file://{tmp_path}/image.E01")[0] == 2
    assert run("verify", f"file://{tmp_path}/logs") == (0, [])
    assert run("detect", f"file://{tmp_path}/logs")[0] == 1
    code, out = run("timeline", f"file://{tmp_path}/logs", "--limit", "2", "--format", "csv")
    assert code == 0 and len(out) == 3 and out[0].startswith("record_id,ts")
    assert run("search", f"file://{tmp_path}/logs", "--query", "USER3")[0] == 1
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "b.evtx").write_bytes(log[:0x7C] + bytes(4) + log[0x80 : 4096 + 0x78] + bytes(4) + log[4096 + 0x7C :])
    code, out = run("repair", f"file://{tmp_path}/broken", "--repaired", f"file://{tmp_path}/mended")
    assert code == 0 and [(r["chunks_checked"], r["chunks_repaired"], r["header_repaired"]) for r in map(json.loads, out)] == [(1, 1, True)]
    assert [p.read_bytes() for p in (tmp_path / "mended").iterdir()] == [log]
    code, out = run("repair", f"file://{tmp_path}/mended")
    assert code == 0 and [(r["chunks_checked"], r["chunks_repaired"], r["header_repaired"]) for r in map(json.loads, out)] == [(1, 0, False)]
    assert run("timeline", f"file://{tmp_path}/none")[0] == 3
    assert main(["no-such-command", "x"], spark) == 2


def test_images_with_partitions_are_made_once(spark, tables):
    plan = __spark_entry__.queries()["disk_partitions"](spark, f"file://{tables}")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("MapInArrow") == 1


def test_triage_reads_contents_twice_and_counts_cut_off_chunks(spark, tmp_path):
    from pyspark.sql import functions as F

    from logloom.container import evtx
    from logloom.plans.triage import triage

    log = evtx.write_log((i, 132700000000000000 + i, b"\x0f\x01\x01\x00") for i in range(1, 2500))
    bad = bytearray(log)
    bad[4096 + 0x60] ^= 1
    contents = {"whole": log, "bad": bytes(bad), "cut": log[: 4096 + 65536 + 125], "cut2": log[: 4096 + 65536 + 700], "far": log[: 4096 + 0x2C] + b"\xff" * 8 + log[4096 + 0x34 :], "head": log[:4096], "short": b"ElfFile"}
    for name, content in contents.items():
        (tmp_path / f"{name}.evtx").write_bytes(content)
    found = triage(spark, f"file://{tmp_path}")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" not in plan and plan.count("binaryFile") == 1
    logs = L.files(spark, f"file://{tmp_path}")
    counts = L.carve_stats(L.chunks(logs)).select("source", F.col("chunks_found").alias("chunks"), F.col("records_recovered").alias("records"))
    want = {r["source"]: (r["chunks"], r["records"]) for r in counts.collect()}
    got = {r["source"]: (r["chunks"], r["records"]) for r in found.collect()}
    assert len(got) == len(contents) and {k: v for k, v in got.items() if v != (0, 0)} == want
