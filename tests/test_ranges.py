import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.container import binxml, evtx
from logloom.operators.integrity import findings
from logloom.plans.log_queries import _images
from logloom.session import BATCH, mapped, work_folder
from logloom.sinks.writers import write_files
from logloom.sources import logs as L
from logloom.sources import ranges as R

TICKS = 132_700_000_000_000_000


def event(i, at):
    field = binxml.Element("Data", {"Name": "N"}, [str(i)])
    system = binxml.Element("System", {}, [binxml.Element("Provider", {"Name": "P"}), binxml.Element("EventID", {}, [str(4000 + i % 7)])])
    return binxml.encode(binxml.Element("Event", {}, [system, binxml.Element("EventData", {}, [field])]), at)


def log(first, n, a_chunk=50):
    """n events in chunks of a_chunk."""
    out = []
    for start in range(first, first + n, a_chunk):
        raw, used = [], 0
        for i in range(start, min(start + a_chunk, first + n)):
            raw.append(evtx.record_bytes(i, TICKS + i, event(i, evtx.RECORDS_AT + used + 24)))
            used += len(raw[-1])
        out.append(evtx.chunk_bytes(raw, start))
    return evtx.file_header(len(out), first + n) + b"".join(out)


def stored(tmp_path, **contents):
    for name, b in contents.items():
        (tmp_path / name.replace("__", ".")).write_bytes(b)
    return f"file://{tmp_path}"


def test_one_log_is_many_tasks(spark, tmp_path):
    folder = stored(tmp_path, a__evtx=log(1, 900), b__EVTX=log(5000, 20), c__evtx=b"no log", d__txt=log(1, 5))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.evtx").write_bytes(evtx.file_header(0, 1))
    found = R.log_ranges(spark, folder, chunksPerTask="4")
    assert found.rdd.getNumPartitions() == 6  # 18 chunks of a, one of b, one range each of c and e
    rows = found.collect()
    assert sorted(r["record_id"] for r in rows) == [*range(1, 901), *range(5000, 5020)]
    whole = L.decoded(L.chunks(L.files(spark, folder).filter("length > 100")))
    plain = lambda df: sorted((r["source"].rsplit("/", 1)[1], r["record_id"], r["seq"], r["event_id"], r["data"]["N"]) for r in df.collect())
    assert plain(found) == plain(whole)
    assert sorted(r["record_id"] for r in L.read_logs(spark, f"{tmp_path}/b.EVTX").collect()) == list(range(5000, 5020))
    with pytest.raises(Exception, match="not an event log"):
        R.log_ranges(spark, folder, mode="FAILFAST").count()
    with pytest.raises(Exception, match="nowhere"):
        R.log_ranges(spark, f"{folder}/nowhere").count()


def test_columns_chunks_and_pushdown(spark, tmp_path):
    folder = stored(tmp_path, a__evtx=log(1, 400))
    spark.dataSource.register(R.LogSource)
    few = spark.read.format("evtx").schema("event_id int, record_id long").load(folder)
    assert few.columns == ["event_id", "record_id"] and few.filter("event_id = 4003").count() == sum(i % 7 == 3 for i in range(1, 401))
    chunks = R.log_ranges(spark, folder, rows="chunks")
    assert L.records(chunks).count() == 400 and sorted(r["chunk_offset"] for r in chunks.select("chunk_offset").collect()) == [4096 + i * 65536 for i in range(8)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = R.log_ranges(spark, folder).filter("record_id >= 120 and record_id < 130")
        assert sorted(r["record_id"] for r in got.collect()) == list(range(120, 130))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = R.FilteredLogReader(L.SILVER, {"path": folder})
    kept = list(reader.pushFilters([R.GreaterThanOrEqual(("record_id",), 120), R.LessThan(("record_id",), 130), R.EqualTo(("event_id",), 4001)]))
    assert len(kept) == 3
    assert [r["record_id"] for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()] == list(range(101, 151))


def test_small_logs_share_tasks(tmp_path):
    folder = stored(tmp_path, **{f"x{i}__evtx": log(1, 3) for i in range(10)})
    assert [len(p.ranges) for p in R.LogReader(L.SILVER, {"path": folder, "chunkspertask": "4"}).partitions()] == [4, 4, 2]


def test_a_schema_of_plain_columns_makes_only_those(spark, tmp_path):
    """Without the columns that are decoded, records that can't be are left out all the same, or stop the query."""
    broken = bytearray(log(1, 50))
    broken[4096 + 512 + 24] = 0xAA
    folder = stored(tmp_path, a__evtx=log(1, 120), b__evtx=bytes(broken))
    every = R.log_ranges(spark, folder).select("source", "record_id", "ts").collect()
    some = R.log_ranges(spark, folder, columns="source string, record_id long, ts timestamp_ntz")
    assert some.columns == ["source", "record_id", "ts"] and sorted(some.collect()) == sorted(every) and len(every) == 169
    row = next(L.events_of("a", 4096, log(1, 3)[4096:], "PERMISSIVE", plain=True))
    assert set(row) == L.PLAIN
    with pytest.raises(Exception, match="BadXml"):
        R.log_ranges(spark, folder, columns="record_id long", mode="FAILFAST").count()


def test_tasks_are_bounded(tmp_path, monkeypatch):
    folder = stored(tmp_path, **{f"x{i}__evtx": log(1, 120) for i in range(20)})  # three chunks each
    monkeypatch.setattr(R, "MOST_TASKS", 7)
    parts = R.LogReader(L.SILVER, {"path": folder, "chunkspertask": "4"}).partitions()
    assert len(parts) == 7 and sum(end - first for p in parts for _, first, end in p.ranges) == 60
    assert len({(path, i) for p in parts for path, first, end in p.ranges for i in range(first, end)}) == 60


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 90)), max_size=40), st.integers(5, 120))
def test_jumps_compose_to_the_sequential_search(raw, stride):
    hits = sorted({p: (p, p + n) for p, n in raw}.values())
    want = list(R.chain(hits, 0))
    entry, got = 0, []
    for i in range(500 // stride + 1):
        here = [(p - i * stride, f - i * stride) for p, f in hits if i * stride <= p < (i + 1) * stride]
        got += [i * stride + p for p in R.chain(here, entry)]
        starts, exits = R.jumps(here, stride, 90)
        # The step as the sweep's SQL takes it.
        below = sum(s < entry for s in starts)
        entry = entry - stride if entry >= stride else exits[below] if below < len(exits) else 0
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(1, 90)), max_size=60), st.integers(5, 120), st.integers(1, 6))
def test_functions_of_blocks_lead_to_the_same_entries(raw, stride, block):
    hits = sorted({p: (p, p + n) for p, n in raw}.values())
    here = [[(p - i * stride, f - i * stride) for p, f in hits if i * stride <= p < (i + 1) * stride] for i in range(1000 // stride + 1)]
    functions = [R.jumps(h, stride, 90) for h in here]
    blocks = [functions[i : i + block] for i in range(0, len(functions), block)]
    firsts = R.walked([R.composed(f, stride, 90) for f in blocks], block * stride, 0)
    entries = [e for f, first in zip(blocks, firsts, strict=True) for e in R.walked(f, stride, first)]
    assert [i * stride + p for i, h in enumerate(here) for p in R.chain(h, entries[i])] == list(R.chain(hits, 0))


def test_entries_over_several_blocks(spark):
    # Every stride sends the search three bytes further into the next one, up to ten.
    n = 2 * R.BLOCK + 5
    functions = spark.range(n).selectExpr("'s' AS source", "id AS i", "array(0L, 3L, 6L, 9L) AS starts", "array(3L, 6L, 9L, 10L) AS exits").repartition(7)
    got = {r["i"]: r["entry"] for r in R.entered(functions, 10, 10, "source").collect()}
    want, entry = {}, 0
    for i in range(n):
        want[i] = entry
        entry = entry - 10 if entry >= 10 else {0: 3, 3: 6, 6: 9, 9: 10}[entry]
    assert got == want


def test_batches_end_at_bytes(spark):
    rows = spark.range(600).repartition(1).selectExpr("id", "unhex(repeat('ab', 65536)) AS content")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    found = [r["n"] for r in mapped(rows, sizes, "n long").collect()]
    assert len(found) > 2 and max(found) < BATCH + (1 << 18)


def test_batches_of_chunks_are_some_megabytes(spark):
    rows = spark.range(200).repartition(1).selectExpr("unhex(repeat('ab', 65536)) AS content")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    assert max(r["n"] for r in mapped(rows, sizes, "n long").collect()) < 5_000_000


def test_images_are_written_by_logs(spark, tmp_path):
    logs = spark.createDataFrame([(f"0x{i}", bytearray([i] * (i + 1))) for i in range(12)], "source string, content binary")
    folder = _images(logs.select(F.create_map(F.lit("TargetLogonId"), "source").alias("data")), logs, "images")
    got = {p.rsplit("/", 1)[1]: R.opened(p)[0].open_input_file(R.opened(p)[1]).read() for p, _ in R.listed([folder])}
    # In the order of the names, as text: 0x1, 0x11, 0x6.
    assert got["image1"] == bytes(64) + bytes([1] * 2) + bytes([11] * 12) + bytes([6] * 7) and sorted(got) == [f"image{i}" for i in range(5)]


def test_chunk_sweep_is_sequential(spark, tmp_path):
    r, images = random.Random(3), {}
    for k in range(3):
        b = bytearray(r.randbytes(8 * r.randint(0, 9)))
        for _ in range(6):
            chunk = bytearray(log(1, 20)[4096:])
            for _ in range(r.randint(0, 3)):  # magics inside
                at = 8 * r.randint(1500, 8191)
                chunk[at : at + 8] = evtx.CHUNK_MAGIC
            b += chunk + r.randbytes(r.randint(0, 40))
        b += evtx.CHUNK_MAGIC * 5  # cut off at the end
        images[f"image{k}"] = bytes(b)
    images["empty"] = b""
    folder = stored(tmp_path, **images)
    want = sorted((name, at, b[at : at + evtx.CHUNK]) for name, b in images.items() for at in evtx.find_chunks(b))
    for stride in (1 << 12, 24 * 1000, 1 << 26):
        got = sorted((x["source"].rsplit("/", 1)[1], x["chunk_offset"], bytes(x["content"])) for x in R.sweep_chunks(spark, folder, stride=stride).collect())
        assert got == want
    with pytest.raises(ValueError, match="multiple"):
        R.sweep_chunks(spark, folder, stride=1001)


def test_record_sweep_is_sequential(spark, tmp_path):
    r, images = random.Random(4), {}
    for k in range(3):
        b = b""
        for i in range(60):
            inner = evtx.record_bytes(1000 + i, i, r.randbytes(r.randint(0, 50)))
            b += r.randbytes(r.randint(0, 9)) + evtx.record_bytes(i, i, r.choice([b"\x0f\x01", b"z"]) + r.randbytes(r.randint(0, 300)) + inner)
        images[f"m{k}"] = b + evtx.RECORD_MAGIC + b"\x20\x00\x00\x00tail"
    folder = stored(tmp_path, **images)
    want = sorted((name, x.offset, x.size, x.record_id, x.filetime, x.how) for name, b in images.items() for x in evtx.scan_memory(b))
    for stride in (50, 777, 1 << 26):
        got = sorted((x[0].rsplit("/", 1)[1], *x[1:]) for x in map(tuple, R.sweep_records(spark, folder, stride=stride).collect()))
        assert got == want


def test_small_strides_are_searched_together(spark, tmp_path, monkeypatch):
    """A record in records in zeros, whatever is searched at once; images are read twice, and a stride is no row of its own."""
    inner = evtx.record_bytes(7, 7, b"\x0f\x01" + bytes(90))
    image = b"".join(evtx.record_bytes(i, i, b"\x0f\x01" + bytes(i % 300) + inner) + bytes(i % 50) for i in range(700)) + evtx.RECORD_MAGIC + b"\x1c"
    folder = stored(tmp_path, image=image)
    want = [(x.offset, x.record_id) for x in evtx.scan_memory(image)]
    assert len(want) == 700 and R.searched(1000) == 1_048_000 and R.searched(1 << 26) == 1 << 26 and R.searched(24) % 24 == 0
    for together, rows in ((1 << 20, 1), (3000, -(-len(image) // 3000)), (1, len(image) // 1000 + 1)):
        monkeypatch.setattr(R, "SEARCHED", together)
        found = R.sweep_records(spark, folder, stride=1000)
        assert sorted((x["record_offset"], x["record_id"]) for x in found.collect()) == want
        assert R.entries(spark, [folder], R.searched(1000), R.RECORD_SCAN).count() == rows
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in plan


def test_carvers_in_one_sweep(spark, tmp_path):
    bare = evtx.chunk_bytes([evtx.record_bytes(1, 1, b"x")], 1)
    bad = bytearray(log(1, 3)[4096:])
    bad[0x30] ^= 1
    empty = bytearray(bare)
    empty[512:516] = b"none"
    image = b"z" * 13 + log(1, 3)[4096:] + bytes(bad) + bytes(empty) + b"PNG!" + b"y" * 100 + b"PNG?"
    folder = stored(tmp_path, image=image)
    png = R.Carver("png", (b"PNG!", b"PNG?"), 40, lambda w: [("picture", 0.5)] if len(w) == 40 else [])
    for stride in (1 << 26, 1000):
        got = sorted((x["format"], x["offset"], x["kind"], x["confidence"], x["method"]) for x in R.carve(spark, folder, carvers=(R.EVTX_CHUNK, png), stride=stride).collect())
        assert got == [("evtx-chunk", 13, "records", 0.95, "unallocated"), ("evtx-chunk", 13 + 2 * 65536, "records", 0.8, "unallocated"), ("png", 13 + 3 * 65536, "picture", 0.5, "unallocated")]


def test_files_are_written_whole(spark, tmp_path):
    folder = work_folder(spark, "files")
    rows = spark.createDataFrame([("a", bytearray(b"one")), ("b/c", bytearray(b"")), ("d" * 300, None)], "source string, content binary")
    got = {r["path"].rsplit("/", 1)[1][:4]: r["length"] for r in write_files(rows, folder, ".bin").collect()}
    assert got == {"a.bi": 3, "b_c-": 0, "dddd": 0}
    assert len(R.listed([folder])) == 3 and sorted(n for _, n in R.listed([folder])) == [0, 0, 3]


def test_facts_by_ranges_are_those_of_whole_files(spark, tmp_path):
    damaged = bytearray(log(1, 400))
    damaged[4096 + 0x78] ^= 1
    damaged[0x7C] ^= 1
    folder = stored(tmp_path, a__evtx=bytes(damaged) + b"trailing" + b"\0" * 100, b__evtx=log(7, 60), c__evtx=b"short")
    by_range = findings(R.log_ranges(spark, folder, rows="facts", chunksPerTask="3"))
    whole = findings(L.facts(L.files(spark, folder)))
    plain = lambda df: sorted((r["source"].rsplit("/", 1)[1], *map(str, r[1:])) for r in df.collect())
    assert plain(by_range) == plain(whole) and {"TRAILING_DATA", "CHUNK_CHECKSUM_MISMATCH", "TRUNCATED_FILE"} <= {x[1] for x in plain(whole)}
    (tmp_path / "d.evtx").write_bytes(b"")
    assert [x["code"] for x in findings(R.log_ranges(spark, f"{folder}/d.evtx", rows="facts")).collect()] == ["TRUNCATED_FILE"]
