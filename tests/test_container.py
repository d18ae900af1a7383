import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.container import binxml, evtx
from logloom.operators import analytics as A
from logloom.operators import integrity as I
from logloom.sinks import writers
from logloom.sinks.writers import logs_of, repaired
from logloom.sources import logs as L

TICKS = 132_700_000_000_000_000


def log(n, payload=b"\x0f\x01\x02", guid=b"\x01" * 16):
    return evtx.write_log(((i, TICKS + i * 1_000_000, payload) for i in range(1, n + 1)), guid)


def frame(spark, *contents):
    return spark.createDataFrame([(f"log{i}", bytearray(c)) for i, c in enumerate(contents)], "source string, content binary")


def codes(spark, content, mode="full", least=None):
    logs = frame(spark, content)
    found = L.chunks(logs)
    return sorted(r["code"] for r in I.verify(logs, found, L.records(found), mode, least).collect())


def test_headers_round_trip():
    b = log(2100)
    head = evtx.FileHeader.parse(b)
    assert (head.next_record_id, head.chunk_count, head.major, head.minor, head.checksum) == (2101, 2, 3, 1, head.computed)
    chunk = evtx.ChunkHeader.parse(b[4096:])
    assert chunk.first_number == 1 and chunk.last_id == chunk.last_number and chunk.checksum == chunk.computed and chunk.records_ok(b[4096 : 4096 + 65536])
    assert evtx.FileHeader.parse(b"ElfFile\x00") is None and evtx.ChunkHeader.parse(b"x" * 200) is None


def test_walks():
    chunk = log(50)[4096:]
    assert [r.record_id for r in evtx.walk(chunk)] == list(range(1, 51))
    bad = bytearray(chunk)
    bad[0x78:0x7C] = b"\xef\xbe\xad\xde"
    _, state, found = evtx.records_of(bytes(bad))
    assert state == "header_corrupt" and found == []  # three bytes are no plausible payload
    good = bytearray(log(5, b"\x0f\x01\x01\x00abcdefgh")[4096:])
    good[0x78:0x7C] = b"\x00" * 4
    assert [r.record_id for r in evtx.records_of(bytes(good))[2]] == [1, 2, 3, 4, 5]
    first = next(evtx.walk(chunk))
    bad = bytearray(chunk)
    struct.pack_into("<I", bad, first.offset + first.size - 4, 7)
    assert next(evtx.walk(bytes(bad))).how == "size_mismatch"


def test_free_space():
    chunk = bytearray(log(3, b"\x0f\x01\x01\x00abcd")[4096:])
    last = list(evtx.walk(bytes(chunk)))[-1]
    struct.pack_into("<I", chunk, 0x30, last.offset)
    struct.pack_into("<I", chunk, 0x78, __import__("zlib").crc32(bytes(chunk[:0x78])))
    found = evtx.records_of(bytes(chunk), free=True)[2]
    assert [(r.record_id, r.how) for r in found] == [(1, "live"), (2, "live"), (3, "free")]


def test_carving_and_memory(spark):
    blob = b"\x00" * 24 + log(10)[4096:] + b"junk" * 10 + b"\x00" * 8
    assert list(evtx.find_chunks(blob)) == [24]
    assert L.records(L.chunks(frame(spark, blob), carve=True)).count() == 10
    image = b"z" * 13 + evtx.record_bytes(7, 1, b"\x0f\x01") + b"z" * 5 + evtx.record_bytes(8, 1, b"zz")
    assert [(r.record_id, r.how) for r in evtx.scan_memory(image)] == [(7, "memory"), (8, "memory_unsure")]
    many = b"".join(b"z" * (i % 7) + evtx.record_bytes(i, i, bytes(i % 50)) for i in range(1, 200))
    assert L.memory_records(frame(spark, many)).count() == 199


def test_repair(spark):
    b = bytearray(log(10))
    b[0x25] ^= 1
    b[4096 + 0x78] ^= 0xFF
    r = repaired(frame(spark, bytes(b))).first()
    assert (r["chunks_checked"], r["chunks_repaired"], r["header_repaired"]) == (1, 1, True)
    assert codes(spark, bytes(r["content"])) == []
    assert evtx.repair(bytes(r["content"]))[1:] == (1, 0, False)


def test_clean_log_has_no_anomaly(spark):
    assert codes(spark, log(3000)) == []


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        (lambda b: b.__setitem__(0x7C, b[0x7C] ^ 1), ["FILE_HEADER_CHECKSUM_MISMATCH"]),
        (lambda b: b.__setitem__(4096 + 0x78, b[4096 + 0x78] ^ 1), ["CHUNK_CHECKSUM_MISMATCH"]),
        (lambda b: b.__setitem__(4096 + 520, b[4096 + 520] ^ 0x80), ["RECORD_CHECKSUM_MISMATCH"]),
        (lambda b: b.__delitem__(slice(100, None)), ["TRUNCATED_FILE"]),
    ],
)
def test_damage(spark, change, expected):
    b = bytearray(log(20))
    change(b)
    assert [c for c in codes(spark, bytes(b)) if c not in ("PHANTOM_RECORD_INJECTION", "TIMESTAMP_ANOMALY")] == expected


def test_deleted_records(spark):
    chunk = bytearray(log(5, b"\x0f\x01\x01\x00" + b"a" * 20)[4096:])
    r = list(evtx.walk(bytes(chunk)))
    struct.pack_into("<I", chunk, r[1].offset + 4, r[1].size + r[2].size)
    struct.pack_into("<I", chunk, r[2].offset + r[2].size - 4, r[1].size + r[2].size)
    b = evtx.repair(log(5)[:4096] + bytes(chunk))[0]
    found = L.records(L.chunks(frame(spark, b))).filter("nested_at is not null").collect()
    assert [(x["record_id"], x["nested_at"]) for x in found] == [(2, r[2].offset)]
    assert "SURGICAL_RECORD_DELETION" in codes(spark, b) and codes(spark, b, least="Critical") == ["SURGICAL_RECORD_DELETION"]


def test_clocks_and_phantoms(spark):
    ticks = {1: TICKS, 2: TICKS + 10_000_000, 3: TICKS + 5_000_000, 9: TICKS + 5_000_001, 10: 0}
    b = evtx.write_log((i, t, b"\x0f\x01\x02") for i, t in ticks.items())
    assert codes(spark, b) == ["EXPORT_TIMESTAMP_CORRUPTION", "PHANTOM_RECORD_INJECTION", "TIMESTAMP_ANOMALY"]
    assert codes(spark, b, "carve") == ["EXPORT_TIMESTAMP_CORRUPTION"]


def test_chunk_order(spark):
    b = log(7000)
    assert evtx.FileHeader.parse(b).chunk_count == 4
    cut = b[: 4096 + 65536] + b[4096 + 2 * 65536 :]
    assert codes(spark, cut) == ["CHUNK_COUNT_MISMATCH", "PHANTOM_RECORD_INJECTION", "RECORD_ID_GAP"] or codes(spark, cut) == ["CHUNK_COUNT_MISMATCH", "RECORD_ID_GAP"]


def test_trailing_and_overlapping(spark):
    b = log(3000)
    end = len(b)
    row = lambda x, code: next(((r["expected"], r["found"], r["chunk_offset"]) for r in x.collect() if r["code"] == code), None)
    assert row(I.verify(frame(spark, b + b"\0" * 7 + b"junk")), "TRAILING_DATA") == (str(end), "11", None)
    assert codes(spark, b + b"\0" * 5000) == ["CHUNK_COUNT_MISMATCH"] or codes(spark, b + b"\0" * 5000) == []
    logs = frame(spark, b)
    found = L.chunks(logs)
    moved = found.filter("chunk_offset = 4096").selectExpr("source", "chunk_offset + 100 as chunk_offset", "content")
    rows = [r for r in I.verify(logs, found.unionByName(moved)).collect() if r["code"] == "OVERLAPPING_CHUNKS"]
    # The one that was moved begins in the first; the next begins in it.
    assert sorted((r["chunk_offset"], r["expected"]) for r in rows) == [(4196, "69632"), (69632, "69732")]


def test_verification_is_one_pass(spark):
    plan = I.verify(frame(spark, log(10)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    b = bytearray(log(3000))
    b[4096 + 0x78] ^= 1
    b[4096 + 65536 + 96] ^= 1
    logs = frame(spark, bytes(b), b"", b"short")
    found = L.chunks(logs)
    whole, parts, given = (sorted(map(repr, x.collect())) for x in (I.verify(logs), I.verify(logs, found), I.verify(logs, found, L.records(found))))
    assert whole == parts == given and len(whole) >= 5
    with pytest.raises(ValueError, match="severity"):
        I.verify(logs, least="Low")


def event(data, event_id="4624"):
    text = lambda n, x: binxml.Element(n, {}, [x])
    system = binxml.Element("System", {}, [binxml.Element("Provider", {"Name": "P", "Guid": "{G}"}), text("EventID", event_id), text("Level", "4"), text("Channel", "Security"), text("Computer", "pc"), binxml.Element("Execution", {"ProcessID": "12", "ThreadID": "13"})])
    return binxml.Element("Event", {}, [system, binxml.Element("EventData", {}, data)])


def test_decoding(spark):
    named = [binxml.Element("Data", {"Name": "TargetUserName"}, ["Jürgen"]), binxml.Element("Data", {}, ["first"]), binxml.Element("Data", {}, ["second"]), binxml.Element("Nested", {}, [binxml.Element("Leaf", {}, ["deep"])])]
    payload = binxml.encode(event(named), evtx.RECORDS_AT + 24)
    b = evtx.write_log([(9, TICKS, payload)])
    r = L.decoded(L.chunks(frame(spark, b)), "FAILFAST").first()
    assert (r["record_id"], r["event_id"], r["level"], r["channel"], r["computer"], r["provider"], r["process_id"], r["thread_id"]) == (9, 4624, 4, "Security", "pc", "P", 12, 13)
    assert r["data"] == {"TargetUserName": "Jürgen", "Data0": "first", "Data1": "second", "Leaf": "deep"}


def test_leaves(spark):
    named = [binxml.Element("Data", {"Name": "TargetUserName"}, ["J\u00fcrgen"]), binxml.Element("Data", {}, ["first"]), binxml.Element("Nested", {"Kind": "Odd"}, [binxml.Element("Leaf", {}, ["Deep (1)"])])]
    b = evtx.write_log([(9, TICKS, binxml.encode(event(named), evtx.RECORDS_AT + 24))])
    evt = L.decoded(L.chunks(frame(spark, b)), leaves=True)
    got = {(x["name"], x["path"], x["value"]) for x in evt.first()["leaves"]}
    assert {("Leaf", "Event.EventData.Nested.Leaf", "Deep (1)"), ("@Kind", "Event.EventData.Nested.@Kind", "Odd"), ("Data", "Event.EventData.Data", "first"), ("@Name", "Event.System.Provider.@Name", "P")} <= got
    for query, n in (("deep (1)", 1), ("ODD", 1), ("J\u00dcRGEN", 0), ("rgen", 1), ("", 1), ("\\E", 0), ("none", 0)):
        assert A.search_events(evt, query).count() == n, query
    assert A.search_events(evt, r"^Deep \(\d\)$", regex=True).count() == 1
    assert [tuple(r) for r in A.field_values(evt, "Leaf").collect()] == [("Deep (1)", 1)] and A.field_values(evt, "Event.System.Computer").first()["value"] == "pc"
    json = spark.createDataFrame([('{"a": [{"b": "x"}, {"b": ["y", 1, null, "x"]}], "c": {"b": "z"}}',), ("no json",), (None,)], "json string")
    assert sorted(tuple(r) for r in A.field_values(L.with_leaves(json), "b").collect()) == [("x", 2), ("y", 1), ("z", 1)]
    assert A.field_values(L.with_leaves(json), "c.b").count() == 1


def test_quoted_queries(spark):
    rows = spark.createDataFrame([("a\\Eb.C",), ("A\nb",), (None,)], "t string")
    assert [A.search_text(rows, ["t"], q).count() for q in ("\\eB.c", "b.c", "a\nB", "bxc", "")] == [1, 1, 1, 0, 2]


def test_templates():
    names, chunk = {}, bytearray(65536)

    def name(text, at):
        struct.pack_into("<IHH", chunk, at, 0, 0, len(text))
        chunk[at + 8 : at + 8 + 2 * len(text) + 2] = text.encode("utf-16-le") + b"\x00\x00"
        names[text] = at
        return at + 8 + 2 * len(text) + 2

    at = 40000
    for n in ("Event", "EventData", "Data", "Name"):
        at = name(n, at)
    opened = lambda n, attributes=b"": bytes([0x41 if attributes else 0x01]) + struct.pack("<HII", 0xFFFF, 0, names[n]) + (struct.pack("<I", len(attributes)) + attributes if attributes else b"") + b"\x02"
    attribute = b"\x06" + struct.pack("<I", names["Name"]) + struct.pack("<BHB", 0x0D, 0, 0x01)
    body = b"\x0f\x01\x01\x00" + opened("Event") + opened("EventData") + opened("Data", attribute) + struct.pack("<BHB", 0x0E, 1, 0x08) + b"\x04" + opened("Data") + struct.pack("<BHB", 0x0E, 2, 0x01) + b"\x04\x04\x04\x00"
    place = 600 + 4 + 10
    values = [(0x01, "Pid".encode("utf-16-le")), (0x08, struct.pack("<I", 4242)), (0x00, b"")]
    raw = b"\x0f\x01\x01\x00" + b"\x0c\x01" + struct.pack("<II", 1, place) + struct.pack("<I", 0) + b"\x00" * 16 + struct.pack("<I", len(body)) + body
    raw += struct.pack("<I", 3) + b"".join(struct.pack("<HBB", len(v), k, 0) for k, v in values) + b"".join(v for _, v in values) + b"\x00"
    chunk[600 : 600 + len(raw)] = raw
    decoded = binxml.ChunkDecoder(bytes(chunk)).decode(600, 600 + len(raw))
    assert binxml.flattened(decoded) == {"Pid": "4242", "Data0": ""}


@pytest.mark.parametrize(
    ("kind", "raw", "text"),
    [
        (0x03, b"\xff", "-1"),
        (0x0A, b"\xff" * 8, str(2**64 - 1)),
        (0x0D, b"\x01\x00\x00\x00", "true"),
        (0x0E, b"\xab\xcd", "abcd"),
        (0x0F, bytes(range(16)), "03020100-0504-0706-0809-0a0b0c0d0e0f"),
        (0x10, b"\x01\x00\x00\x00", "0x00000001"),
        (0x11, struct.pack("<Q", 132_700_000_000_000_000), "2021-07-05T23:06:40.000000Z"),
        (0x12, struct.pack("<8H", 2024, 2, 4, 29, 12, 30, 15, 7), "2024-02-29T12:30:15.007Z"),
        (0x13, b"\x01\x02" + b"\x00" * 5 + b"\x05" + struct.pack("<II", 32, 544), "S-1-5-32-544"),
        (0x15, struct.pack("<Q", 0x3E7), "0x00000000000003e7"),
    ],
)
def test_values(kind, raw, text):
    assert binxml.value_text(kind, raw) == text


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300))
def test_decoder_survives_anything(raw):
    chunk = raw.ljust(2048, b"\x00")
    try:
        binxml.ChunkDecoder(chunk).decode(0, len(raw))
    except binxml.BadXml:
        pass
    list(evtx.walk(raw)), list(evtx.walk_hard(raw)), list(evtx.scan_memory(raw)), list(evtx.find_chunks(raw)), evtx.repair(raw)


def test_damaged_payloads_are_left_out(spark):
    r = random.Random(3)
    b = evtx.write_log((i, TICKS, bytes(r.randrange(256) for _ in range(60))) for i in range(1, 30))
    assert L.decoded(L.chunks(frame(spark, b))).count() <= 29


def test_mbr():
    mbr = bytearray(512)
    mbr[510:] = b"\x55\xaa"
    mbr[446 + 16 + 4] = 0x07
    struct.pack_into("<I", mbr, 446 + 16 + 8, 1026048)
    assert evtx.ntfs_partition(bytes(mbr)) == 1026048 and evtx.ntfs_partition(b"\x00" * 512) is None


def test_parallel_writer_is_byte_equal(spark, monkeypatch):

    r = random.Random(7)
    for packed, counted in ((1 << 20, 1 << 12), (70_000, 5), (65_100, 100)):
        monkeypatch.setattr(writers, "PACKED", packed)
        monkeypatch.setattr(writers, "COUNTED", counted)
        logs = {s: [(i * step, TICKS + i, r.randbytes(r.choice([0, 5, 300, 3000, 30_000, 64_990]))) for i in range(n)] for s, n, step in (("one", 1, 1), ("many", 150, 3), ("hot", 400, 1))}
        logs["exact"] = [(i, 1, b"x" * (65024 // 4 - 28)) for i in range(9)]
        rows = [(s, i, t, bytearray(p)) for s, of in logs.items() for i, t, p in of]
        r.shuffle(rows)
        frame_of = spark.createDataFrame(rows, "source string, record_id long, filetime long, payload binary")
        got = {s: b"" for s in logs}
        for x in sorted(writers.log_parts(frame_of).collect(), key=lambda x: x["part"]):
            got[x["source"]] += bytes(x["content"])
        assert got == {s: evtx.write_log(of) for s, of in logs.items()}
        assert {x["source"]: bytes(x["content"]) for x in logs_of(frame_of).collect()} == got
    assert (len(got["hot"]) - 4096) // 65536 > 10
    with pytest.raises(Exception, match="doesn't fit"):
        writers.log_parts(spark.createDataFrame([("a", 1, 1, bytearray(65_000))], "source string, record_id long, filetime long, payload binary")).collect()


def test_writer_frame(spark):
    rows = spark.createDataFrame([("a", i, TICKS, bytearray(b"\x0f\x01")) for i in range(10)] + [("b", 5, TICKS, bytearray(b"x"))], "source string, record_id long, filetime long, payload binary")
    out = L.records(L.chunks(logs_of(rows))).groupBy("source").agg(F.count("*").alias("n"))
    assert {r["source"]: r["n"] for r in out.collect()} == {"a": 10, "b": 1}


def test_logs_are_built_from_sorted_batches(spark):
    """Sources over several batches, ids in no order, a source that is null: what evtx.write_log makes of each, without a group in pandas."""
    records = [(s, (i * 7919) % 3000, TICKS + i, bytes([i % 251]) * (i % 900)) for s in ("a", "b", None) for i in range(3000)] + [("c", 1, 1, b"")]
    rows = spark.createDataFrame(records, "source string, record_id long, filetime long, payload binary").repartition(5)
    found = logs_of(rows)
    assert steps(found, "FlatMapGroupsInPandas") == 0 and steps(found, "MapInArrow") == 1
    got = {r["source"]: bytes(r["content"]) for r in found.collect()}
    assert got == {s: evtx.write_log(sorted(r[1:] for r in records if r[0] == s)) for s in ("a", "b", "c", None)}


def test_repair_by_parts(spark, tmp_path):
    """Logs repaired by ranges are those repaired whole, byte for byte, and files written by parts are the parts."""
    (tmp_path / "in").mkdir()
    whole = log(5000)
    assert len(whole) > 4096 + 2 * 65536
    for name, changes, cut in (("sound", (), 0), ("head", (0x25, 0x7C), 0), ("chunks", (4096 + 0x78, 4096 + 65536 + 0x34), 0), ("size", (4096 + 0x32,), 0), ("magic", (4096,), 0), ("short", (4096 + 0x78,), 70)):
        b = bytearray(whole)
        for at in changes:
            b[at] ^= 0xFF
        (tmp_path / "in" / f"{name}.evtx").write_bytes(bytes(b[: len(b) - cut]))
    (tmp_path / "in" / "none.evtx").write_bytes(b"no log at all" * 1000)
    (tmp_path / "in" / "empty.evtx").write_bytes(b"")
    parts = writers.repaired_parts(spark, f"file://{tmp_path}/in", chunksPerTask="1")
    assert "MapInArrow" not in parts._jdf.queryExecution().toString() and "Exchange" not in parts._jdf.queryExecution().toString()
    named = parts.withColumn("source", F.regexp_extract("source", "[^/]*$", 0))
    done = {r["path"].rsplit("/", 1)[-1]: r["length"] for r in writers.write_parts(named, f"file://{tmp_path}/out", order="chunk_offset").collect()}
    counts = {r["source"]: r["n"] for r in named.groupBy("source").agg(F.count_if("mended").alias("n")).collect()}
    for name in ("sound", "head", "chunks", "size", "magic", "short"):
        raw = (tmp_path / "in" / f"{name}.evtx").read_bytes()
        right, _, chunks, header = evtx.repair(raw)
        assert (tmp_path / "out" / f"{name}.evtx").read_bytes() == right and done[f"{name}.evtx"] == len(raw), name
        assert counts[f"{name}.evtx"] == chunks + header, name
    assert sorted(done) == sorted(f"{n}.evtx" for n in ("sound", "head", "chunks", "size", "magic", "short"))
    counted = writers.write_parts(named, f"file://{tmp_path}/again", order="chunk_offset", count="mended").collect()
    assert {r["path"].rsplit("/", 1)[-1]: (r["length"], r["mended"]) for r in counted} == {name: (done[name], counts[name]) for name in done}


def test_parts_become_one_file(spark, tmp_path):
    """Sources in no order, names that no file may have, empty parts, a source of one part, no rows."""
    rows = [("a", p, bytes([p]) * p) for p in (3, 0, 2, 1)] + [("b/c", 0, b"x"), ("n", 5, None)]
    parts = spark.createDataFrame(rows, "source string, part long, content binary").repartition(3)
    found = {r["path"].rsplit("/", 1)[-1]: r["length"] for r in writers.write_parts(parts, f"file://{tmp_path}/out").collect()}
    assert found["a"] == 6 and (tmp_path / "out" / "a").read_bytes() == b"\x01\x02\x02\x03\x03\x03"
    assert sorted(found.values()) == [0, 1, 6] and len(list((tmp_path / "out").iterdir())) == 3
    assert writers.write_parts(parts.limit(0), f"file://{tmp_path}/none").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=9), st.text(max_size=9), st.integers(0, 60000)), max_size=8))
def test_molds_encode_alike(rows):
    e = binxml.Element
    make = lambda a, b: e("Event", {}, [e("System", {"x": "fixed", "y": a}, ["same"]), e("Data", {}, [b])])
    mold, own, plain = binxml.Mold(make), {}, {}
    for a, b, at in rows:
        assert mold.encode((a, b), at) == binxml.encode(make(a, b), at)
        assert mold.encode_template((a, b), at, own) == binxml.encode_template(make(a, b), at, plain)


def steps(df, name):
    """How many steps of a kind the plan of df has."""
    return df._jdf.queryExecution().sparkPlan().toString().count(name)


def test_chunks_in_their_places_need_no_python(spark):
    whole = log(2100) + bytes(100)
    logs = frame(spark, whole, b"", whole[:4096], whole[:4097]).union(spark.createDataFrame([("none", None)], "source string, content binary"))
    logs = logs.withColumn("offset_base", F.lit(512)).withColumn("kept", F.col("source"))
    found = L.chunks(logs, keep=("kept",))
    assert steps(found, "MapInArrow") == 0 and steps(L.decoded(found), "MapInArrow") == 1
    got = sorted((r["source"], r["chunk_offset"], bytes(r["content"]), r["kept"]) for r in found.collect())
    assert got == [("log0", 512 + x, whole[x : x + 65536], "log0") for x in (4096, 69632, 135168)] + [("log3", 4608, b"E", "log3")]
    recs = L.records(found, keep=("kept",)).groupBy("source", "kept").agg(F.count("*").alias("n"), F.min("record_id").alias("first")).collect()
    assert [tuple(r) for r in recs] == [("log0", "log0", 2100, 1)]
    with pytest.raises(ValueError):
        L.chunks(logs, carve=True, keep=("kept",))
