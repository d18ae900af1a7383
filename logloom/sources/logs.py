"""Binary logs, blobs and memory images as DataFrames; decoding runs in Arrow batches, chunk by chunk."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.container import binxml, evtx
from logloom.functions.columns import number
from logloom.schema import SILVER, conform
from logloom.session import mapped

#: What a task hands on at once; keeps decoded rows of many chunks from piling up.
ROWS = 2000
CHUNKS = "source string, chunk_offset long, content binary"
CHUNK_SCHEMA = pa.schema([("source", pa.string()), ("chunk_offset", pa.int64()), ("content", pa.binary())])
MEMORY_RECORDS = "source string, record_offset long, size int, record_id long, filetime long, how string"
MEMORY_SCHEMA = pa.schema([("source", pa.string()), ("record_offset", pa.int64()), ("size", pa.int32()), ("record_id", pa.int64()), ("filetime", pa.int64()), ("how", pa.string())])
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "timestamp_ntz": pa.timestamp("us"), "map<string,string>": pa.map_(pa.string(), pa.string())}
SILVER_SCHEMA = pa.schema([(f.name, _KINDS[f.dataType.simpleString()]) for f in SILVER.fields])
RECORDS = "source string, chunk_offset long, state string, record_offset int, size int, record_id long, filetime long, how string, nested_at int, payload binary"


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """source, length, content and sha256 of logs: files, or all *.evtx below folders, each once however many of
    the paths lead to it. Paths below other paths are left out; where patterns may meet, the listing is compared. Contents
    aren't shuffled."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][vV][tT][xX]")
    own = _outermost(spark, *paths)
    found = reader.load(own)
    if len(own) > 1 and any(re.search(r"[*?\[{]", p) for p in own):
        once = sorted(set(found.inputFiles()))
        found = reader.load(once) if once else found.limit(0)
    return found.select(F.col("path").alias("source"), "length", "content", F.sha2("content", 256).alias("sha256"))


def _outermost(spark: SparkSession, *paths: str) -> list[str]:
    """The paths with their file system, without those that others of them are, or are above of."""
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    full = sorted({p.getFileSystem(conf).makeQualified(p).toString() for p in map(jvm.Path, paths)})
    return [p for p in full if not any(p.startswith(f"{other.rstrip('/')}/") for other in full if other != p)]


def is_ewf(content: Column) -> Column:
    """Whether bytes begin like an EWF image."""
    return F.substring(content, 1, 8) == F.unhex(F.lit("455646090D0AFF00"))


def batched(rows: Iterator[dict], schema: pa.Schema, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def chunks(logs: DataFrame, carve: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk: at its place in a log, or with carve wherever its magic stands in a blob. A column
    offset_base of logs, where a slice begins in a larger image, is added to the offsets. keep: columns of logs that chunks in
    their places get too. Those are cut out in the JVM: contents go to Python once, in what reads them."""
    base = F.coalesce(F.col("offset_base").cast("long"), F.lit(0)) if "offset_base" in logs.columns else F.lit(0).cast("long")
    if not carve:
        size = F.octet_length("content")
        places = F.when(size > evtx.HEADER_BLOCK, F.sequence(F.lit(evtx.HEADER_BLOCK), size - 1, F.lit(evtx.CHUNK)))
        each = logs.select("source", base.alias("_base"), "content", *keep, F.explode(places).alias("_at"))
        return each.select("source", (F.col("_base") + F.col("_at")).alias("chunk_offset"), F.substring("content", F.col("_at") + 1, F.lit(evtx.CHUNK)).alias("content"), *keep)
    if keep:
        raise ValueError("carved chunks keep no other columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, base, content in zip(batch.column("source").to_pylist(), batch.column("base").to_pylist(), batch.column("content"), strict=True):
                b = content.as_py() or b""
                for x in evtx.find_chunks(b):
                    yield pa.RecordBatch.from_pylist([{"source": source, "chunk_offset": base + x, "content": b[x : x + evtx.CHUNK]}], schema=CHUNK_SCHEMA)

    return mapped(logs.select("source", base.alias("base"), "content"), run, CHUNKS)


def records(found: DataFrame, free: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records of chunk rows, live or carved; nested_at: where another record begins inside one. keep: columns of
    the chunk rows that their records get too."""
    schema = pa.schema([("source", pa.string()), ("chunk_offset", pa.int64()), ("state", pa.string()), ("record_offset", pa.int32()), ("size", pa.int32()), ("record_id", pa.int64()), ("filetime", pa.int64()), ("how", pa.string()), ("nested_at", pa.int32()), ("payload", pa.binary())])

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for x in batch.to_pylist():
            _, state, got = evtx.records_of(x["content"], free)
            kept = {k: x[k] for k in keep}
            for r in got:
                yield {"source": x["source"], "chunk_offset": x["chunk_offset"], "state": state, "record_offset": r.offset, "size": r.size, "record_id": signed(r.record_id), "filetime": signed(r.filetime), "how": r.how, "nested_at": evtx.nested_record(x["content"], r), "payload": r.payload, **kept}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batched(rows(batch), pa.schema([*schema, *(batch.schema.field(k) for k in keep)]))

    return mapped(found.select("source", "chunk_offset", "content", *keep), run, T.StructType([*T.StructType.fromDDL(RECORDS), *(found.schema[k] for k in keep)]))


#: What verification needs of a log, by kind of row: 0 a file, 1 a chunk, 2 a record; found and records (whether a chunk has a
#: header, and how many it holds) are for counts. 3 is a chunk cut off within its header, which is counted, not verified.
FACTS = (
    "source string, kind int, length long, used_end long, next_id long, chunk_count long, flags long, checksum long, computed long, chunk_offset long, size long, whole boolean, first_number long, last_number long, last_id long, "
    "free_at long, records_sum long, records_computed long, guid string, head_sum long, head_computed long, record_offset int, record_id long, filetime long, nested_at int, found boolean, records long"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
FACT_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in FACTS.split(", "))])


def file_fact(source: str, head: bytes, length: int, used_end: int) -> dict:
    """The row of a file by its first 128 bytes (fewer, and nothing is said of them)."""
    out = {"source": source, "kind": 0, "length": length, "used_end": used_end}
    if len(head) >= 128:
        flags, checksum = struct.unpack_from("<II", head, 0x78)
        out |= {"next_id": signed(struct.unpack_from("<Q", head, 0x18)[0]), "chunk_count": struct.unpack_from("<H", head, 0x2A)[0], "flags": flags, "checksum": checksum, "computed": zlib.crc32(head[:0x78])}
    return out


def chunk_facts(source: str, chunk_offset: int, content: bytes) -> Iterator[dict]:
    """The rows of what stands at a chunk's place, and of its records."""
    at, (header, _, got) = {"source": source, "chunk_offset": chunk_offset}, evtx.records_of(content)
    counts = {"found": header is not None, "records": len(got)}
    if len(content) >= 128:
        first_number, last_number = struct.unpack_from("<QQ", content, 8)
        free_at, records_sum = struct.unpack_from("<II", content, 0x30)
        row = at | counts | {"kind": 1, "size": len(content), "whole": len(content) == evtx.CHUNK and content[:8] == evtx.CHUNK_MAGIC, "last_id": signed(struct.unpack_from("<Q", content, 0x20)[0])}
        row |= {"first_number": signed(first_number), "last_number": signed(last_number), "free_at": free_at, "records_sum": records_sum, "guid": content[96:112].hex().upper()}
        row |= {"head_sum": struct.unpack_from("<I", content, 0x78)[0], "head_computed": zlib.crc32(content[:0x78])}
        yield row | ({"records_computed": zlib.crc32(content[evtx.RECORDS_AT : free_at])} if evtx.RECORDS_AT <= free_at <= evtx.CHUNK else {})
    elif header is not None:
        yield at | counts | {"kind": 3}
    for r in got:
        yield at | {"kind": 2, "record_offset": r.offset, "record_id": signed(r.record_id), "filetime": signed(r.filetime), "nested_at": evtx.nested_record(content, r)}


def facts(logs: DataFrame, inside: bool = True) -> DataFrame:
    """The rows (FACTS) of logs (source, content) and, with inside, of their chunks and records, in one pass over the contents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for source, content in zip(batch.column("source").to_pylist(), batch.column("content"), strict=True):
                b = content.as_py() or b""
                yield file_fact(source, b[:128], len(b), len(b.rstrip(b"\0")))
                for x in range(evtx.HEADER_BLOCK, len(b) if inside else 0, evtx.CHUNK):
                    yield from chunk_facts(source, x, b[x : x + evtx.CHUNK])

    return mapped(logs.select("source", "content"), lambda b: batched(rows(b), FACT_SCHEMA), FACTS)


def facts_of_chunks(found: DataFrame) -> DataFrame:
    """The rows (FACTS) of chunk rows, wherever they come from, and of their records; there are none of files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for x in batch.to_pylist():
                yield from chunk_facts(x["source"], x["chunk_offset"], x["content"] or b"")

    return mapped(found.select("source", "chunk_offset", "content"), lambda b: batched(rows(b), FACT_SCHEMA), FACTS)


def carve_stats(found: DataFrame) -> DataFrame:
    """source, chunks_found, chunks_valid, chunks_corrupt, records_recovered, records_corrupt (those that were
    carved from a damaged chunk) of chunk rows. Cut-off chunks are found, but neither valid nor corrupt."""
    schema = pa.schema([("source", pa.string()), ("state", pa.string()), ("n", pa.int64()), ("carved", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for x in batch.to_pylist():
                header, state, got = evtx.records_of(x["content"])
                if header is not None:
                    yield {"source": x["source"], "state": state, "n": len(got), "carved": sum(r.how == "carved" for r in got)}

    each = mapped(found, lambda b: batched(rows(b), schema), "source string, state string, n long, carved long")
    return each.groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks_found"),
        F.count_if(F.col("state") == "valid").alias("chunks_valid"),
        F.count_if(F.col("state") == "header_corrupt").alias("chunks_corrupt"),
        F.sum("n").alias("records_recovered"),
        F.sum("carved").alias("records_corrupt"),
    )


def swept(images: DataFrame) -> DataFrame:
    """Chunk rows of images (source, content), each searched from its first byte on; for files of any size there is
    ranges.sweep_chunks()."""
    return chunks(images, carve=True)


def ntfs_partitions(images: DataFrame) -> DataFrame:
    """source, first_sector, offset_base, content: the first partition of a kind that NTFS uses of each disk image
    (source, content), by its boot record; images without one are left out. chunks() gives offsets in the image."""
    c = F.col("content")
    at = [446 + 16 * i for i in range(4)]
    first = F.coalesce(*[F.when(F.hex(F.substring(c, a + 5, 1)).isin("07", "17", "27"), number(c, a + 8, 4)) for a in at])
    found = images.filter((F.length(c) >= 512) & (F.hex(F.substring(c, 511, 2)) == "55AA")).select("source", first.alias("first_sector"), "content").filter("first_sector is not null")
    offset = F.col("first_sector") * 512
    return found.filter(offset < F.length(c)).select("source", "first_sector", offset.alias("offset_base"), c.substr((offset + 1).cast("int"), F.length(c)).alias("content"))


def problems(rows: DataFrame, column: str = "payload") -> DataFrame:
    """rows with problem and problem_at: what is wrong with the form of a binary XML payload, null if nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [binxml.problem(x or b"") for x in b.column(column).to_pylist()]
            arrays = [pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, "problem", "problem_at"])

    return mapped(rows, run, T.StructType([*rows.schema.fields, T.StructField("problem", T.StringType()), T.StructField("problem_at", T.IntegerType())]))


def json_records(found: DataFrame) -> DataFrame:
    """source, chunk_offset, record_id, json of the records of chunk rows: the whole record as JSON. Records that
    can't be decoded are left out."""
    schema = pa.schema([("source", pa.string()), ("chunk_offset", pa.int64()), ("record_id", pa.int64()), ("json", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for x in batch.to_pylist():
                decoder = binxml.ChunkDecoder(x["content"])
                for r in evtx.records_of(x["content"])[2]:
                    try:
                        event = decoder.decode(r.offset + 24, r.offset + r.size - 4)
                    except binxml.BadXml:
                        continue
                    text = json.dumps({event.name: binxml.projected(event)}, ensure_ascii=False, separators=(",", ":"))
                    yield {"source": x["source"], "chunk_offset": x["chunk_offset"], "record_id": signed(r.record_id), "json": text}

    return mapped(found, lambda b: batched(rows(b), schema), "source string, chunk_offset long, record_id long, json string")


def memory_records(images: DataFrame) -> DataFrame:
    """source, record_offset, size, record_id, filetime, how of records anywhere in memory images (source, content).
    Behind a record the search goes on after its end; for files of any size there is ranges.sweep_records()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for x in batch.to_pylist():
                for r in evtx.scan_memory(x["content"] or b""):
                    yield {"source": x["source"], "record_offset": r.offset, "size": r.size, "record_id": signed(r.record_id), "filetime": signed(r.filetime), "how": r.how}

    return mapped(images.select("source", "content"), lambda b: batched(rows(b), MEMORY_SCHEMA), MEMORY_RECORDS)


def _time(ticks: int) -> datetime | None:
    try:
        return datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)
    except OverflowError:
        return None


LEAVES = T.StructField("leaves", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "path", "value")])))
_LEAVES = pa.field("leaves", pa.list_(pa.struct([(n, pa.string()) for n in ("name", "path", "value")])))
SILVER_LEAVES, LEAVES_SCHEMA = T.StructType([*SILVER.fields, LEAVES]), SILVER_SCHEMA.append(_LEAVES)


def _leaves(tree: object) -> list[dict]:
    return [dict(zip(("name", "path", "value"), x, strict=True)) for x in binxml.leaves(tree)]


#: Columns of the silver table that a record's place and header give.
PLAIN = frozenset(("source", "record_id", "ts", "ts_ticks", "seq"))


def events_of(source: str, chunk_offset: int, content: bytes, mode: str, leaves: bool = False, plain: bool = False) -> Iterator[dict]:
    """The silver rows of a chunk; with leaves, also all strings of each record's JSON form; with plain, only the columns in
    PLAIN. Records are decoded in any case: those that can't be are left out, or with FAILFAST stop the query."""
    decoder = binxml.ChunkDecoder(content)
    for r in evtx.records_of(content)[2]:
        try:
            event = decoder.decode(r.offset + 24, r.offset + r.size - 4)
        except binxml.BadXml:
            if mode == "FAILFAST":
                raise
            continue
        ids = {"source": source, "record_id": signed(r.record_id), "ts": _time(r.filetime), "ts_ticks": signed(r.filetime), "seq": chunk_offset + r.offset}
        if plain:
            yield ids
            continue
        ids |= binxml.envelope(event) | {"data": list(binxml.flattened(event).items())}
        yield ids | {"leaves": _leaves({event.name: binxml.projected(event)})} if leaves else ids


def decoded(found: DataFrame, mode: str = "PERMISSIVE", leaves: bool = False) -> DataFrame:
    """The silver table of chunk rows. Records that can't be decoded are left out, or with FAILFAST stop the query.
    leaves: with a column of that name, (name, path, value) of every string of a record at any depth."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for x in batch.to_pylist():
                yield from events_of(x["source"], x["chunk_offset"], x["content"], mode, leaves)

    return mapped(found, lambda b: batched(rows(b), LEAVES_SCHEMA if leaves else SILVER_SCHEMA), SILVER_LEAVES if leaves else SILVER)


def with_leaves(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with leaves: (name, path, value) of every string of decoded records as JSON text; what is no JSON has none."""

    def strings(text: str | None) -> list[dict]:
        try:
            return _leaves(json.loads(text or ""))
        except (ValueError, RecursionError):
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([strings(x) for x in b.column(column).to_pylist()], _LEAVES.type)
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "leaves"])

    return mapped(rows, run, T.StructType([*rows.schema.fields, LEAVES]))


def read_logs(spark: SparkSession, *paths: str, mode: str = "PERMISSIVE", leaves: bool = False) -> DataFrame:
    """The silver table of all logs at the paths, with leaves as decoded() has them; with FAILFAST a file that is no log stops the query.

    Logs are read by ranges (ranges.LogSource) where executors can open the paths themselves. Elsewhere Spark
    reads each as one row, which holds up to 2 GB."""
    from logloom.sources import ranges

    if ranges.readable(*paths):
        return ranges.log_ranges(spark, *paths, mode=mode, rows="leaves" if leaves else "events")
    logs = files(spark, *paths)
    good = F.substring("content", 1, 8) == F.lit(evtx.FILE_MAGIC)
    logs = logs.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not an event log: "), "source")))) if mode == "FAILFAST" else logs.filter(good)
    return decoded(chunks(logs).repartition("source", "chunk_offset"), mode, leaves)


# ---- decoded JSON ----
#: Levels of elements within elements that are told apart; what lies deeper stays JSON, as the text of its element.
LEVELS = 12


def _text(x: str, path: str = "$") -> str:
    return f"try_variant_get({x}, '{path}', 'string')"


def _object(x: str) -> str:
    return f"try_variant_get({x}, '$', 'map<string,variant>')"


def _list(x: str) -> str:
    return f"try_variant_get({x}, '$', 'array<variant>')"


def _leaf(key: str, text: str) -> str:
    return f"named_struct('key', {key}, 'text', {text}, 'inner', CAST(NULL AS VARIANT))"


def _inner(key: str, x: str) -> str:
    return f"named_struct('key', {key}, 'text', CAST(NULL AS STRING), 'inner', {x})"


def _children(x: str) -> str:
    """SQL of what an object (a VARIANT) holds: leaves with their text, and objects that are to be gone into."""
    name = f"nullif(coalesce(nullif({_text('i', '$[\"@Name\"]')}, ''), {_text('i', '$[\"#attributes\"].Name')}), '')"
    shown = lambda of: f"coalesce({_text(of, '$[\"#text\"]')}, '')"
    data = f"IF({_object('i')} IS NOT NULL, {_leaf(name, shown('i'))}, {_leaf('CAST(NULL AS STRING)', _text('i'))})"
    each = f"""CASE
      WHEN e.key = 'Data' THEN transform(filter(coalesce({_list("e.value")}, array(e.value)), i -> NOT is_variant_null(i)), i -> {data})
      WHEN {_list("e.value")} IS NOT NULL THEN filter(transform({_list("e.value")}, (i, k) -> CASE WHEN is_variant_null(i) THEN NULL WHEN {_object("i")} IS NOT NULL THEN {_inner("e.key", "i")} ELSE {_leaf("concat(e.key, k)", _text("i"))} END), y -> y IS NOT NULL)
      WHEN {_object("e.value")} IS NULL THEN array({_leaf("e.key", _text("e.value"))})
      WHEN map_contains_key({_object("e.value")}, '#text') THEN array({_leaf("e.key", shown("e.value"))})
      ELSE array({_inner("e.key", "e.value")}) END"""
    said = "NOT startswith(e.key, '@') AND e.key NOT IN ('#text', '#attributes') AND NOT is_variant_null(e.value)"
    return f"flatten(transform(filter(map_entries({_object(x)}), e -> {said}), e -> {each}))"


def with_fields(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with data: the fields of decoded records as JSON text, EventData's and then UserData's; both ways of
    writing attributes. In the JVM throughout, a level of elements at a time.

    Numbers and booleans become text as Spark writes them, nulls are left out, a Data item without text is empty,
    unnamed ones are Data0, Data1 ..., lists of scalars get numbered names, the last field of a name counts; what
    isn't an event, or repeats a key within an object, gives nothing. Fields of one element come in the order of their names.
    """
    parts = ", ".join(f"try_variant_get(v, '$.Event.{p}', 'variant')" for p in ("EventData", "UserData"))
    found = rows.withColumn("_n", F.expr(f"transform(filter(transform(array(try_parse_json({column})), v -> array({parts})), a -> a IS NOT NULL)[0], p -> {_inner('CAST(NULL AS STRING)', 'p')})"))
    found = found.withColumn("_n", F.expr(f"filter(_n, n -> {_object('n.inner')} IS NOT NULL)"))
    for _ in range(LEVELS):
        found = found.withColumn("_n", F.expr(f"IF(exists(_n, n -> n.inner IS NOT NULL), flatten(transform(_n, n -> IF(n.inner IS NULL, array(n), {_children('n.inner')}))), _n)"))
    unnamed = "concat('Data', size(filter(slice(_n, 1, k), m -> m.key IS NULL AND m.inner IS NULL)))"
    entries = f"transform(_n, (n, k) -> named_struct('key', IF(n.key IS NULL, {unnamed}, n.key), 'value', coalesce(n.text, {_text('n.inner')})))"
    found = found.withColumn("_n", F.expr(entries))
    last = F.expr("map_from_entries(filter(_n, (e, k) -> NOT exists(slice(_n, k + 2, size(_n)), x -> x.key = e.key)))")
    return found.withColumn("data", F.coalesce(last, F.create_map().cast("map<string,string>"))).drop("_n")


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """The silver table of decoded records as JSON text (a column of `rows`; source, record_id if there)."""
    with_data = with_fields(rows, column)
    j = lambda *paths: F.coalesce(*[F.get_json_object(column, f"$.Event.System.{p}") for p in paths])
    system = with_data.select(
        *rows.columns,
        "data",
        F.coalesce(j("EventID['#text']", "EventID").try_cast("int"), F.lit(0)).alias("event_id"),
        j("Level").try_cast("int").alias("level"),
        j("Channel").alias("channel"),
        j("Computer").alias("computer"),
        j("Provider['#attributes'].Name", "Provider['@Name']").alias("provider"),
        j("Provider['#attributes'].Guid", "Provider['@Guid']").alias("provider_guid"),
        j("TimeCreated['#attributes'].SystemTime", "TimeCreated['@SystemTime']").try_cast("timestamp").cast("timestamp_ntz").alias("ts"),
    )
    return conform(system)
