"""Logs and images read by ranges of bytes: a splittable data source, and an exact sweep of images in strides.

Executors open files through pyarrow: local and shared folders, s3, gs, abfs, and hdfs where its library is there.
"""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from logloom.container import evtx
from logloom.schema import SILVER
from logloom.session import mapped
from logloom.sources import logs as L

#: Bytes that a task of the data source reads, and that it holds at once.
TASK, HELD = 1 << 24, 1 << 20
#: Tasks of one read. Where chunksPerTask would make more, tasks read more chunks, still HELD bytes at a time.
MOST_TASKS = 1 << 12
_SCHEMES = re.compile(r"(file|s3|gs|gcs|abfss?|hdfs|viewfs)$")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    scheme = path.partition(":")[0] if re.match(r"[a-z][a-z0-9+.-]*:/", path) else ""
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def readable(*paths: str) -> bool:
    """Whether executors can open the paths themselves; others only Spark's readers reach."""
    return all(_SCHEMES.match(p.partition(":")[0]) and not p.startswith(("hdfs:", "viewfs:")) for p in paths if re.match(r"[a-z][a-z0-9+.-]*:/", p))


def listed(paths: list[str], pattern: str = r".*") -> list[tuple[str, int]]:
    """Path and length of files, or of all below folders whose names match the pattern, each once."""
    found: dict[str, int] = {}
    for path in paths:
        system, inner = opened(path)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        inside = system.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        for f in inside:
            if f.type == pafs.FileType.File and (f is info or re.fullmatch(pattern, f.base_name)):
                found[prefix + f.path] = f.size
    return sorted(found.items())


def bytes_at(file: pa.NativeFile, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


# ---- a data source ----
@dataclass
class ChunkRanges(InputPartition):
    """Chunks [first, end) of each of some logs."""

    ranges: list[tuple[str, int, int]]


class LogReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.mode = schema, options.get("mode", "PERMISSIVE")
        self.rows = options.get("rows", "events")
        self.per_task = int(options.get("chunkspertask", TASK // evtx.CHUNK))
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.least_id, self.most_id = None, None

    def partitions(self) -> list[ChunkRanges]:
        """Ranges of per_task chunks, or more where there are very many; small logs share a task."""
        logs = [(path, max(1, -(-(length - evtx.HEADER_BLOCK) // evtx.CHUNK))) for path, length in listed(self.paths, r".*\.[eE][vV][tT][xX]")]
        per_task = max(self.per_task, -(-sum(n for _, n in logs) // MOST_TASKS))
        out, held, room = [], [], per_task
        for path, n in logs:
            at = 0
            while at < n:
                step = min(room, n - at)
                held.append((path, at, at + step))
                at, room = at + step, room - step
                if room == 0:
                    out.append(ChunkRanges(held))
                    held, room = [], per_task
        return [*out, ChunkRanges(held)] if held else out

    def _wanted(self, chunk: bytes) -> bool:
        """Whether a chunk may hold record ids within the bounds; damaged headers say nothing."""
        header = None if self.least_id is None and self.most_id is None else evtx.ChunkHeader.parse(chunk)
        if header is None or header.checksum != header.computed or not header.records_ok(chunk) or header.last_id < header.first_id:
            return True
        return not (self.least_id is not None and header.last_id < self.least_id or self.most_id is not None and header.first_id > self.most_id)

    def _chunks(self, ranges: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, bytes]]:
        for path, first, end in ranges:
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                if self.rows != "facts" and bytes_at(file, 0, 8) != evtx.FILE_MAGIC:
                    if self.mode == "FAILFAST":
                        raise ValueError(f"not an event log: {path}")
                    continue
                for at in range(first, end, HELD // evtx.CHUNK):
                    held = bytes_at(file, evtx.HEADER_BLOCK + at * evtx.CHUNK, min(end - at, HELD // evtx.CHUNK) * evtx.CHUNK)
                    for x in range(0, len(held), evtx.CHUNK):
                        if self._wanted(held[x : x + evtx.CHUNK]):
                            yield path, evtx.HEADER_BLOCK + at * evtx.CHUNK + x, held[x : x + evtx.CHUNK]

    def _facts(self, ranges: list[tuple[str, int, int]]) -> Iterator[dict]:
        for path, first, _ in ranges:
            if first == 0:
                system, inner = opened(path)
                with system.open_input_file(inner) as file:
                    end = length = file.size()
                    while end and not (tail := bytes_at(file, max(0, end - HELD), min(end, HELD)).rstrip(b"\0")):
                        end = max(0, end - HELD)
                    yield L.file_fact(path, bytes_at(file, 0, 128), length, max(0, end - HELD) + len(tail) if end else 0)
        for source, at, content in self._chunks(ranges):
            yield from L.chunk_facts(source, at, content)

    def _parts(self, ranges: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, bytes]]:
        for path, first, end in ranges:
            if first == 0:
                system, inner = opened(path)
                with system.open_input_file(inner) as file:
                    head = bytes_at(file, 0, evtx.HEADER_BLOCK)
                if head[:8] == evtx.FILE_MAGIC or self.mode == "FAILFAST":
                    yield path, 0, head
            yield from self._chunks([(path, first, end)])

    def read(self, partition: ChunkRanges) -> Iterator[pa.RecordBatch]:
        names, found = self.schema.fieldNames(), self._chunks(partition.ranges)
        if self.rows == "facts":
            yield from (b.select(names) for b in L.batched(self._facts(partition.ranges), L.FACT_SCHEMA))
        elif self.rows in ("chunks", "parts"):
            for source, at, content in found if self.rows == "chunks" else self._parts(partition.ranges):
                yield pa.RecordBatch.from_pylist([{"source": source, "chunk_offset": at, "content": content}], schema=L.CHUNK_SCHEMA).select(names)
        else:
            leaves, known = self.rows == "leaves", L.LEAVES_SCHEMA if self.rows == "leaves" else L.SILVER_SCHEMA
            plain = L.PLAIN.issuperset(names)
            rows = (r for source, at, content in found for r in L.events_of(source, at, content, self.mode, leaves, plain))
            yield from L.batched(rows, pa.schema([known.field(n) for n in names]))


class FilteredLogReader(LogReader):
    """Spark refuses a reader with pushFilters() unless spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of record_id leave out chunks by their headers; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("record_id",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least_id = max(f.value, self.least_id if self.least_id is not None else f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most_id = min(f.value, self.most_id if self.most_id is not None else f.value)
            yield f


class LogSource(DataSource):
    """spark.read.format("evtx"): the silver table of logs or folders of them, or with rows=leaves that and all their strings, with rows=chunks their chunk rows,
    with rows=parts these and their headers (at offset 0), with rows=facts what verification needs of them.

    A task reads chunksPerTask chunks of 64 KiB by their offsets (more, where that would be over MOST_TASKS tasks), so one log
    is many tasks and has no greatest length; small logs share tasks. A schema with some of the columns makes only those. With
    pushdown=true (and spark.sql.python.filterPushdown.enabled), bounds of record_id skip chunks by their headers. mode is
    PERMISSIVE (what is no log, or can't be decoded, is left out) or FAILFAST (it stops the query).
    """

    @classmethod
    def name(cls) -> str:
        return "evtx"

    def schema(self) -> T.StructType | str:
        return {"chunks": L.CHUNKS, "parts": L.CHUNKS, "facts": L.FACTS, "leaves": L.SILVER_LEAVES}.get(self.options.get("rows", "events"), SILVER)

    def reader(self, schema: T.StructType) -> LogReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteredLogReader if options.get("pushdown") == "true" else LogReader)(schema, options)


def log_ranges(spark: SparkSession, *paths: str, columns: str | None = None, **options: str) -> DataFrame:
    """What LogSource reads at the paths; columns: a schema with some of its columns, if not all are needed."""
    spark.dataSource.register(LogSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("evtx").options(**({"paths": json.dumps(list(paths)), "pushdown": pushdown} | options))
    return (reader.schema(columns) if columns else reader).load()


# ---- sweeps ----
@dataclass(frozen=True)
class Scan:
    """A sequential search: hits(bytes, base, size) gives place and next place of all that may be found in bytes that stand
    at base of an image of that size. A hit counts if the search, which goes on at the next place of each, gets to it."""

    hits: Callable[[bytes, int, int], Iterator[tuple[int, int]]]
    look: int
    """Bytes behind a place that a hit is told by."""
    reach: int
    """How far the next place may lie ahead."""


def _chunk_hits(b: bytes, base: int, size: int) -> Iterator[tuple[int, int]]:
    at = -1
    while (at := b.find(evtx.CHUNK_MAGIC, at + 1)) >= 0:
        if (base + at) % 8 == 0:
            yield at, at + (evtx.CHUNK if base + at + evtx.CHUNK <= size else 8)


def _record_hits(b: bytes, base: int, size: int) -> Iterator[tuple[int, int]]:
    at, length = -1, struct.Struct("<I").unpack_from
    while (at := b.find(evtx.RECORD_MAGIC, at + 1)) >= 0:
        n = length(b, at + 4)[0] if at + 8 <= len(b) else 0
        if evtx.LEAST_RECORD <= n <= evtx.MOST_RECORD and base + at + n <= size:
            yield at, at + n


CHUNK_SCAN, RECORD_SCAN = Scan(_chunk_hits, 8, evtx.CHUNK), Scan(_record_hits, 25, evtx.MOST_RECORD)


def jumps(hits: list[tuple[int, int]], stride: int, reach: int) -> tuple[list[int], list[int]]:
    """For a stride's hits: where the search enters the next stride, by where it enters this one.

    An entry up to starts[i] (and above starts[i - 1]) leads to exits[i], one beyond all starts to 0; entries
    behind the whole stride are none of it. From behind, each hit's exit is that of the hit its next place leads to.
    """
    places, exits = [p for p, _ in hits], [0] * len(hits)
    for i in range(len(hits) - 1, -1, -1):
        following = hits[i][1]
        j = bisect_left(places, following)
        exits[i] = following - stride if following >= stride else exits[j] if j < len(hits) else 0
    within = bisect_left(places, reach) + 1
    places, exits = places[:within], exits[:within]
    last = [i for i in range(len(places)) if i + 1 == len(places) or exits[i + 1] != exits[i]]
    return [places[i] for i in last], [exits[i] for i in last]


def chain(hits: list[tuple[int, int]], entry: int) -> Iterator[int]:
    """The hits that a search from entry on gets to."""
    for place, following in hits:
        if place >= entry:
            yield place
            entry = following


def composed(functions: list[tuple[list[int], list[int]]], stride: int, reach: int) -> tuple[list[int], list[int]]:
    """What jumps() would give of neighbouring strides taken as one, by their own (starts, exits)."""
    ends: list[list[int]] = [[] for _ in functions]

    def end(i: int, entry: int) -> int:
        i, entry = i + entry // stride, entry % stride
        return entry + (i - len(functions)) * stride if i >= len(functions) else ends[i][bisect_left(functions[i][0], entry)]

    for i in range(len(functions) - 1, -1, -1):
        ends[i] = [end(i + 1, x) for x in (*functions[i][1], 0)]
    starts, exits = [], []
    for i in range(min(len(functions), reach // stride + 1)):
        for start, x in zip((*functions[i][0], stride - 1), ends[i], strict=True):
            if exits and exits[-1] == x:
                starts[-1] = i * stride + start
            else:
                starts.append(i * stride + start)
                exits.append(x)
    return starts, exits


def walked(functions: list[tuple[list[int], list[int]]], stride: int, entry: int) -> Iterator[int]:
    """The entries into neighbouring strides, by the entry into the first."""
    for starts, exits in functions:
        yield entry
        k = bisect_left(starts, entry)
        entry = entry - stride if entry >= stride else exits[k] if k < len(exits) else 0


#: Bytes of neighbouring strides that are searched as one.
SEARCHED = 1 << 20


def searched(stride: int) -> int:
    """The bytes of an image that are read and searched at once: as many whole strides as SEARCHED holds, or one. What a search
    finds doesn't depend on it (jumps() of neighbouring strides taken as one are composed() of theirs), but a row, a read and
    a function for each stride of a kilobyte would be most of the work."""
    return stride * max(1, SEARCHED // stride)


def _strides(spark: SparkSession, paths: list[str], stride: int) -> DataFrame:
    """source, size, i of every stride: no bytes yet."""
    images = spark.createDataFrame(listed(paths), "source string, size long").filter("size > 0")
    each = images.select("source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {stride}"))).alias("i"))
    return each.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "source", "i")


def _opened_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.NativeFile]]:
    """The rows with their source's file, which stays open as long as the source is the same."""
    source, file = None, None
    try:
        for batch in batches:
            for x in batch.to_pylist():
                if x["source"] != source:
                    if file is not None:
                        file.close()
                    system, inner = opened(x["source"])
                    source, file = x["source"], system.open_input_file(inner)
                yield x, file
    finally:
        if file is not None:
            file.close()


def _read_stride(file: pa.NativeFile, size: int, i: int, stride: int, scan: Scan) -> tuple[bytes, list[tuple[int, int]]]:
    b = bytes_at(file, i * stride, stride + scan.look)
    return b, [h for h in scan.hits(b, i * stride, size) if h[0] < stride]


def entries(spark: SparkSession, paths: list[str], stride: int, scan: Scan) -> DataFrame:
    """source, size, i, entry: where the one sequential search through an image enters each stride: each stride
    gives its exit for every entry (jumps), and entered() puts these together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for x, file in _opened_rows(batches):
                starts, exits = jumps(_read_stride(file, x["size"], x["i"], stride, scan)[1], stride, scan.reach)
                yield x | {"starts": starts, "exits": exits}

        yield from L.batched(rows(), schema)

    schema = pa.schema([("source", pa.string()), ("size", pa.int64()), ("i", pa.int64()), ("starts", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))])
    functions = mapped(_strides(spark, paths, stride), run, "source string, size long, i long, starts array<long>, exits array<long>")
    return entered(functions, stride, scan.reach, "source", "size")


#: Strides whose functions are put together by one task.
BLOCK = 1 << 10


def entered(functions: DataFrame, stride: int, reach: int, *by: str) -> DataFrame:
    """by, i, entry: where a search that begins at 0 enters each stride i (all from 0 on), by the strides' functions
    (starts, exits of jumps()).

    The functions of BLOCK strides make one, block by block in parallel; those of the blocks are gone through in order, which
    gives where each block is entered, and then, again in parallel, each block's own. So what one task holds is a
    block's functions, or a function for each block of a source."""
    key = [(f.name, f.dataType.simpleString()) for f in functions.select(*by).schema.fields]
    kinds, types = ", ".join(f"{name} {kind}" for name, kind in key), [(name, {"string": pa.string(), "bigint": pa.int64()}[kind]) for name, kind in key]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for x in batch.to_pylist():
                    starts, exits = composed([(y["starts"], y["exits"]) for y in x["f"]], stride, reach)
                    yield {n: x[n] for n in by} | {"block": x["block"], "starts": starts, "exits": exits}

        yield from L.batched(rows(), pa.schema([*types, ("block", pa.int64()), ("starts", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))]), 64)

    def gone_through(name: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[dict]:
                for batch in batches:
                    for x in batch.to_pylist():
                        found = walked([(y["starts"], y["exits"]) for y in x["f"]], width, x.get("entry") or 0)
                        yield from ({n: x[n] for n in by} | {name: y[name], "entry": e} for y, e in zip(x["f"], found, strict=True))

            yield from L.batched(rows(), pa.schema([*types, (name, pa.int64()), ("entry", pa.int64())]))

        return run

    gathered = lambda name: F.array_sort(F.collect_list(F.struct(name, "starts", "exits"))).alias("f")
    blocks = functions.groupBy(*by, F.expr(f"i div {BLOCK}").alias("block")).agg(gathered("i"))
    tops = mapped(blocks, put_together, f"{kinds}, block long, starts array<long>, exits array<long>").groupBy(*by).agg(gathered("block"))
    firsts = mapped(tops, gone_through("block", BLOCK * stride), f"{kinds}, block long, entry long")
    # Each block has an entry. An inner join would put filters for keys that are null under one use of blocks only, and Spark would make both.
    return mapped(blocks.join(firsts, [*by, "block"], "left"), gone_through("i", stride), f"{kinds}, i long, entry long")


def _swept(spark: SparkSession, paths: list[str], stride: int, scan: Scan, row: Callable[[str, int, bytes], dict], need: int, schema: pa.Schema, kinds: str) -> DataFrame:
    stride = searched(stride)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for x, file in _opened_rows(batches):
                b, hits = _read_stride(file, x["size"], x["i"], stride, scan)
                for at in chain(hits, x["entry"]):
                    whole = b[at : at + need] if at + need <= len(b) else bytes_at(file, x["i"] * stride + at, need)
                    yield row(x["source"], x["i"] * stride + at, whole)

        yield from L.batched(rows(), schema, 16 if need > 1 << 10 else L.ROWS)

    found = entries(spark, paths, stride, scan)
    found = found.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "source", "i")
    return mapped(found, run, kinds)


def sweep_chunks(spark: SparkSession, *paths: str, stride: int = 1 << 26) -> DataFrame:
    """Chunk rows of images of any size (files, or all below folders): what one search from the first byte on
    finds, which goes on behind every whole chunk. Strides of each image are read in parallel, twice; bytes aren't shuffled."""
    if stride % 8:
        raise ValueError("a stride is a multiple of 8")
    row = lambda source, at, b: {"source": source, "chunk_offset": at, "content": b}
    return _swept(spark, list(paths), stride, CHUNK_SCAN, row, evtx.CHUNK, L.CHUNK_SCHEMA, L.CHUNKS)


def sweep_records(spark: SparkSession, *paths: str, stride: int = 1 << 26) -> DataFrame:
    """The rows of logs.memory_records() of memory images of any size: what one search through each finds, which goes on behind every record."""

    def row(source: str, at: int, b: bytes) -> dict:
        n, record_id, filetime = struct.unpack_from("<IQQ", b.ljust(28, b"\0"), 4)
        how = "memory" if n > 28 and b[24:25] == b"\x0f" else "memory_unsure"
        return {"source": source, "record_offset": at, "size": n, "record_id": L.signed(record_id), "filetime": L.signed(filetime), "how": how}

    return _swept(spark, list(paths), stride, RECORD_SCAN, row, 28, L.MEMORY_SCHEMA, L.MEMORY_RECORDS)


# ---- carvers ----
@dataclass(frozen=True)
class Carver:
    """A format: signatures that stand at its beginning, the most bytes that one item takes, and what is in such a
    window: (kind, confidence) of each item, none if the window fails the format's own checks."""

    format: str
    signatures: tuple[bytes, ...]
    window: int
    carve: Callable[[bytes], list[tuple[str, float]]]


def _carve_chunk(window: bytes) -> list[tuple[str, float]]:
    """A header whose checksum is right; surer if records were found, in use or in free space."""
    header = evtx.ChunkHeader.parse(window)
    if len(window) < 128 or header is None or header.checksum != header.computed:
        return []
    some = evtx.records_of(window, free=True)[2] or next(evtx.walk_free(window, evtx.RECORDS_AT), None)
    return [("records", 0.95 if some else 0.8)]


EVTX_CHUNK = Carver("evtx-chunk", (evtx.CHUNK_MAGIC,), evtx.CHUNK, _carve_chunk)


def carve(spark: SparkSession, *paths: str, carvers: tuple[Carver, ...] = (EVTX_CHUNK,), method: str = "unallocated", stride: int = 1 << 26) -> DataFrame:
    """source, format, offset, kind, confidence, method of what the carvers find in images: one sweep for all of
    them, in strides. Each place of a signature is its carver's to judge, whether or not it lies in another item."""
    signs = re.compile(b"|".join(re.escape(s) for s in sorted({s for c in carvers for s in c.signatures}, key=len, reverse=True)))
    look = max(len(s) for c in carvers for s in c.signatures)
    schema = pa.schema([("source", pa.string()), ("format", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("confidence", pa.float64()), ("method", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for x, file in _opened_rows(batches):
                b, at = bytes_at(file, x["i"] * stride, stride + look), -1
                while (hit := signs.search(b, at + 1)) and hit.start() < stride:
                    at = hit.start()
                    for c in carvers:
                        if b.startswith(c.signatures, at):
                            window = b[at : at + c.window] if at + c.window <= len(b) else bytes_at(file, x["i"] * stride + at, c.window)
                            for kind, confidence in c.carve(window):
                                yield {"source": x["source"], "format": c.format, "offset": x["i"] * stride + at, "kind": kind, "confidence": confidence, "method": method}

        yield from L.batched(rows(), schema)

    return mapped(_strides(spark, list(paths), stride), run, "source string, format string, offset long, kind string, confidence double, method string")
