"""Results as files and as text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.container import evtx
from logloom.functions.columns import guarded_cell, number, number_bytes, overlaid
from logloom.session import mapped


def flattened_for_csv(df: DataFrame) -> DataFrame:
    """Strings guarded against formulas; maps, arrays and structs as JSON."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.to_json(f.name) if kind in ("map", "array", "struct") else F.col(f.name)
        out.append((guarded_cell(c) if kind in ("string", "map", "array", "struct") else c).alias(f.name))
    return df.select(out)


def write_csv(df: DataFrame, path: str) -> None:
    flattened_for_csv(df).write.option("header", "true").option("escape", '"').mode("overwrite").csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_lines(df: DataFrame) -> Iterator[str]:
    """One JSON object a row, streamed partition by partition through the driver."""
    for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield r["j"]


def table(df: DataFrame, rows: int = 1000, width: int = 48) -> str:
    """The first rows as a plain table (a report); control and bidi characters are blanks."""
    held = df.limit(rows + 1).collect()
    if not held:
        return "(no records)"

    def cell(x: object) -> str:
        text = "".join(" " if ord(c) < 32 or 0x7F <= ord(c) < 0xA0 or c in "\u200e\u200f\u061c" or "\u202a" <= c <= "\u202e" or "\u2066" <= c <= "\u2069" else c for c in ("" if x is None else str(x)))
        return text if len(text) <= width else text[: width - 1] + "…"

    lines = [[cell(c) for c in df.columns], *[[cell(x) for x in r] for r in held[:rows]]]
    widths = [max(len(line[i]) for line in lines) for i in range(len(df.columns))]
    shown = ["  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in lines]
    return "\n".join([shown[0], "  ".join("-" * w for w in widths), *shown[1:], f"{min(len(held), rows)} records" + " or more" * (len(held) > rows)])


def mermaid_edges(edges: DataFrame) -> DataFrame:
    """line: edges (source, target, label) as Mermaid writes them, as a DataFrame, for graphs of any size."""
    name = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "_").otherwise(F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_"))
    return edges.select(F.concat(name(F.col("source")), F.lit(' -->|"'), F.col("label"), F.lit('"| '), name(F.col("target"))).alias("line"))


def mermaid_processes(nodes: DataFrame) -> DataFrame:
    """line: processes (pid, ppid, image) under their parents as Mermaid writes them, for trees of any size."""
    image = F.regexp_replace(F.coalesce("image", F.lit("")), r"[^\p{L}\p{N}\-_. ]", "_")
    return nodes.select(F.format_string('PID_%s --> PID_%s["%s"]', "ppid", "pid", F.when(image == "", "_").otherwise(image)).alias("line"))


def write_mermaid(lines: DataFrame, path: str) -> None:
    """A graph's lines as text files in a folder, written by the tasks that hold them; `graph LR` goes in front of all."""
    lines.select("line").write.mode("overwrite").text(path)


def mermaid_logons(edges: DataFrame, most: int = 2000) -> str:
    """A graph of the first `most` logon edges (source, target, logon_type, n) as text: a report. All edges of a graph of any
    size are written by write_mermaid()."""
    label = F.concat(F.lit("type "), F.col("logon_type"), F.lit(" x"), F.col("n")).alias("label")
    rows = mermaid_edges(edges.orderBy("source", "target", "logon_type").limit(most).select("source", "target", label)).collect()
    return "\n".join(["graph LR", *[f"    {r['line']}" for r in rows]])


def markdown_report(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    out = [f"# {title}", ""]
    for name, df in sections.items():
        held = df.limit(rows).collect()
        out += [f"## {name}", ""]
        if held:
            out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
            out += ["| " + " | ".join(str("" if x is None else x).replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in held]
        else:
            out.append("none")
        out.append("")
    return "\n".join(out)


#: Bytes of records that are packed at once (a chunk at least), and record ids whose places are counted at once.
PACKED, COUNTED = 1 << 20, 1 << 12
_ROOM = evtx.CHUNK - evtx.RECORDS_AT


def _placed(records: DataFrame) -> DataFrame:
    """records with start (bytes before a record among its source's, in the order of ids), end, number (from 1) and i,
    the stride of PACKED bytes that start is in. Running sums on two levels: no source is ordered as a whole."""
    size = 28 + F.octet_length("payload")
    fits = F.when(size <= _ROOM, size).otherwise(F.raise_error(F.concat(F.lit("doesn't fit into a chunk: record "), F.col("record_id"))).cast("int"))
    rows = records.select("source", "record_id", "filetime", F.coalesce("payload", F.unhex(F.lit(""))).alias("payload")).withColumn("size", fits.cast("long")).withColumn("part", F.floor(F.col("record_id") / COUNTED))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("source", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    inside = Window.partitionBy("source", "part").orderBy("record_id", "filetime", "payload").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("size").over(inside).alias("upto"), F.count(F.lit(1)).over(inside).alias("k")).join(parts, ["source", "part"])
    rows = rows.withColumn("end", F.col("bytes") + F.col("upto")).withColumn("start", F.col("end") - F.col("size")).withColumn("number", F.col("n") + F.col("k"))
    return rows.select("source", "record_id", "filetime", "payload", "start", "end", "number", F.expr(f"start div {PACKED}").alias("i"))


def _chunk_starts(placed: DataFrame) -> DataFrame:
    """source, i, chunks_before, chunk_starts: at which bytes of each stride a chunk begins if chunks are filled one after
    the other, each with as many records as it has room for.

    Which record follows a chunk is known for every record that might begin one. So each stride of records tells
    where the packing enters the next one, for every place at which it may enter this one; as in a sweep of
    an image (sources.ranges), only these functions are gone through in order."""
    import pyarrow as pa

    from logloom.sources.ranges import chain, entered, jumps

    near = placed.filter(F.col("start") - F.col("i") * PACKED <= _ROOM).filter("i > 0").select("source", (F.col("i") - 1).alias("i"), "start", "end", F.lit(False).alias("own"))
    every = placed.select("source", "i", "start", "end", F.lit(True).alias("own")).unionByName(near)
    strides = every.groupBy("source", "i").agg(F.array_sort(F.collect_list(F.struct("start", "end", "own"))).alias("r"))
    schema = pa.schema([("source", pa.string()), ("i", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("places", "nexts", "starts", "exits"))])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                base, ends = x["i"] * PACKED, [r["end"] for r in x["r"]]
                hits = [(r["start"] - base, ends[bisect_right(ends, r["start"] + _ROOM) - 1] - base) for r in x["r"] if r["own"]]
                starts, exits = jumps(hits, PACKED, _ROOM + 1)
                row = {"source": x["source"], "i": x["i"], "places": [p for p, _ in hits], "nexts": [n for _, n in hits], "starts": starts, "exits": exits}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                found = [x["i"] * PACKED + p for p in chain(list(zip(x["places"], x["nexts"], strict=True)), x["entry"])]
                yield pa.RecordBatch.from_arrays([pa.array([x["source"]]), pa.array([x["i"]], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["source", "i", "chunk_starts"])

    known = mapped(strides, functions, "source string, i long, places array<long>, nexts array<long>, starts array<long>, exits array<long>")
    entries = entered(known.select("source", "i", "starts", "exits"), PACKED, _ROOM + 1, "source")
    found = mapped(known.select("source", "i", "places", "nexts").join(entries, ["source", "i"]), chains, "source string, i long, chunk_starts array<long>")
    before = Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("chunks_before", F.coalesce(F.sum(F.size("chunk_starts")).over(before), F.lit(0)))


def log_parts(records: DataFrame) -> DataFrame:
    """source, part, content: the parts of a binary log for each source of records (source, record_id, filetime,
    payload), in the order of record ids: the file's header (0), and its chunks. A log's chunks are built by as many tasks as there are;
    one behind the other the parts are the file. A null payload is an empty one."""
    import pandas as pd

    placed = _placed(records)
    within = F.size(F.filter("chunk_starts", lambda s: s <= F.col("start")))
    rows = placed.join(_chunk_starts(placed), ["source", "i"]).withColumn("part", (F.col("chunks_before") + within).cast("long"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        raw = [evtx.record_bytes(int(i), int(t), bytes(p)) for i, t, p in zip(group["record_id"], group["filetime"], group["payload"], strict=True)]
        return pd.DataFrame({"source": [key[0]], "part": [key[1]], "content": [evtx.chunk_bytes(raw, int(group["number"].iloc[0]))]})

    def head(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"source": part["source"], "part": 0, "content": [evtx.file_header(int(n), int(top) + 1) for n, top in zip(part["n"], part["top"], strict=True)]})

    heads = rows.groupBy("source").agg(F.max("part").alias("n"), F.max("record_id").alias("top")).mapInPandas(head, "source string, part long, content binary")
    # A fixed number: few bytes, but much work, which adaptive execution would put into one task.
    dealt = rows.select("source", "part", "number", "record_id", "filetime", "payload").repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "part")
    return heads.unionByName(dealt.groupBy("source", "part").applyInPandas(build, "source string, part long, content binary"))


def logs_of(records: DataFrame) -> DataFrame:
    """source, content: a binary log for each source of records (source, record_id, filetime, payload), as one row.

    What is one row is built in one task; sources are independent of each other. Logs of any size are the parts
    of log_parts().
    """
    return built(records.select("source", "record_id", "filetime", "payload"), lambda rows: evtx.write_log(r[1:] for r in rows))


def built(rows: DataFrame, build: Callable[[Iterator[tuple]], bytes]) -> DataFrame:
    """source, content: what build makes of the rows of each source (source and record_id are columns of rows), which it gets
    in the order of record ids. Spark sorts; a task holds a batch of rows, and what is built of one source."""
    import pyarrow as pa

    at = rows.columns.index("source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for source, own in groupby(found, itemgetter(at)):
            yield pa.RecordBatch.from_pydict({"source": pa.array([source], pa.string()), "content": pa.array([build(own)], pa.binary())})

    # A fixed number: few bytes, but much work, which adaptive execution would put into one task.
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source")
    return mapped(dealt.sortWithinPartitions("source", "record_id"), run, "source string, content binary")


def write_files(rows: DataFrame, folder: str, ending: str = "") -> DataFrame:
    """path, length: a file in the folder for each row (source, content), written by the tasks that hold them.

    A file appears whole, under its name, when its last byte is there; a task that runs again writes the same.
    Names are sources as far as file names hold them, with their hash where not."""
    import os
    import uuid

    import pyarrow as pa

    from logloom.sources.ranges import opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        system.create_dir(inner)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                at, part = os.path.join(inner, name), os.path.join(inner, f".{uuid.uuid4().hex}")
                data = content.as_buffer() or pa.py_buffer(b"")
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, at)
                yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "length": [data.size]})

    return mapped(rows.select(_file_name(ending), "content"), run, "path string, length long")


def _file_name(ending: str) -> Column:
    plain = F.regexp_replace("source", r"[^A-Za-z0-9._-]", "_")
    own = F.when((plain == F.col("source")) & (F.length("source") < 200), plain)
    return F.concat(own.otherwise(F.concat(F.substring(plain, 1, 100), F.lit("-"), F.sha2("source", 256))), F.lit(ending)).alias("name")


def write_parts(parts: DataFrame, folder: str, ending: str = "", order: str = "part", count: str | None = None) -> DataFrame:
    """path, length: a file in the folder for each source of parts (source, content, and a column they are ordered by),
    its parts one behind the other: those of log_parts(), say, or with order="chunk_offset" of repaired_parts(). count: a column of
    parts that is true or false; how many of a file's parts have it true comes under its name, so parts needn't be made again for that.

    A file is written front to back by one task, which holds a batch of parts at a time; Spark sorts them, on disk if
    need be. Like those of write_files(), files appear whole, under the same names."""
    import os
    import uuid

    import pyarrow as pa

    from logloom.sources.ranges import opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        system.create_dir(inner)
        name, out, at, length, n = None, None, "", 0, 0

        def ended() -> pa.RecordBatch:
            out.close()
            system.move(at, os.path.join(inner, name))
            counted = {count: [n]} if count else {}
            return pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "length": [length]} | counted)

        for b in batches:
            marks = b.column(count).to_pylist() if count else [None] * b.num_rows
            for this, content, mark in zip(b.column("name").to_pylist(), b.column("content"), marks, strict=True):
                if this != name:
                    if out is not None:
                        yield ended()
                    at, length, n = os.path.join(inner, f".{uuid.uuid4().hex}"), 0, 0
                    name, out = this, system.open_output_stream(at)
                data = content.as_buffer() or pa.py_buffer(b"")
                out.write(data)
                length, n = length + data.size, n + bool(mark)
        if out is not None:
            yield ended()

    named = parts.select(_file_name(ending), F.col(order).alias("_order"), "content", *([count] if count else []))
    dealt = named.repartition("name").sortWithinPartitions("name", "_order").drop("_order")
    return mapped(dealt, run, "path string, length long" + (f", `{count}` long" if count else ""))


def repaired(logs: DataFrame) -> DataFrame:
    """source, content, chunks_checked, chunks_repaired, header_repaired of logs with right checksums."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, content in zip(b.column("source").to_pylist(), b.column("content").to_pylist(), strict=True):
                out, looked, mended, header = evtx.repair(content or b"")
                yield pa.RecordBatch.from_pydict({"source": [source], "content": pa.array([out], pa.binary()), "chunks_checked": [looked], "chunks_repaired": [mended], "header_repaired": [header]})

    return mapped(logs.select("source", "content"), run, "source string, content binary, chunks_checked long, chunks_repaired long, header_repaired boolean")


def mended_parts(parts: DataFrame) -> DataFrame:
    """parts of logs (source, chunk_offset, content) with right checksums, and mended: whether one was wrong. The part at
    offset 0 is the file's header, others are chunks; what has no magic, or isn't whole, stays as it is, and has mended null.

    Row by row and in the JVM: nothing is shuffled, and a log is as many tasks as it was read by."""
    c = F.col("content")
    head = (F.col("chunk_offset") == 0) & (F.substring(c, 1, 8) == F.lit(evtx.FILE_MAGIC)) & (F.octet_length(c) >= 128)
    chunk = (F.col("chunk_offset") > 0) & (F.substring(c, 1, 8) == F.lit(evtx.CHUNK_MAGIC)) & (F.octet_length(c) == evtx.CHUNK)
    rows = parts.select("source", "chunk_offset", "content", head.alias("is_head"), chunk.alias("is_chunk"), number(c, 0x30, 4).alias("free_at"))
    records = F.crc32(F.substring(c, F.lit(evtx.RECORDS_AT + 1), (F.col("free_at") - evtx.RECORDS_AT).cast("int")))
    summed = F.when(F.col("is_chunk") & F.col("free_at").between(evtx.RECORDS_AT, evtx.CHUNK), overlaid(c, 0x34, number_bytes(records, 4), 4)).otherwise(c)
    rows = rows.withColumn("summed", summed)
    own = number_bytes(F.crc32(F.substring("summed", 1, 0x78)), 4)
    right = F.when(F.col("is_head"), overlaid(F.col("summed"), 0x7C, own, 4)).when(F.col("is_chunk"), overlaid(F.col("summed"), 0x78, own, 4)).otherwise(c)
    rows = rows.withColumn("right", right)
    mended = F.when(F.col("is_head") | F.col("is_chunk"), F.substring("right", 1, 128) != F.substring(c, 1, 128))
    return rows.select("source", "chunk_offset", F.col("right").alias("content"), mended.alias("mended"))


def repaired_parts(spark: SparkSession, *paths: str, **options: str) -> DataFrame:
    """mended_parts() of logs of any size, read by ranges. In the order of chunk_offset they are the repaired files,
    which write_parts() writes."""
    from logloom.sources.ranges import log_ranges

    return mended_parts(log_ranges(spark, *paths, rows="parts", **options))
