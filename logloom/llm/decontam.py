"""Benchmark decontamination: documents against the word windows of test items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.repeats import filter_of, in_filter
from logloom.llm.shared import unused, written

_FOLD = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))

#: Most windows, and bytes of their words and items, that are broadcast; beyond either, windows are joined by shuffle.
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20

_SPAN = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("key", pa.int64())])
_SPANS = "array<struct<first:int,words:int,key:long>>"


def _normal(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words in lower case (A-Z), joined by one space."""
    return b" ".join(raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)).translate(_FOLD)


def windows(benchmark: DataFrame, words: int) -> DataFrame:
    """item_id, n, key, words: the distinct windows of every item; an item with fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tb.slices(batches):
            start, end, row = tb.words(data, offsets, tb.ALNUM)
            word, raw = tb.word_hashes(data, start, end, folded=True), data.tobytes()
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            item, out = batch.column("item_id"), defaultdict(list)
            for r in range(batch.num_rows):
                a, b = edges[r], edges[r + 1]
                n = min(words, int(b - a))
                if n:
                    keys, first = np.unique(tb.gram_hashes(word[a:b], n), return_index=True)
                    for k, f in zip(keys.view(np.int64).tolist(), first.tolist(), strict=True):
                        for name, v in zip(("item_id", "n", "key", "words"), (item[r].as_py(), n, k, _normal(raw, start[a + f : a + f + n], end[a + f : a + f + n])), strict=True):
                            out[name].append(v)
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("words", pa.binary())]))

    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(run, "item_id string, n int, key long, words binary")


@dataclass
class _Index:
    """The windows of all items: sorted keys by length, by which a window may hit, and the items of its words."""

    keys: dict[int, np.ndarray]
    items: dict[bytes, list[str]]

    @classmethod
    def of(cls, rows: list) -> "_Index":
        by_n: dict[int, set[int]] = defaultdict(set)
        items: dict[bytes, list[str]] = defaultdict(list)
        for r in rows:
            by_n[r["n"]].add(r["key"])
            items[bytes(r["words"])].append(r["item_id"])
        return cls({n: np.sort(np.fromiter(k, np.int64, len(k)).view(np.uint64)) for n, k in by_n.items()}, dict(items))

    def passes(self, n: int, key: np.ndarray) -> np.ndarray:
        keys = self.keys[n]
        return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


@dataclass
class _Hit:
    """A window: its row, first word in the text, number of words, key, normal words, and bytes from start to end."""

    row: int
    first: int
    n: int
    key: int
    words: bytes
    start: int
    end: int


def _scan(data: np.ndarray, offsets: np.ndarray, lengths: list[int], passes: Callable) -> tuple[np.ndarray, list[_Hit]]:
    """The number of words of each row, and the windows of the given lengths whose keys pass, in order. A long
    text is worked off in parts."""
    rows, overlap = len(offsets) - 1, max(lengths, default=1) - 1
    spans = tb.long_parts(data, tb.ALNUM, tb.SLICE_BYTES, overlap) if rows == 1 and len(data) > tb.SLICE_BYTES else [(0, len(data))]
    counts, base, hits = np.zeros(rows, np.int64), 0, {}
    for a, b in spans:
        part, edges = data[a:b], offsets if rows > 1 else np.array([0, b - a])
        start, end, row = tb.words(part, edges, tb.ALNUM)
        word, raw, first = tb.word_hashes(part, start, end, folded=True), None, np.searchsorted(row, np.arange(rows)) - base
        counts = tb.row_counts(row, rows) + base
        for n in lengths:
            key = tb.gram_hashes(word, n)
            at = np.flatnonzero(row[: len(key)] == row[n - 1 : n - 1 + len(key)])
            at = at[passes(n, key[at])]
            for i, k in zip(at.tolist(), key[at].view(np.int64).tolist(), strict=True):
                raw = raw if raw is not None else part.tobytes()
                r = int(row[i])
                # Parts of a text have windows in common.
                hits[r, i - int(first[r]), n] = _Hit(r, i - int(first[r]), n, k, _normal(raw, start[i : i + n], end[i : i + n]), a + int(start[i]), a + int(end[i + n - 1]))
        base += len(start) - overlap
    return counts, [hits[at] for at in sorted(hits)]


def _found(index: _Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[_Hit]]]:
    """The number of words and the hits of each row: windows that have the words of an item's."""
    counts, hits = _scan(data, offsets, sorted(index.keys), index.passes)
    by_row: list[list[_Hit]] = [[] for _ in counts]
    for h in hits:
        if h.words in index.items:
            by_row[h.row].append(h)
    return counts, by_row


def _covered(spans: Iterator[tuple[int, int]]) -> int:
    """How many places the spans (first, end), sorted by first, cover."""
    n = reach = 0
    for a, b in spans:
        n += max(0, b - max(a, reach))
        reach = max(reach, b)
    return n


def _scanned(docs: DataFrame, index: _Index) -> DataFrame:
    """By broadcast, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, data, offsets in tb.slices(batches):
            counts, found = _found(index, data, offsets)
            spans = pa.array([[{"first": h.first, "words": h.n, "key": h.key} for h in hits] for hits in found], pa.list_(_SPAN))
            hit = pa.array([_covered((h.first, h.first + h.n) for h in hits) for hits in found], pa.int64())
            items = pa.array([sorted({i for h in hits for i in index.items[h.words]}) for hits in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts), spans, hit, items], ["doc_id", "text_hash", "n_words", "spans", "n_hit", "item_ids"])

    return docs.mapInArrow(run, f"doc_id long, text_hash long, n_words long, spans {_SPANS}, n_hit long, item_ids array<string>")


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """By shuffle, for benchmarks of any size: a bit filter of fixed size (none, if it would be too full) passes
    the windows that may hit, and those are joined on their words."""
    lengths = sorted(r["n"] for r in found.select("n").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(found.select("key").distinct(), F.col("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, data, offsets in tb.slices(batches):
            counts, hits = _scan(data, offsets, lengths, lambda n, key: in_filter(bits, key))
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            rows = [(d, t, c, None, None, None, None) for d, t, c in zip(ids, text, counts.tolist(), strict=True)]
            rows += [(ids[h.row], text[h.row], None, h.first, h.n, h.key, h.words) for h in hits]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "text_hash", "n_words", "first", "n", "key", "words"])

    seen = written(docs.mapInArrow(run, "doc_id long, text_hash long, n_words long, first int, n int, key long, words binary"), "windows")
    # Equal rows have the same hits; each of them gets all, once.
    hits = written(seen.filter("key is not null").join(found.select("key", "words", "item_id"), ["key", "words"]).select("doc_id", "text_hash", "first", "n", "key", "item_id").distinct(), "hits")
    by_row = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    spans = by_row.agg(F.array_sort(F.collect_set(F.struct("first", F.col("n").alias("words"), "key"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    all_rows = seen.filter("key is null").select("doc_id", "text_hash", "n_words")
    out = all_rows.join(spans, all_rows["doc_id"].eqNullSafe(spans["d"]) & (all_rows["text_hash"] == spans["t"]), "left")
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["first"] + s["words"] - F.greatest(a["end"], s["first"]))).alias("n"), F.greatest(a["end"], s["first"] + s["words"]).alias("end")),
    )["n"]
    out = out.withColumn("n_hit", F.coalesce(hit, F.lit(0)).cast("long"))
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def _index_of(benchmark: DataFrame, words: int, most: int) -> tuple[DataFrame, _Index | None]:
    """The windows of all items, and their index if it may be broadcast."""
    found = written(windows(benchmark, words), "items")
    total, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("words") + F.octet_length("item_id"))).first()
    if total and (total > most or size > BROADCAST_BYTES):
        return found, None
    return found, _Index.of(found.collect())


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 10, most_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_hash, n_words, spans, n_hit, item_ids of every document.

    Words are runs of ASCII letters and digits and of bytes above 0x7F, A-Z in lower case. An item's windows
    are its runs of `words` words, or all of it if it has fewer; every occurrence in a document's whole text
    is a span (first word, number of words, key). n_hit: words inside any span. item_ids: the items with
    occurring windows, as strings, sorted, each once. text_hash: xxhash64 of the text.
    Null and empty texts have no words; rows of the benchmark without item_id or words give no window; a
    null doc_id stays null; repeated rows each give a row; other columns are not read; no rows in, no rows out.

    The benchmark is broadcast only up to most_broadcast windows and BROADCAST_BYTES of words and ids, measured
    first; beyond it, windows meet by a shuffle. A passage in a third of all documents costs no more than any
    other: documents aren't shuffled. Long texts are worked off in parts.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    found, index = _index_of(benchmark, words, most_broadcast)
    return _scanned(docs, index) if index is not None else _joined(docs, found)


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(raw[at : max(at, a)])
        at = max(at, b)
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 10, action: str = "documents", most_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs, all columns kept whatever their names, without what leaked.

    action "documents" drops every document with a hit; "spans" cuts from each text what reaches from the
    first byte of a span's first word to the end of its last. Rows keep their null texts and ids. With a
    broadcast benchmark (see find_leaks) this is one pass; else rows meet their spans by doc_id and text.
    """
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    spark, columns = docs.sparkSession, docs.columns
    found, index = _index_of(benchmark, words, most_broadcast)
    if index is not None:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in tb.slices(batches):
                _, hits = _found(shared.value, data, offsets)
                if action == "documents":
                    yield batch.filter(pa.array([not h for h in hits], pa.bool_()))
                else:
                    yield _without(batch, columns, data, offsets, {r: [(h.start, h.end) for h in x] for r, x in enumerate(hits) if x})

        return docs.mapInArrow(run, docs.schema)
    d, t, s = unused(docs, "d", "t", "s")
    leaks = _joined(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")), found)
    leaks = leaks.filter("n_hit > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.col("spans").alias(s)).dropDuplicates([d, t])
    same = docs["doc_id"].cast("long").eqNullSafe(leaks[d]) & (F.xxhash64(docs["text"]) == leaks[t])
    if action == "documents":
        return docs.join(leaks, same, "left_anti")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tb.slices(batches):
            start, end, row = tb.words(data, offsets, tb.ALNUM)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans = {r: [(int(start[edges[r] + x["first"]]), int(end[edges[r] + x["first"] + x["words"] - 1])) for x in found] for r, found in enumerate(batch.column(s).to_pylist()) if found}
            yield _without(batch, columns, data, offsets, spans)

    return docs.join(leaks, same, "left").mapInArrow(cut, docs.schema)


def _without(batch: pa.RecordBatch, columns: list[str], data: np.ndarray, offsets: np.ndarray, spans: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
    """The columns of a batch, its texts without the spans (bytes of data) of some rows."""
    texts = batch.column("text").to_pylist()
    for r, cuts in spans.items():
        a, b = int(offsets[r]), int(offsets[r + 1])
        texts[r] = _cut(data[a:b].tobytes(), [(x - a, y - a) for x, y in cuts])
    return pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns], columns)


def benchmark_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
