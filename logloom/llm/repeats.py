"""Anchors of repeated strings: sampled positions by which equal windows find each other.

A window is `window` consecutive units (bytes or words) of one document. Its anchor is the gram of `gram`
units inside it with the least hash, the leftmost of equals. Equal windows have their anchors at the same
place, each window has one anchor, and there is about one anchor for every (window - gram + 2) / 2 units.
The windows of an anchor follow each other; together they cover its stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.shared import dropped, written

#: 2**27 bits, 16 MB: filters that are broadcast never grow.
FILTER_BITS = 27
#: Most keys that a filter is made of (a quarter of its bits). What is more meets by a shuffle instead.
FILTER_KEYS = 1 << 25

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for each pair of names, in order."""
    h = left * _ODD
    h += right
    h ^= h >> np.uint64(32)
    h *= _GOLDEN
    return h


@dataclass
class Units:
    """The units of a slice of rows: names of the strings of `width` units at every place, and the rows' edges.

    Names are made by doubling: that of 2 w units is the name of the pair of names of w units at places w
    apart, up to the largest power of two within a gram. Equal strings have equal names, without a sort.
    """

    names: np.ndarray
    width: int
    edges: np.ndarray
    word: np.ndarray | None = None

    @classmethod
    def _doubled(cls, names: np.ndarray, width: int, gram: int, edges: np.ndarray, word: np.ndarray | None = None) -> "Units":
        while 2 * width <= gram:
            names = _pairs(names[:-width], names[width:]) if len(names) > width else names[:0]
            width *= 2
        return cls(names, width, edges, word)

    @classmethod
    def of_bytes(cls, data: np.ndarray, offsets: np.ndarray, gram: int) -> "Units":
        if gram < 8:
            return cls._doubled(tb.mixed(data.astype(np.uint64) + _GOLDEN), 1, gram, offsets)
        first = tb.eights(data)[: max(0, len(data) - 7)] * _ODD
        first ^= first >> np.uint64(32)
        first *= _GOLDEN
        return cls._doubled(first, 8, gram, offsets)

    @classmethod
    def of_words(cls, data: np.ndarray, offsets: np.ndarray, gram: int) -> "Units":
        start, end, row = tb.words(data, offsets, tb.NOT_SPACE)
        return cls.of_hashes(tb.word_hashes(data, start, end), np.searchsorted(row, np.arange(len(offsets))), gram)

    @classmethod
    def of_hashes(cls, word: np.ndarray, edges: np.ndarray, gram: int) -> "Units":
        return cls._doubled(word, 1, gram, edges, word)

    def spans(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Names of [start, end), each of a gram at least. Names with another salt are independent of these
        but for equal names of `width` units."""
        w = self.width
        h = _pairs(tb.mixed((end - start).astype(np.uint64) + np.uint64(salt)), self.names[start])
        at = start + w
        live = np.flatnonzero(at + w < end)
        while len(live):
            h[live] = _pairs(h[live], self.names[at[live]])
            at[live] += w
            live = live[at[live] + w < end[live]]
        return tb.mixed(_pairs(h, self.names[end - w]))

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, place, first and last window start of every anchor, in order."""
        none = np.zeros(0, np.int64)
        if len(self.names) + self.width - 1 < window:
            return none, none, none, none
        more = gram - self.width
        least = tb.mixed(_pairs(self.names[: len(self.names) - more], self.names[more:]))
        least >>= np.uint64(32)
        least <<= np.uint64(32)
        least |= np.arange(len(least), dtype=np.uint64)
        reach, width = 1, window - gram + 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # A row with e units has windows at its first e - window + 1 places.
        lengths = np.maximum(0, np.diff(self.edges) - window + 1)
        start = tb.ragged(self.edges[:-1], lengths)
        if len(start) == 0:
            return none, none, none, none
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = place[start]
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        return row[first], place[first], start[first], start[last]


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits (k1, k2) that name a row by both; equal rows share their names and results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))


def slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def in_filter(bits: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(key), bool)
    at = slot(key)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def filter_of(keys: DataFrame, column: Column, most: int = FILTER_KEYS) -> np.ndarray | None:
    """A bit for the high bits of each key, or None if there are more than `most`. What reaches the driver are
    at most 2**21 words of 64 bits."""
    keys = keys.select(column.alias("k"))
    if keys.count() > most:
        return None
    at = keys.select(F.shiftrightunsigned("k", 64 - FILTER_BITS).alias("s"))
    words = at.groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS INT)))").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    if words.num_rows:
        bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits


def place_key(k1: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A name for a place in a document."""
    return tb.mixed(k1.view(np.uint64) ^ (start.astype(np.uint64) << np.uint64(20)))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that more than one row has; counted before the shuffle, so a frequent key is one row a task."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)


def parts(batches: Iterator[pa.RecordBatch], window: int, of_words: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices of rows, their bytes and offsets, and the number of the first unit. A long text comes in parts
    which have `window` - 1 units in common, so each window begins in one part and lies in it."""
    for batch, data, offsets in tb.slices(batches):
        if len(data) <= tb.SLICE_BYTES:
            yield batch, data, offsets, 0
        elif of_words:
            base = 0
            for a, b in tb.long_parts(data, tb.NOT_SPACE, tb.SLICE_BYTES, window - 1):
                offsets = np.array([0, b - a])
                yield batch, data[a:b], offsets, base
                base += len(tb.words(data[a:b], offsets, tb.NOT_SPACE)[0]) - window + 1
        else:
            for a in range(0, len(data) - window + 1, tb.SLICE_BYTES):
                b = min(len(data), a + tb.SLICE_BYTES + window - 1)
                yield batch, data[a:b], np.array([0, b - a]), a


@dataclass
class Scan:
    """Passes over texts for repeated windows of `window` bytes or words, found by grams of `gram` units."""

    window: int
    gram: int
    of_words: bool

    def mapped(self, docs: DataFrame, columns: dict[str, str], make: Callable) -> DataFrame:
        """Rows of make(units, batch, base) over parts of docs. make gives row numbers of the slice and a dict of
        arrays; k1 and k2 of those rows come first. base: the number of the first unit in the text."""
        arrow = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(c, arrow[t]) for c, t in columns.items()])
        unit = Units.of_words if self.of_words else Units.of_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets, base in parts(batches, self.window, self.of_words):
                rows, found = make(unit(data, offsets, self.gram), batch, base)
                if len(rows):
                    at = pa.array(rows)
                    if "k1" in columns:
                        found = {"k1": batch.column("k1").take(at), "k2": batch.column("k2").take(at)} | found
                    arrays = [v if isinstance(v, pa.Array) else pa.array((v.view(np.int64) if v.dtype == np.uint64 else v).astype(schema.field(c).type.to_pandas_dtype(), copy=False)) for c, v in ((c, found[c]) for c in columns)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        return docs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in columns.items()))


SPAN = {"k1": "long", "k2": "long", "h": "long", "h2": "long", "start": "int", "end": "int"}
_SALT = 0x5851F42D4C957F2D


def named(u: Units, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """The two names of spans, 128 bits together, by which they are taken to be equal."""
    return {"h": u.spans(start, end), "h2": u.spans(start, end, _SALT)}


@dataclass
class Doubtful:
    """The places whose windows two rounds leave open, as workers find them again: by a broadcast filter or, if
    there are too many for one, by the column `marked` of docs, which holds the places of each text."""

    scan: Scan
    grams: object
    bits: object

    def at(self, u: Units, batch: pa.RecordBatch, base: int) -> tuple[np.ndarray, ...]:
        found, _ = anchors_among(u, self.scan, self.grams.value)
        row, first = found[0], found[2]
        start = first - u.edges[row] + base
        if self.bits is None:
            marked = batch.column("marked").fill_null([])
            of = np.repeat(np.arange(batch.num_rows), np.diff(marked.offsets.to_numpy()))
            some = np.flatnonzero(np.isin((row << 32) | start, (of << 32) | marked.flatten().to_numpy().astype(np.int64)))
        else:
            some = np.flatnonzero(in_filter(self.bits.value, place_key(batch.column("k1").to_numpy()[row], start)))
        return tuple(x[some] for x in found)


def anchors_among(u: Units, scan: Scan, grams: np.ndarray | None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The anchors whose gram occurs more than once (or that the filter lets pass), and their grams."""
    found = u.anchors(scan.window, scan.gram)
    key = u.spans(found[1], found[1] + scan.gram)
    some = np.flatnonzero(in_filter(grams, key))
    return tuple(x[some] for x in found), key[some]


def narrowed(docs: DataFrame, scan: Scan, most_keys: int = FILTER_KEYS) -> tuple[DataFrame, Doubtful, DataFrame]:
    """Rounds 1 and 2: anchors by their gram, and by the whole stretch of their windows.

    Returns k1, k2, start, end of the spans known to be repeated, what is still doubtful, and the docs to look
    for that in. Of each different
    stretch one place goes on, if its gram has a stretch that occurs once; it is undecided if its own
    occurs once, and else the partner of others.
    """
    spark = docs.sparkSession

    def grams(u: Units, batch: pa.RecordBatch, base: int):
        row, place, _, _ = u.anchors(scan.window, scan.gram)
        return row, {"h": u.spans(place, place + scan.gram)}

    again = written(repeated(scan.mapped(docs, {"h": "long"}, grams), "h"), "grams")
    passing = filter_of(again, F.col("h"), most_keys)
    shared = spark.sparkContext.broadcast(passing)

    def stretches(u: Units, batch: pa.RecordBatch, base: int):
        (row, _, first, last), key = anchors_among(u, scan, shared.value)
        base = u.edges[row] - base
        return row, named(u, first, last + scan.window) | {"g": key, "start": first - base, "end": last + scan.window - base}

    found = scan.mapped(docs, SPAN | {"g": "long"}, stretches)
    if passing is None:
        found = found.join(again.withColumnRenamed("h", "g"), "g", "left_semi")
    found = written(found, "stretches")
    dropped(spark, again)
    one_each = written(found.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "g")).alias("at")).select("h", "h2", "n", "at.*"), "places")
    undecided = one_each.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    left = written(one_each.join(undecided, "g", "left_semi").select("k1", "k2", "start"), "doubtful")
    whole = written(found.join(one_each.filter("n > 1"), ["h", "h2"], "left_semi").select("k1", "k2", "start", "end"), "whole")
    dropped(spark, found)
    dropped(spark, one_each)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = place_key(b.column("k1").to_numpy(), b.column("start").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["h"])

    bits = filter_of(left.select("k1", "start").mapInArrow(keys, "h long"), F.col("h"), most_keys)
    if bits is None:
        docs = docs.join(left.groupBy("k1", "k2").agg(F.collect_set("start").alias("marked")), ["k1", "k2"])
    return whole, Doubtful(scan, shared, None if bits is None else spark.sparkContext.broadcast(bits)), docs


def blocks_of(u: Units, found: tuple[np.ndarray, ...], window: int, block: int) -> tuple[np.ndarray, ...]:
    """For each block of windows of the given anchors: row, the block's first and last window start, those of
    its windows that the anchor owns, a name of the string common to all and two of the string that covers
    all (0 where that would leave the part). Equal windows are in blocks of the same common string."""
    row, place, first, last = found
    low, high = (place - last) // block, (place - first) // block
    of = np.repeat(np.arange(len(row)), high - low + 1)
    k = tb.ragged(low, high - low + 1)
    left, right = place[of] - (k * block + block - 1), place[of] - k * block
    # The block's number is part of its name: two anchors of a document may have the same string as a block.
    number = tb.mixed(k.astype(np.uint64) + np.uint64(1))
    core = tb.mixed(u.spans(right, left + window) ^ number)
    inside = (left >= u.edges[row[of]]) & (right + window <= u.edges[row[of] + 1])
    cover = [np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)]
    for whole, name in zip(cover, named(u, left[inside], right[inside] + window).values(), strict=True):
        whole[inside] = tb.mixed(name ^ number[inside])
    return row[of], left, right, np.maximum(left, first[of]), np.minimum(right, last[of]), core, *cover


def collected(spans: DataFrame) -> DataFrame:
    """k1, k2 and all spans of a row; a document has no more spans than units."""
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal runs of each row's spans."""
    spans = spans.fill_null([])
    flat = spans.flatten()
    row = np.repeat(np.arange(rows), np.diff(spans.offsets.to_numpy()))
    start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if len(row) == 0:
        return row, start, end
    shift = row * (int(end.max()) + 2)  # rows stand apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(row), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - shift[first]
