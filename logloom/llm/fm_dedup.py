"""Word substrings that occur more than once, by compressed FM-indexes.

Every document against an index of the whole corpus would take documents times shards. So the first two
rounds of repeats.py settle most of the corpus, and what is doubtful is dealt to shards by the string that
all windows of a block have in common: a window and all its occurrences meet in one shard. Each shard builds
a compressed FM-index over its passages and streams them through it: backward search over a wavelet matrix
gives, for each end, how far back the match statistic of the passage reaches while it occurs twice. A string
whose passages alone are more than a shard is meant to hold would make a shard that can't be split; their
windows are counted under their names instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.repeats import FILTER_KEYS, SPAN, Scan, Units, blocks_of, collected, filter_of, in_filter, merged, named, narrowed, repeated, row_keys
from logloom.llm.shared import written

#: Words a shard's index is meant to hold.
SHARD_WORDS = 1 << 19


class FMIndex:
    """Counts of patterns in a collection of passages.

    The Burrows-Wheeler transform of the passages, each ended by symbol 0, is kept as a wavelet matrix: a bit
    vector for each bit of the symbols, packed, with the ones before each word of 64 bits. Suffixes are
    sorted by their first `depth` symbols (prefix doubling), enough for patterns of that length.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while True:
            second = np.zeros(n, np.int64)
            second[: n - reach] = rank[reach:] + 1 if reach < n else 0
            key = rank * (n + symbols + 2) + second
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.ones(n, np.int64)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            reach *= 2
            if reach >= depth or rank[order[-1]] == n - 1:
                break
        seq = text[order - 1]
        self.n, self.first = n, np.searchsorted(text[order], np.arange(symbols + 1))
        self.bits: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.levels = max(1, int(symbols - 1).bit_length())
        for level in range(self.levels - 1, -1, -1):
            ones = (seq >> level) & 1 == 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed))))[:-1].astype(np.int32)
            self.bits.append((packed, before, n - int(ones.sum())))
            seq = np.concatenate((seq[~ones], seq[ones]))
        self.base = self.down(np.arange(symbols), np.zeros(symbols, np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the transform lands on the lowest level on the path of the symbol."""
        for level, (packed, before, zeros) in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & low)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + pattern from that of the pattern: one step of backward search."""
        both = self.down(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift


def repeated_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage and offset of every window of the passages text[start : start + length] that occurs twice.

    All passages go in step. First the longest end of each that occurs twice is found; the windows inside it
    do too. Then windows are tried from the left: if the search back from the end of window s breaks off at
    j, no window that reaches from j or before to that end occurs twice, so j + 1 is next.
    """
    none = np.zeros(0, np.int64)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(length >= window)
    rest = length[live] - window + 1
    lo, hi, j = np.zeros(len(live), np.int64), np.full(len(live), index.n), length[live] - 1
    going = np.arange(len(live))
    while len(going):
        p = live[going]
        a, b = index.back(text[start[p] + j[going]], lo[going], hi[going])
        ok = b - a >= 2
        lo[going], hi[going] = a, b
        j[going[ok]] -= 1
        going = going[ok & (j[going] >= 0)]
    inner = np.minimum(rest, j + 1)
    hits.append((np.repeat(live, rest - inner), tb.ragged(inner, rest - inner)))
    some = np.flatnonzero(inner > 0)
    live, rest = live[some], inner[some]
    s = np.zeros(len(live), np.int64)
    lo, hi, j = np.zeros(len(live), np.int64), np.full(len(live), index.n), s + window - 1
    while len(live):
        a, b = index.back(text[start[live] + j], lo, hi)
        ok = b - a >= 2
        whole = ok & (j == s)
        hits.append((live[whole], s[whole]))
        s = np.where(whole, s + 1, np.where(ok, s, j + 1))
        fresh = whole | ~ok
        j = np.where(fresh, s + window - 1, j - 1)
        lo, hi = np.where(fresh, 0, a), np.where(fresh, index.n, b)
        keep = s < rest
        if not keep.all():
            live, rest, s, lo, hi, j = live[keep], rest[keep], s[keep], lo[keep], hi[keep], j[keep]
    return (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])) if hits else (none, none)


_PASSAGE = {"k1": "long", "k2": "long", "h": "long", "start": "int", "words": "array<long>"}


def _searched(passages: DataFrame, window: int) -> DataFrame:
    """k1, k2, start, end of the repeated windows of passages, for each shard (partition) by its FM-index."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64()))]))
        if table.num_rows < 2:
            return
        lists = table.column("words").combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        known, symbol = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        # Each passage is followed by one 0.
        start = np.cumsum(length + 1) - (length + 1)
        text = np.zeros(len(symbol) + len(length), np.int64)
        text[tb.ragged(start, length)] = symbol + 1
        index = FMIndex(text, len(known) + 1, int(length.max()))
        passage, offset = repeated_windows(index, text, start, length, window)
        if len(passage):
            at = table.column("start").to_numpy()[passage] + offset
            yield pa.RecordBatch.from_arrays(
                [table.column("k1").combine_chunks().take(pa.array(passage)), table.column("k2").combine_chunks().take(pa.array(passage)), pa.array(at.astype(np.int32)), pa.array((at + window).astype(np.int32))], ["k1", "k2", "start", "end"]
            )

    return passages.mapInArrow(search, "k1 long, k2 long, start int, end int")


def _counted(passages: DataFrame, window: int) -> DataFrame:
    """The rows of _searched(), by counting every window under its name: pre-aggregated, so of any frequency."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("words")
                edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                u = Units.of_hashes(lists.flatten().to_numpy().view(np.uint64), edges, window)
                n = np.maximum(0, np.diff(edges) - window + 1)
                at, row = tb.ragged(edges[:-1], n), np.repeat(np.arange(batch.num_rows), n)
                name = named(u, at, at + window)
                start = batch.column("start").to_numpy()[row] + at - edges[row]
                arrays = [batch.column("k1").take(pa.array(row)), batch.column("k2").take(pa.array(row)), *(pa.array(x.view(np.int64)) for x in name.values()), *(pa.array(x.astype(np.int32)) for x in (start, start + window))]
                yield pa.RecordBatch.from_arrays(arrays, list(SPAN))

    each = written(passages.mapInArrow(windows, ", ".join(f"{c} {t}" for c, t in SPAN.items())), "windows")
    return each.join(repeated(each, "h", "h2"), ["h", "h2"], "left_semi").select("k1", "k2", "start", "end")


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = 12, block: int = 8, shard_words: int = SHARD_WORDS, most_keys: int = FILTER_KEYS) -> DataFrame:
    """k1, k2 (row_keys), spans: array of (start, end) in words whose union is covered by repeated windows."""
    broadcast, scan = docs.sparkSession.sparkContext.broadcast, Scan(window, gram, True)
    block = min(block, window - gram + 1)  # what all windows of a block share is a gram at least
    whole, doubtful, left = narrowed(docs.filter(F.octet_length("text") >= 2 * window - 1), scan, most_keys)

    def cores(u: Units, batch: pa.RecordBatch, base: int):
        row, _, _, _, _, core, _, _ = blocks_of(u, doubtful.at(u, batch, base), window, block)
        return row, {"h": core}

    common = broadcast(filter_of(repeated(scan.mapped(left, {"h": "long"}, cores), "h"), F.col("h"), most_keys))

    def passages(u: Units, batch: pa.RecordBatch, base: int):
        row, _, _, first, last, core, _, _ = blocks_of(u, doubtful.at(u, batch, base), window, block)
        some = np.flatnonzero(in_filter(common.value, core))
        row, first, last, core = row[some], first[some], last[some], core[some]
        length = last + window - first
        words = u.word[tb.ragged(first, length)].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(words))
        return row, {"h": core, "start": first - u.edges[row] + base, "words": lists}

    dealt = written(scan.mapped(left, _PASSAGE, passages), "passages")
    sizes = dealt.groupBy("h").agg(F.sum(F.size("words")).alias("n"))
    frequent = written(sizes.filter(F.col("n") > shard_words).select("h"), "frequent")
    rare = dealt.join(frequent, "h", "left_anti").select(*_PASSAGE)
    total = dealt.agg(F.sum(F.size("words"))).first()[0] or 0
    last = _searched(rare.repartition(max(1, -(-2 * total // shard_words)), "h"), window)
    if not frequent.isEmpty():
        last = last.unionByName(_counted(dealt.join(frequent, "h", "left_semi").select(*_PASSAGE), window))
    return collected(whole.unionByName(last))


def drop_repeated_word_spans(docs: DataFrame, window: int = 35, gram: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every document.

    Words stand between ASCII white space and are compared unchanged. Every word of a whole text goes that
    lies in a run of `window` words of one document which also starts anywhere else, in the same document or
    another; runs are judged on the input. kept: the other words, joined by one space.
    Null and empty texts have no words; a null doc_id stays null; repeated rows are occurrences of their own
    and each gives a row; other columns are not read; no rows in, no rows out.
    """
    keyed = row_keys(docs)
    joined = keyed.join(repeated_spans(keyed, window, gram), ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def kept_of(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Words, words that stay, and the latter joined, of each row; a and b: edges of what goes, in words."""
        n = len(offsets) - 1
        start, end, row = tb.words(data, offsets, tb.NOT_SPACE)
        base = np.searchsorted(row, np.arange(n + 1))
        stays = np.flatnonzero(~tb.covered(a + base[of], b + base[of], len(row)))
        # Copy each word that stays with one byte after it, make that a space, and leave out the last.
        length = end[stays] - start[stays] + 1
        out = np.append(data, np.uint8(0x20))[tb.ragged(start[stays], length)]
        out[np.cumsum(length) - 1] = 0x20
        sizes = np.bincount(row[stays], weights=length, minlength=n).astype(np.int64)
        edges, raw = np.concatenate(([0], np.cumsum(sizes))).tolist(), out.tobytes()
        return np.diff(base), tb.row_counts(row[stays], n), [raw[x : max(x, y - 1)] for x, y in zip(edges, edges[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tb.slices(batches):
            of, a, b = merged(batch.column("spans"), batch.num_rows)
            if len(data) <= tb.SLICE_BYTES:
                n_words, n_kept, kept = kept_of(data, offsets, of, a, b)
            else:  # one long text, in parts
                n, stay, texts = 0, 0, []
                for x, y in tb.long_parts(data, tb.NOT_SPACE, tb.SLICE_BYTES, 0):
                    part, edges = data[x:y], np.array([0, y - x])
                    here = len(tb.words(part, edges, tb.NOT_SPACE)[0])
                    low, high = np.clip(a - n, 0, here), np.clip(b - n, 0, here)
                    some = low < high
                    _, k, text = kept_of(part, edges, of[some], low[some], high[some])
                    n, stay, texts = n + here, stay + int(k[0]), [*texts, *(t for t in text if t)]
                n_words, n_kept, kept = np.array([n]), np.array([stay]), [b" ".join(texts)]
            texts = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_words - n_kept), texts], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
