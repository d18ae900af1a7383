"""Substrings of documents that occur more than once, by distributed prefix doubling over sampled positions.

Plain prefix doubling ranks every position by ever longer prefixes: the rank of 2h units is the rank of a
pair of ranks of h units. Sorting all positions of a corpus a few times is beyond any sensible budget of
disk, so ranks are names: the name of 2h bytes at a position is made of the pair of names of h bytes at
offsets h apart, for every position, from 8 to 64 bytes; equal strings have equal names without a sort.
What is shuffled, and so reranked until it is unique or past the threshold, are sampled positions (repeats.py):

- Round 1 ranks the anchors by their gram (64). Unique ones are out: no window of theirs is repeated.
- Round 2 ranks what is left by the whole stretch of the anchor's windows (200 to 336), past the threshold.
  If that is repeated, all its windows are. One place of each different stretch goes on, if the gram has a
  stretch that is not repeated.
- Round 3 halves the question, as doubling would near its end: for blocks of neighbouring windows it ranks
  the string common to all (if unique, none is repeated) and the string that covers all.
- Round 4 ranks the single windows of blocks that are still undecided.

A round reads the texts again instead of shuffling them; what the former round left undecided comes to it as
a bit filter of fixed size or, if it would be too full, by a join. Texts are shuffled once, at the end, to meet the spans to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.repeats import FILTER_KEYS, SPAN, Scan, Units, blocks_of, collected, filter_of, in_filter, merged, named, narrowed, repeated, row_keys
from logloom.llm.shared import dropped, written


def repeated_spans(docs: DataFrame, window: int = 200, gram: int = 64, block: int = 12, most_keys: int = FILTER_KEYS) -> DataFrame:
    """k1, k2 (row_keys), spans: array of (start, end) in bytes, overlapping or not, whose union is covered by
    repeated windows. docs: the result of row_keys()."""
    broadcast, scan = docs.sparkSession.sparkContext.broadcast, Scan(window, gram, False)
    block = min(block, window - gram + 1)  # what all windows of a block share is a gram at least
    whole, doubtful, left = narrowed(docs.filter(F.octet_length("text") >= window), scan, most_keys)

    def blocks(u: Units, batch: pa.RecordBatch, base: int):
        row, left, right, _, _, core, cover, cover2 = blocks_of(u, doubtful.at(u, batch, base), window, block)
        base = u.edges[row] - base
        return row, {"h": cover, "h2": cover2, "core": core, "start": left - base, "end": right + window - base}

    three = written(scan.mapped(left, SPAN | {"core": "long"}, blocks), "blocks")
    again = written(repeated(three.filter("h <> 0"), "h", "h2"), "again")
    open_blocks = three.join(again, ["h", "h2"], "left_anti").join(repeated(three, "core"), "core", "left_semi")
    cores = broadcast(filter_of(open_blocks.select("core").distinct(), F.col("core"), most_keys))
    halves = written(three.join(again, ["h", "h2"], "left_semi").select("k1", "k2", "start", "end"), "parts")
    dropped(docs.sparkSession, three)

    def singles(u: Units, batch: pa.RecordBatch, base: int):
        row, _, _, first, last, core, _, _ = blocks_of(u, doubtful.at(u, batch, base), window, block)
        some = np.flatnonzero(in_filter(cores.value, core))
        n = last[some] - first[some] + 1
        start, of = tb.ragged(first[some], n), np.repeat(row[some], n)
        base = u.edges[of] - base
        return of, named(u, start, start + window) | {"start": start - base, "end": start + window - base}

    four = written(scan.mapped(left, SPAN, singles), "windows")
    last = four.join(repeated(four, "h", "h2"), ["h", "h2"], "left_semi").select("k1", "k2", "start", "end")
    return collected(whole.unionByName(halves).unionByName(last))


def drop_repeated_substrings(docs: DataFrame, window: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document.

    Every byte of a whole text (UTF-8) goes that lies in a string of `window` bytes which also starts
    anywhere else, in the same document or another; matches never cross documents, overlaps count, and
    strings are judged on the input. n_spans counts the maximal removed runs. kept is what is left, and may
    not be UTF-8, since a run can end inside a character.
    Null and empty texts have no bytes; a null doc_id stays null; repeated rows are occurrences of their own
    and each gives a row; other columns are not read; no rows in, no rows out. Strings are taken to be equal
    by two names of 64 bits. Long texts are worked off in parts.
    """
    keyed = row_keys(docs)
    spans = repeated_spans(keyed, window, gram)
    joined = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tb.slices(batches):
            n = batch.num_rows
            row, start, end = merged(batch.column("spans"), n)
            removed = np.bincount(row, weights=end - start, minlength=n).astype(np.int64)
            # What stays are the gaps between removed runs.
            first = np.searchsorted(row, np.arange(n + 1)).tolist()
            left, right, raw, kept = (start + offsets[row]).tolist(), (end + offsets[row]).tolist(), data.tobytes(), []
            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                cuts = slice(first[r], first[r + 1])
                kept.append(b"".join(raw[x:y] for x, y in zip([a, *right[cuts]], [*left[cuts], b], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(tb.row_counts(row, n)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
