"""Arrow text batches as flat byte arrays: slices of bounded size, words, and their hashes in numpy.

Bytes above 0x7F are never separators in any of the word classes used here, so all of it works on UTF-8
bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by one Python worker; numpy work arrays take about 50 times as much.
SLICE_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_GOLDEN = 0x9E3779B97F4A7C15
#: What is left of eight bytes of which the first n count.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words above this many bytes are hashed one by one.
_LONG_WORD = 1 << 10


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _FOLD[data]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows holding at most `most` bytes of text (a longer text comes alone), with bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every maximal run of word bytes within a row."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place (and the end) on as one number; past the end are zeros."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, folded: bool = False) -> np.ndarray:
    """64-bit names of the spans [start, end), equal for equal bytes; folded: with A-Z in lower case.

    Eight bytes at a time are mixed in by a bijection, so spans of one length up to eight bytes never share a
    name, and no pattern of longer ones does by its form.
    """
    if folded:
        data = _FOLD[data]
    view, left = eights(data), end - start
    out = mixed(left.astype(np.uint64) * np.uint64(_GOLDEN))
    if len(out) == 0:
        return out
    out = mixed(out ^ (view[start] & _FIRST[np.minimum(left, 8)]))
    live = np.flatnonzero((left > 8) & (left <= _LONG_WORD))
    at, left = start[live] + 8, left[live] - 8
    while len(live):
        out[live] = mixed(out[live] ^ (view[at] & _FIRST[np.minimum(left, 8)]))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(end - start > _LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Names of n consecutive words by their hashes, one for each first word up to len - n."""
    count = max(0, len(word) - n + 1)
    total = np.full(count, n * _GOLDEN % (1 << 64), np.uint64)
    for j in range(n):
        total = mixed(total ^ word[j : j + count])
    return total


def long_parts(data: np.ndarray, is_word: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of a text of any length that hold whole words, about `most` bytes each. The last `overlap` words
    of a span are the first of the next, so each run of overlap + 1 words begins in one span and lies in it."""
    at = 0
    while True:
        step = most
        while True:
            if at + step >= len(data):
                yield at, len(data)
                return
            gaps = np.flatnonzero(~is_word[data[at : at + step]])
            if len(gaps):
                to = at + int(gaps[-1])
                start = words(data[at:to], np.array([0, to - at]), is_word)[0]
                if len(start) > overlap:
                    break
            step *= 2
        yield at, to
        at = to if overlap == 0 else at + int(start[len(start) - overlap])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the ranges [starts, starts + lengths), one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def row_counts(row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, minlength=rows).astype(np.int64)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of 0..n-1 lie in any of the ranges [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0
