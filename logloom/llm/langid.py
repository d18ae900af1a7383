"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb

#: Rows that a model is fitted on at most (about: rows are chosen by a hash of their id).
MOST_ROWS = 50_000
#: Cells that a model has at most; it is broadcast, with 4 bytes each. With more than 128 languages there are
#: fewer buckets for their n-grams.
MOST_CELLS = 1 << 23

#: Text bytes judged at once: every character gives three buckets and as many sums for each language.
SLICE_BYTES = 1 << 19

_BITS = 16
_SIZES = (1, 2, 3)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Lower case of the characters below U+10000 that have one of a single character.
_FOLD = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(1 << 16)], np.uint64)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 text, in lower case, and row edges among them."""
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        return _FOLD[data], offsets
    length = np.minimum(np.diff(np.append(at, len(data))), 4)
    code = (data[at] & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint8)[length]).astype(np.uint64)
    for j in range(1, 4):
        more = np.flatnonzero(length > j)
        code[more] = (code[more] << np.uint64(6)) | (data[at[more] + j] & 0x3F).astype(np.uint64)
    low = code < len(_FOLD)
    code[low] = _FOLD[code[low].astype(np.int64)]
    return code, np.concatenate(([0], np.cumsum(lead)))[offsets]


def gram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int, starts: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the bucket of every n-gram of characters (in lower case) inside a row, and row edges.
    starts: only n-grams at the first so many characters."""
    code, offsets = characters(data, offsets)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(code))
    packed = np.zeros(len(code), np.uint64)
    for n in range(1, max(_SIZES) + 1):
        packed = (packed[: len(code) - n + 1] << np.uint64(21)) | code[n - 1 :]
        if n in _SIZES and len(packed):
            inside = left[: len(packed)] >= n
            if starts is not None:
                inside[starts:] = False
            keys = tb.mixed(packed[inside] ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)
            edges = np.concatenate(([0], np.cumsum(inside)))[np.minimum(offsets, len(packed))]
            yield keys.astype(np.int64), edges


def grams_in_parts(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As gram_buckets(), but a long text comes in parts: what its rows add up to is the same."""
    if len(offsets) > 2 or len(data) <= SLICE_BYTES:
        yield from gram_buckets(data, offsets, bits)
        return
    at, more = 0, max(_SIZES) - 1
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        reach = end + 4 * more  # as many characters behind the part as an n-gram may need
        while reach < len(data) and data[reach] & 0xC0 == 0x80:
            reach += 1
        part = data[at:reach]
        yield from gram_buckets(part, np.array([0, len(part)]), bits, len(characters(data[at:end], np.array([0, end - at]))[0]))
        at = end


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i + 1]] along the first axis; 0 where that is empty."""
    out = np.zeros((len(edges) - 1, *values.shape[1:]))
    full = np.flatnonzero(edges[1:] > edges[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, edges[:-1][full], axis=0, dtype=np.float64)
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found, full = np.zeros(len(offsets) - 1, bool), np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        found[full] = np.logical_or.reduceat(_LETTERS[data], offsets[:-1][full])
    for r in np.flatnonzero(~found):
        found[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    languages: list[str]
    #: Log probability of each bucket (rows) in each language, and of the languages.
    grams: np.ndarray
    priors: np.ndarray
    bits: int = _BITS


def fit(docs: DataFrame, learnable: Column, most_rows: int = MOST_ROWS, smoothing: float = 0.5) -> Model:
    """A model of the non-null `lang` of the rows for which `learnable` holds, over whole texts.

    Of more than most_rows such rows about most_rows are taken, by a hash of doc_id. Each task adds up its
    rows, so what is summed by language and bucket doesn't grow with the texts. There is no limit on languages.
    """
    labelled = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    total = labelled.count()
    if total > most_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(most_rows / total * (1 << 30)))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages, bits = sorted(sizes), _BITS
    while len(languages) << bits > MOST_CELLS and bits > 4:
        bits -= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << bits), np.int64)
        code = {name: i for i, name in enumerate(languages)}
        for batch, data, offsets in tb.slices(batches, most=SLICE_BYTES):
            row_lang = np.array([code[x] for x in batch.column("lang").to_pylist()])
            for keys, edges in grams_in_parts(data, offsets, bits):
                cell, n = np.unique((np.repeat(row_lang, np.diff(edges)) << bits) | keys, return_counts=True)
                counts.reshape(-1)[cell] += n
        lang, bucket = np.nonzero(counts)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], ["lang", "bucket", "n"])

    summed = labelled.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((1 << bits, len(languages)), smoothing)
    counts[summed.column("bucket").to_numpy(), summed.column("lang").to_numpy()] += summed.column("n").to_numpy()
    sizes_now = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(sizes_now / max(1.0, sizes_now.sum())), bits)


def _judge(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each row (-1: none) and its posterior."""
    rows, n_lang = len(offsets) - 1, len(model.languages)
    if n_lang == 0:
        return np.full(rows, -1), np.zeros(rows)
    totals = np.tile(model.priors, (rows, 1))
    for keys, edges in grams_in_parts(data, offsets, model.bits):
        for at in range(0, n_lang, 8):  # a few columns at a time bound the memory
            totals[:, at : at + 8] += row_sums(np.ascontiguousarray(model.grams[:, at : at + 8])[keys], edges)
    known = has_letter(data, offsets)
    score = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(known, totals.argmax(axis=1), -1), np.where(known, score, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row: the likeliest language of the whole text and its posterior.
    Long texts are worked off in parts.

    Null texts and those without a letter, and all texts if the model has no language, are `und` with score
    0. Ties go to the language that sorts first. Only doc_id and text are read; there is no shuffle. Repeated
    rows each give a row, and a null doc_id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [*model.languages, "und"]
        for batch, data, offsets in tb.slices(batches, most=SLICE_BYTES):
            best, score = _judge(model, data, offsets)
            pred = [names[b] for b in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Whether a document is kept from the fit: crc32 of its doc_id as text is divisible by 5 (null: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score by a model of the rows of docs that have a doc_id and aren't held out.
    Columns besides doc_id, text and lang are not read; no rows in, no rows out."""
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose text has a letter and a likeliest language with at least
    least_score. Fitted as in identify(); rows without doc_id are judged by their text like all others; other
    columns, whatever their names, go through. Where no row has a language to learn from, none is kept; no rows in,
    no rows out."""
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, offsets in tb.slices(batches, most=SLICE_BYTES):
            best, score = _judge(model, data, offsets)
            keep = (best >= 0) & (score >= least_score)
            yield batch.filter(pa.array(keep)).select(columns)

    return docs.mapInArrow(run, docs.schema)
