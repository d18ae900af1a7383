"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.tokens import Pieces, TreeEncoder, byte_table, parts


@lru_cache(2)
def _pieces(path: str, workers: int) -> Pieces:
    return Pieces(TreeEncoder(path, workers=workers))


def _cores(docs: DataFrame) -> int:
    """The cores that a task of this session has."""
    return int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))


@lru_cache(2)
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = byte_table(path)
    lengths = np.fromiter(map(len, table), np.int64, len(table))
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


def _list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def _encoded(tokenizer: str, batches: Iterator[pa.RecordBatch], slice_bytes: int, workers: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For slices of rows: doc_id, the ids of all texts, and how many each has."""
    known = _pieces(tokenizer, workers)
    for batch, data, offsets in tb.slices(batches, most=slice_bytes):
        ids, lengths = [np.zeros(0, np.int32)], np.zeros(batch.num_rows, np.int64)
        for piece, edges, rows in parts(data, offsets, slice_bytes):
            slots, at = known.slots(piece, edges)
            ids.append(known.ids[tb.ragged(known.start[slots], known.length[slots])])
            row = np.searchsorted(edges, at, side="right") - 1
            lengths[rows] += np.bincount(row, weights=known.length[slots], minlength=len(rows)).astype(np.int64)
        yield batch.column("doc_id"), np.concatenate(ids), lengths


def _decoded(tokenizer: str, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    table, start, length = _decoder(tokenizer)
    raw = table[tb.ragged(start[ids], length[ids])].tobytes()
    ends = np.concatenate(([0], np.cumsum(length[ids])))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())


def encode(docs: DataFrame, tokenizer: str, slice_bytes: int = tb.SLICE_BYTES) -> DataFrame:
    """doc_id and ids (array of int): the byte-level BPE ids of every whole text, in order.

    tokenizer: a tokenizers JSON file with a ByteLevel pre-tokenizer that every worker can open. The ids are
    those of the library with add_special_tokens=False; special strings inside texts give their own ids.
    Distinct pieces are encoded once; unsplit text longer than a leaf goes by tree concatenation
    (tokens.TreeEncoder). Null and empty texts give an empty array; a null doc_id stays null; repeated rows
    each give a row; other columns are not read. There is no shuffle. A task encodes with as many threads as
    spark.task.cpus gives it.
    """
    workers = _cores(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, lengths in _encoded(tokenizer, batches, slice_bytes, workers):
            yield pa.RecordBatch.from_arrays([doc_id, _list_array(ids, lengths)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded of the rows of encode(): the text of the ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD as in the library. Null and empty arrays give an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("ids").fill_null([])
                ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, _decoded(tokenizer, ids, np.diff(column.offsets.to_numpy()))], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_decode(docs: DataFrame, tokenizer: str, slice_bytes: int = tb.SLICE_BYTES) -> DataFrame:
    """doc_id, ids and decoded of every text, in one pass: encode() and then decode() of the ids it gave."""
    workers = _cores(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, lengths in _encoded(tokenizer, batches, slice_bytes, workers):
            yield pa.RecordBatch.from_arrays([doc_id, _list_array(ids, lengths), _decoded(tokenizer, ids, lengths)], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
