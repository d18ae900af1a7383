"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.tokens import PlainEncoder, Pieces, parts


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    return Pieces(PlainEncoder(path, spaced=False), ids=False)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, slice_bytes: int = tb.SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    tokenizer: a tokenizers JSON file that every worker can open, with the pre-tokenizer of word_bpe_49k.json. Special strings inside texts are special
    tokens, as the library has it. Batches are cut by bytes, and texts longer than slice_bytes are encoded
    part by part at safe boundaries (tokens.chunk_starts): white space, and East Asian stops before letters. A
    longer stretch without any of them is one part, and the library holds it whole. A worker remembers pieces
    up to a number of bytes (tokens.REMEMBERED). Only lengths leave the worker. There is no shuffle.
    Null and empty texts have 0 bytes and tokens; a null doc_id stays null; repeated rows each give a row;
    columns besides doc_id and text are not read, so their names can't clash; no rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(tokenizer)
        for batch, data, offsets in tb.slices(batches, most=slice_bytes):
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for piece, edges, rows in parts(data, offsets, slice_bytes):
                slots, at = known.slots(piece, edges)
                row = np.searchsorted(edges, at, side="right") - 1
                n_tokens[rows] += np.bincount(row, weights=known.length[slots], minlength=len(rows)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
