"""Nearest neighbours by cosine with a permutation index: vectors as orders of their nearest pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb
from logloom.llm.shared import written

_BLOCK = "ids binary, vectors binary, edges binary, rows binary, ranks binary"


def _clean(batch: pa.RecordBatch, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (double) of the rows that take part: all of one width, finite, not all zero."""
    column = batch.column("embedding")
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    valid = ~np.array(column.is_null()) & ~np.array(batch.column("vec_id").is_null()) & (lengths > 0)
    if width is not None:
        valid &= lengths == width
    else:
        width = int(lengths[valid].max()) if valid.any() else 0
        valid &= lengths == width
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros((0, width))
    kept = lists.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    good = np.isfinite(kept).all(axis=1) & (kept != 0).any(axis=1)
    # By a power of two, which changes no cosine: squares of very large or small components stay in range.
    kept = np.ldexp(kept, -np.frexp(np.abs(kept).max(axis=1, keepdims=True))[1])
    return batch.column("vec_id").filter(pa.array(valid)).to_numpy()[good], kept[good]


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def choose_pivots(vectors: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to n different vectors out of 8 n rows with the least hashes of their ids, a bounded sample, and the
    other ones of the sample; all of length 1.

    The width of most of the sample is that of the index; other vectors take no part.
    """
    sample = vectors.filter("vec_id is not null and size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * n)
    rows = [np.array(r["embedding"], float) for r in sample.select("embedding").collect() if None not in r["embedding"]]
    rows = [r for r in rows if np.isfinite(r).all() and r.any()]
    if not rows:
        return np.zeros((0, 0)), np.zeros((0, 0))
    widths = [len(r) for r in rows]
    width = max(sorted(set(widths)), key=widths.count)
    units = _units(np.array([r for r in rows if len(r) == width]))
    _, first = np.unique(units, axis=0, return_index=True)
    units = units[np.sort(first)]
    return units[:n], units[n:]


def share_for(recall: float, pivots: np.ndarray, others: np.ndarray, prefix: int, k: int, queries: int = 128) -> float:
    """The share of vectors, by footrule distance, among which that part of the k nearest of a vector are, as
    measured by brute force on a sample; half more than that, and at least one in a hundred."""
    x = np.concatenate((others, pivots))
    if len(x) <= 4 * k:
        return 1.0
    orders = _orders(x, pivots, prefix)
    ranks = np.full((len(x), len(pivots)), prefix, np.int16)
    np.put_along_axis(ranks, orders, np.arange(prefix, dtype=np.int16)[None, :], 1)
    places = []
    for q in range(min(queries, len(x))):
        score = x @ x[q]
        score[q] = -2
        near = (prefix - np.maximum(ranks[:, orders[q]], np.arange(prefix, dtype=np.int16))).sum(axis=1, dtype=np.int64)
        near[q] = -1
        nearest = np.argpartition(-score, k - 1)[:k]
        places.append((near[:, None] > near[nearest]).sum(axis=0) + 1)
    return float(np.clip(1.5 * np.quantile(np.concatenate(places), recall) / len(x), 0.01, 1.0))


def _orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = _units(x) @ pivots.T
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def build_index(vectors: DataFrame, pivots: np.ndarray, prefix: int, block_rows: int = 4096) -> DataFrame:
    """A row for each block of vectors: their ids and values, and inverted files: for each pivot, the rows of
    the block that have it among their `prefix` nearest, and its rank there."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def block(ids: np.ndarray, x: np.ndarray) -> list[bytes]:
        orders = _orders(x, shared.value, prefix)
        flat = orders.reshape(-1)
        by_pivot = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[by_pivot], np.arange(len(shared.value) + 1))
        return [ids.tobytes(), x.tobytes(), edges.tobytes(), (by_pivot // prefix).astype(np.int32).tobytes(), (by_pivot % prefix).astype(np.int16).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shared.value.shape[1]
        ids, x = np.zeros(0, np.int64), np.zeros((0, width))
        names = ["ids", "vectors", "edges", "rows", "ranks"]
        for batch in batches:
            if batch.num_rows:
                more_ids, more = _clean(batch, width)
                ids, x = np.concatenate((ids, more_ids)), np.concatenate((x, more))
                while len(ids) >= block_rows:
                    yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, block(ids[:block_rows], x[:block_rows]), strict=True)})
                    ids, x = ids[block_rows:], x[block_rows:]
        if len(ids):
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, block(ids, x), strict=True)})

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, _BLOCK)


def _search_block(q_ids: np.ndarray, q: np.ndarray, orders: np.ndarray, row: dict, k: int, share: float, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    edges, rows = np.frombuffer(row["edges"], np.int64), np.frombuffer(row["rows"], np.int32)
    ranks = np.frombuffer(row["ranks"], np.int16).astype(np.int32)
    norms, prefix = np.sqrt((x * x).sum(axis=1)), orders.shape[1]
    # Rows by vec_id; a vec_id is a candidate with all its rows, so copies take no one else's place.
    by_id = np.argsort(ids, kind="stable")
    distinct, of = np.unique(ids, return_inverse=True)
    repeats = len(distinct) < len(ids)
    heads = np.searchsorted(ids[by_id], distinct)
    want = max(least, int(np.ceil(share * len(distinct))))
    for i in range(len(q_ids)):
        if want < len(distinct):
            # Footrule distance of the two prefixes is a constant less twice this sum over shared pivots.
            first = edges[orders[i]]
            n = edges[orders[i] + 1] - first
            posted = tb.ragged(first, n)
            near = np.bincount(rows[posted], weights=prefix - np.maximum(np.repeat(np.arange(prefix), n), ranks[posted]), minlength=len(ids))
            best_of = np.maximum.reduceat(near[by_id], heads) if repeats else near
            bar = np.partition(best_of, len(distinct) - want)[len(distinct) - want]
            some = np.flatnonzero(((best_of[of] if repeats else near) >= bar) & (ids != q_ids[i]))
        else:
            some = np.flatnonzero(ids != q_ids[i])
        if len(some):
            # Row by row in one order of summation, so equal vectors have equal scores.
            score = (x[some] * q[i]).sum(axis=1) / (norms[some] * np.sqrt((q[i] * q[i]).sum()))
            best = np.lexsort((ids[some], -score))
            if repeats:
                best = best[np.sort(np.unique(ids[some][best], return_index=True)[1])]
            best = best[:k]
            yield int(q_ids[i]), ids[some][best], score[best]


def search(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = 1024, prefix: int = 64, recall: float = 0.97, least: int = 32, query_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, its k nearest other rows found.

    vectors: vec_id and embedding. Nearness is the cosine in double precision; ties go to the smaller vec_id.
    All rows are indexed, by pivots of a sample of 8 n_pivots rows. From the lists of a query's pivots each
    block of the index has the footrule distances of its vec_ids; a share of these, the nearest (at least
    `least`, and all ties), are ranked by their cosine, with all their rows. The share is that by which
    `recall` of the k nearest are found in the sample (share_for): it is small where vectors form groups, and
    can't be where they don't. Each block gives its k best vec_ids. Vectors that are null, zero, of another
    width than most, or hold a null or non-finite component take no part, nor do rows without vec_id. Rows with
    the vec_id of a query are its own; a vec_id that is repeated counts once, by its best score, and rows that
    repeat the vec_id of a query ask once, by the first of their vectors in order. Other columns are not read;
    no rows in, no rows out.

    Queries are collected and broadcast in blocks of about query_block; each block scans the index once, and
    nothing else of the vectors moves.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    pivots, others = choose_pivots(vectors, n_pivots)
    if len(pivots) == 0:
        found = spark.createDataFrame([], schema)
    else:
        prefix = min(prefix, len(pivots))
        share = share_for(recall, pivots, others, prefix, k)
        index = written(build_index(vectors, pivots, prefix), "pivots")
        asked = vectors.filter(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        blocks = max(1, -(-asked.count() // query_block))
        found = None
        for b in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
            parts = [_clean(x, pivots.shape[1]) for x in rows.to_batches() if x.num_rows]
            ids = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
            q = np.concatenate([np.zeros((0, pivots.shape[1])), *[p[1] for p in parts]])
            order = np.lexsort((*q.T[::-1], ids))
            ids, first = np.unique(ids[order], return_index=True)
            q = q[order][first]
            shared = spark.sparkContext.broadcast((ids, q, _orders(q, pivots, prefix) if len(q) else np.zeros((0, prefix), int)))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, q, orders = shared.value
                for batch in batches:
                    for row in batch.to_pylist():
                        hits = list(_search_block(ids, q, orders, row, k, share, least))
                        if hits:
                            of = np.repeat([h[0] for h in hits], [len(h[1]) for h in hits])
                            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate([h[1] for h in hits])), pa.array(np.concatenate([h[2] for h in hits]))], ["query_id", "vec_id", "score"])

            part = index.repartition(F.xxhash64(F.substring("ids", 1, 8))).mapInArrow(run, schema)
            found = part if found is None else found.unionByName(part)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
