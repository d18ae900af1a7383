"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textbatch as tb

#: Rated documents that a model is fitted on at most (about: they are chosen by a hash of doc_id).
MOST_ROWS = 12_288
#: Hashed words; after them come the shapes of three characters, and word-statistics in bins.
_WORD_BITS = 16
_KINDS = np.full(256, 5, np.int64)
_KINDS[0x30:0x3A], _KINDS[0x41:0x5B], _KINDS[0x61:0x7B], _KINDS[0x80:] = 2, 0, 1, 1
_KINDS[tb.SPACES] = 3
_KINDS[[0x2E, 0x2C]] = 4
_SHAPES, _BINS = 6**3, 16
#: Shares of the least penalty that keeps all weights at 0.
_PENALTIES = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
_WIDTH = (1 << _WORD_BITS) + _SHAPES + 3 * _BINS


def _counted(data: np.ndarray, offsets: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of the distinct words in one number; counts of shapes, words and bytes in words by row. Of
    words and shapes those that begin before `reach`."""
    rows = len(offsets) - 1
    start, end, row = tb.words(data[:reach], np.minimum(offsets, reach), tb.ALNUM)
    key = (tb.word_hashes(data[:reach], start, end, folded=True) >> np.uint64(64 - _WORD_BITS)).astype(np.int64)
    kind = _KINDS[data]
    shape = (kind[:-2] * 36 + kind[1:-1] * 6 + kind[2:])[:reach] if len(data) > 2 else np.zeros(0, np.int64)
    at = np.arange(len(shape))
    of = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[of + 1]
    counts = np.bincount(of[inside] * _SHAPES + shape[inside], minlength=rows * _SHAPES).reshape(rows, _SHAPES)
    return np.unique((row << _WORD_BITS) | key), counts, tb.row_counts(row, rows), np.bincount(row, weights=end - start, minlength=rows)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the features of all texts, by row.

    The distinct words of a text (bucket of their hash, A-Z in lower case), each n**-0.25 for n of them; the
    square roots of the shares of its shapes of three characters; and bins of the number of words, of the
    share of distinct words, and of the mean length. A long text is worked off in parts.
    """
    rows = len(offsets) - 1
    if rows == 1 and len(data) > tb.SLICE_BYTES:
        pair, counts, n, length = np.zeros(0, np.int64), 0, 0, 0
        for a, b in tb.long_parts(data, tb.ALNUM, tb.SLICE_BYTES, 0):
            more = _counted(data[a : b + 2], np.array([0, min(len(data), b + 2) - a]), b - a)
            pair, counts, n, length = np.union1d(pair, more[0]), counts + more[1], n + more[2], length + more[3]
    else:
        pair, counts, n, length = _counted(data, offsets, len(data))
    word_row, word = pair >> _WORD_BITS, pair & ((1 << _WORD_BITS) - 1)
    distinct = tb.row_counts(word_row, rows)
    shape_row, shape = np.nonzero(counts)
    share = np.sqrt(counts[shape_row, shape] / np.maximum(1, counts.sum(axis=1))[shape_row])
    bins = [
        np.minimum(_BINS - 1, np.log2(1 + n)).astype(np.int64),
        np.minimum(_BINS - 1, _BINS * distinct / np.maximum(1, n)).astype(np.int64),
        np.minimum(_BINS - 1, length / np.maximum(1, n)).astype(np.int64),
    ]
    base = (1 << _WORD_BITS) + _SHAPES
    all_rows = np.concatenate([word_row, shape_row, *[np.arange(rows)] * 3])
    columns = np.concatenate([word, shape + (1 << _WORD_BITS), *[b + base + i * _BINS for i, b in enumerate(bins)]])
    values = np.concatenate([np.maximum(1, distinct)[word_row] ** -0.25, share, np.full(3 * rows, 0.5)])
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], columns[order], values[order]


@dataclass
class Model:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]) for grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class _Rated:
    """Features (row, column, value, by row) and grades of rated documents."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    grade: np.ndarray
    grades: int

    def where(self, keep: np.ndarray) -> "_Rated":
        some = keep[self.row]
        return _Rated((np.cumsum(keep) - 1)[self.row[some]], self.column[some], self.value[some], self.grade[keep], self.grades)

    def start(self) -> np.ndarray:
        """Weights of 0 and the thresholds that fit best with them: the first, and logarithms of the gaps."""
        share = np.array([(self.grade <= k).mean() for k in range(self.grades - 1)]).clip(0.01, 0.99)
        cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 0.05 * np.arange(self.grades - 1))
        return np.concatenate([np.zeros(_WIDTH), cuts[:1], np.log(np.maximum(0.05, np.diff(cuts)))])

    def loss(self, p: np.ndarray, slope: bool) -> tuple[float, np.ndarray | None]:
        """The mean log loss of the cumulative-link model and, if asked for, its gradient."""
        n, gaps = len(self.grade), np.exp(p[_WIDTH + 1 :])
        theta = np.concatenate(([-40.0], p[_WIDTH] + np.concatenate(([0], np.cumsum(gaps))), [40.0]))
        z = np.bincount(self.row, weights=p[self.column] * self.value, minlength=n)
        hi, lo = _sigmoid(theta[self.grade + 1] - z), _sigmoid(theta[self.grade] - z)
        mass = np.maximum(hi - lo, 1e-9)
        loss = float(-np.log(mass).mean())
        if not slope:
            return loss, None
        dz, d_theta = (1 - hi - lo) / n, np.zeros(self.grades + 1)
        np.add.at(d_theta, self.grade + 1, -hi * (1 - hi) / mass / n)
        np.add.at(d_theta, self.grade, lo * (1 - lo) / mass / n)
        tails = np.cumsum(d_theta[1:-1][::-1])[::-1]
        return loss, np.concatenate([np.bincount(self.column, weights=dz[self.row] * self.value, minlength=_WIDTH), tails[:1], tails[1:] * gaps])


def _descent(x: _Rated, p: np.ndarray, l1: float, steps: int, step: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps on the loss plus l1 times the sum of |weights|; also the last step's size."""
    at, pace = p, 1.0
    for _ in range(steps):
        loss, g = x.loss(at, True)
        step *= 1.5
        while True:
            new = at - step * g
            new[:_WIDTH] = np.sign(new[:_WIDTH]) * np.maximum(0, np.abs(new[:_WIDTH]) - step * l1)
            d = new - at
            if step < 1e-9 or x.loss(new, False)[0] <= loss + g @ d + d @ d / (2 * step):
                break
            step /= 2
        if d @ d < 1e-10 * (1 + p @ p):
            return new, step
        if (at - new) @ (new - p) > 0:
            pace = 1.0
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        at, p, pace = new + (pace - 1) / faster * (new - p), new, faster
    return p, step


def _fitted(x: _Rated, steps: int) -> Model:
    """The weights have an L1 penalty, as of very many words few tell a grade. Penalties are tried from strong to
    weak on four fifths of the documents, as long as the loss on the others falls; all fit the one that was best."""
    held = np.arange(len(x.grade)) % 5 == 4
    if held.any():
        learn, other, p, step = x.where(~held), x.where(held), x.start(), 1.0
        most = float(np.abs(learn.loss(p, True)[1][:_WIDTH]).max())
        tried: list[tuple[float, float]] = []
        for share in _PENALTIES:
            p, step = _descent(learn, p, share * most, steps, step)
            tried.append((other.loss(p, False)[0], share))
            if tried[-1][0] > 1.02 * min(tried)[0]:
                break
        best = min(tried)[1]
    else:
        best = _PENALTIES[0]
    p, step = x.start(), 1.0
    most = float(np.abs(x.loss(p, True)[1][:_WIDTH]).max())
    for share in _PENALTIES[: _PENALTIES.index(best) + 1]:
        p, step = _descent(x, p, share * most, steps, step)
    return Model(p[:_WIDTH].astype(np.float32), p[_WIDTH] + np.concatenate(([0], np.cumsum(np.exp(p[_WIDTH + 1 :])))))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, most_rows: int = MOST_ROWS, steps: int = 30) -> Model | None:
    """A model of ratings (doc_id, grade: int from 0 to grades - 1) over the whole texts of docs.

    Ratings with a null or an impossible grade are left out; of several for one doc_id the least holds. Of
    more than most_rows about most_rows are taken, by a hash of doc_id; that sample is broadcast to the
    documents and fitted in one task, with `steps` steps for each penalty. None if nothing is rated.
    """
    ratings = ratings.select(F.col("doc_id").cast("long").alias("_r"), F.col("grade").cast("int").alias("grade")).filter(F.col("_r").isNotNull() & F.col("grade").between(0, grades - 1))
    total = ratings.count()
    if total > most_rows:
        ratings = ratings.filter(F.pmod(F.xxhash64("_r", F.lit("sample")), F.lit(1 << 30)) < int(most_rows / total * (1 << 30)))
    ratings = ratings.groupBy("_r").agg(F.min("grade").alias("grade"))
    rated = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ratings), F.col("doc_id") == F.col("_r"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tb.slices(batches):
            row, column, value = features(data, offsets)
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (column.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), *lists], ["doc_id", "grade", "columns", "values"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"doc_id": [], "grade": [], "columns": [], "values": []}, schema=pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("columns", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))]))])
        if rows.num_rows:
            rows = rows.sort_by("doc_id")
            lists = rows.column("columns").combine_chunks()
            row = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
            model = _fitted(_Rated(row, lists.flatten().to_numpy(), rows.column("values").combine_chunks().flatten().to_numpy().astype(float), rows.column("grade").to_numpy(), grades), steps)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.thresholds.tobytes()])], ["weights", "thresholds"])

    sample = rated.select("doc_id", "text", "grade").mapInArrow(extract, "doc_id long, grade int, columns array<int>, values array<float>")
    found = sample.repartition(1).mapInArrow(learn, "weights binary, thresholds binary").collect()
    if not found:
        return None
    return Model(np.frombuffer(bytes(found[0][0]), np.float32), np.frombuffer(bytes(found[0][1]), np.float64))


def grade(docs: DataFrame, model: Model | None, tail_from: int, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability and selected of every row.

    tail_probability is P(grade >= tail_from); selected is tail_probability >= least_tail. Null texts count
    as empty ones. Without a model the figures are null and everything is selected. Only doc_id and text are
    read; there is no shuffle; repeated rows each give a row; a null doc_id stays null.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("selected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, offsets in tb.slices(batches):
            row, column, value = features(data, offsets)
            z = np.bincount(row, weights=model.weights[column] * value, minlength=batch.num_rows)
            above = _sigmoid(z[:, None] - model.thresholds[None, :])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(np.ascontiguousarray(above[:, tail_from - 1]))], ["doc_id", "expected_grade", "tail_probability"])

    graded = docs.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return graded.withColumn("selected", F.col("tail_probability") >= least_tail)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of labels (doc_id, quality, toxic): 0 toxic, 1 of low quality, 2 good; null where unknown."""
    graded = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", graded.alias("grade"))
