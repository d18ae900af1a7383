"""Clustering around centroids with partition-local ball trees; integer arithmetic throughout."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.shared import written

#: Vectors of one tree, and the most in a leaf whose vectors aren't all equal.
BLOCK, LEAF = 4096, 32
#: Components stay below this, so that squared distances and sums of them are exact in long.
MOST = 1 << 27
_TREES = "vec_ids array<long>, vectors binary, node_from array<int>, node_to array<int>, parent array<int>, is_leaf array<boolean>, radius array<double>, sums binary"


@dataclass
class BallTree:
    """Nodes in preorder over rows in the order of the leaves: first row and end, parent, radius about the mean,
    and the integer sum of the rows."""

    vectors: np.ndarray
    first: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @staticmethod
    def over(vectors: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """The tree, and the order in which it holds the rows of vectors."""
        order, nodes, open_nodes = np.arange(len(vectors)), [], [(0, len(vectors), -1)]
        while open_nodes:
            a, b, parent = open_nodes.pop()
            rows = vectors[order[a:b]]
            total = rows.sum(axis=0)
            away = np.linalg.norm(rows - total / (b - a), axis=1)
            split = b - a > leaf and (rows != rows[0]).any()
            nodes.append((a, b, parent, not split, away.max(), total))
            if split:
                pole = rows[away.argmax()].astype(float)
                other = rows[np.linalg.norm(rows - pole, axis=1).argmax()]
                towards, n = (rows - pole) @ (other - pole), b - a
                order[a:b] = order[a:b][np.argsort(towards, kind="stable")]
                # By the nearer pole, but an eighth to each side at least: so the tree stays shallow.
                half = a + min(max(int((2 * towards < (other - pole) @ (other - pole)).sum()), n // 8 + 1), n - n // 8 - 1)
                open_nodes += [(half, b, len(nodes) - 1), (a, half, len(nodes) - 1)]
        first, end, parents, leaves, radius, sums = zip(*nodes, strict=True)
        return BallTree(vectors[order], np.array(first), np.array(end), np.array(parents), np.array(leaves), np.array(radius), np.array(sums)), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For whole balls: node and centroid; then the centroid of every row (-1 in whole balls).

        A ball of radius r goes whole to the nearest centroid of its mean if every other is farther from the
        mean by more than 2 r, with a margin above all rounding; so no row in it is as near to another. What
        is left is settled in the leaves, in integers, among the centroids that the leaf's ball leaves open.
        """
        mean = self.sums / (self.end - self.first)[:, None]
        far = np.stack([np.linalg.norm(mean - c, axis=1) for c in centroids], axis=1)
        nearest = far.argmin(axis=1)
        margin = 2 * self.radius + 1e-9 * (1 + np.abs(self.vectors).max() + np.abs(centroids).max() + far.max(axis=1))
        possible = far <= (far.min(axis=1) + margin)[:, None]
        whole = possible.sum(axis=1) == 1
        inside = np.zeros(len(whole), bool)
        for i in range(1, len(whole)):  # parents come first
            inside[i] = inside[self.parent[i]] or whole[self.parent[i]]
        label = np.full(len(self.vectors), -1)
        for i in np.flatnonzero(self.leaf & ~whole & ~inside).tolist():
            rows, some = self.vectors[self.first[i] : self.end[i]], np.flatnonzero(possible[i])
            label[self.first[i] : self.end[i]] = some[np.stack([((rows - centroids[c]) ** 2).sum(axis=1) for c in some]).argmin(axis=0)]
        top = np.flatnonzero(whole & ~inside)
        return top, nearest[top], label


def _packed(vec_ids: list[int | None], vectors: np.ndarray) -> pa.RecordBatch:
    tree, order = BallTree.over(vectors)
    ids = pa.array(vec_ids, pa.int64()).take(pa.array(order))
    lists = [pa.array([x.tolist()], kind) for x, kind in ((tree.first, pa.list_(pa.int32())), (tree.end, pa.list_(pa.int32())), (tree.parent, pa.list_(pa.int32())), (tree.leaf, pa.list_(pa.bool_())), (tree.radius, pa.list_(pa.float64())))]
    columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([tree.vectors.astype(np.int32).tobytes()]), *lists, pa.array([tree.sums.astype(np.int64).tobytes()])]
    return pa.RecordBatch.from_arrays(columns, ["vec_ids", "vectors", "node_from", "node_to", "parent", "is_leaf", "radius", "sums"])


def _unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for i in range(batch.num_rows):
        first, end, parent, leaf, radius = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("node_from", "node_to", "parent", "is_leaf", "radius"))
        vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
        sums = np.frombuffer(batch.column("sums")[i].as_buffer(), np.int64).reshape(-1, dims)
        yield batch.column("vec_ids")[i].values, BallTree(vectors, first, end, parent, leaf, radius, sums)


def trees(vectors: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """A row with a ball tree for each `block` vectors of a partition; vectors: vec_id long, v array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.zeros((0, dims), np.int64)
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids, held = ids + batch.column("vec_id").to_pylist(), np.concatenate((held, rows))
            while len(held) >= block:
                yield _packed(ids[:block], held[:block])
                ids, held = ids[block:], held[block:]
        if len(held):
            yield _packed(ids, held)

    return vectors.select("vec_id", "v").mapInArrow(run, _TREES)


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of what is nearest to each centroid; a centroid with nothing stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, tree in _unpacked(batch, dims):
                node, of, label = tree.assign(centroids)
                np.add.at(n, of, tree.end[node] - tree.first[node])
                np.add.at(total, of, tree.sums[node])
                np.add.at(n, label[label >= 0], 1)
                np.add.at(total, label[label >= 0], tree.vectors[label >= 0])
        c, i = np.divmod(np.arange(k * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, i, n[c], total.reshape(-1))], ["c", "i", "n", "s"])

    sums = table.mapInArrow(run, "c long, i long, n long, s long").groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for c, i, n, s in sums.filter("n > 0").collect():  # k times dims numbers
        out[c, i] = s // n
    return out


def _settled(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centroids.shape[1] if centroids.ndim == 2 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _unpacked(batch, dims):
                node, of, label = tree.assign(centroids)
                for a, b, c in zip(tree.first[node], tree.end[node], of, strict=True):
                    label[a:b] = c
                distance = ((tree.vectors - centroids[label]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def integer_vectors(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors with exactly dims components, none null or non-finite."""
    x = F.col("embedding")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x")).filter("size(x) = {} and not exists(x, y -> y is null or isnan(y) or abs(y) = double('infinity'))".format(dims))

    def scaled(y: Column) -> Column:
        z = F.floor(y * scale)
        return F.when(F.abs(y * scale) < MOST, z).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond 2^27")).cast("long"))

    return kept.select("vec_id", F.transform("x", scaled).alias("v"))


def centroid_clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> tuple[DataFrame, DataFrame]:
    """vec_id, cluster, distance of every vector, and cluster, n, center, cluster_inertia, inertia of every centroid.

    rows hold vec_id and embedding, an array of float or double. Vectors that haven't exactly dims components,
    or hold a null or a non-finite one, take no part; of the others floor(scale * x) counts. Centroids start as
    the k vectors with the smallest sha256 of '1:' and vec_id, move `rounds` times to the floor of the mean of
    what is nearest (squared Euclidean distance, ties to the smaller number), and stay where nothing is
    nearest. All sums and distances are exact: a component of 2^27 or more after scaling is an error.

    Rows that repeat a vec_id are vectors of their own, ordered among the starts by their components; those
    without vec_id are starts last. With fewer than k vectors there are as many centroids; no vectors, no
    rows. Other columns are not read.

    A partition turns its vectors into trees once, in a written table; each round reads them, and of every
    partition k sums of dims numbers are shuffled. The driver holds the centroids alone.
    """
    vectors = integer_vectors(rows, dims, scale)
    table = written(trees(vectors, dims), "balls")
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    starts = vectors.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([s["v"] for s in starts], np.int64)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(table, centroids)
    assigned = written(_settled(table, centroids), "assigned")
    found = {r["cluster"]: (r["n"], r["d"]) for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d")).collect()}  # k rows
    of = [(c, found.get(c, (0, 0))[0], centre, found.get(c, (0, 0))[1], sum(d for _, d in found.values())) for c, centre in enumerate(centroids.tolist())]
    return assigned, rows.sparkSession.createDataFrame(of, "cluster int, n long, center array<long>, cluster_inertia long, inertia long")
