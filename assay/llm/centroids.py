"""Centroid clustering of integer vectors, exact to the last bit.

Distances come from |x|^2 - 2 x.c + |c|^2, one matrix product a block, in float64. All numbers are integers: while
dim * (max|x| + max|c|)^2 stays under 2^53, every product and partial sum is one that float64 holds exactly, in whatever
order BLAS adds. Vectors beyond that bound go through int64, and beyond 2^63 through Python's integers, row by row of the
block, so a few large vectors don't slow the rest. Sums and counts meet in RDD.treeAggregate, k x dim integers a task; no
vector leaves its partition after the blocks are cut.

Kept are vectors with exactly dim components, none null or non-finite; all others have no row in the result. Repeated rows
count each. A null id is clustered like any other but starts no centroid; of equal ids the smaller vector bytes start
first. With fewer than k kept rows with ids there are as many centroids; with none, the result is empty. Distances and
inertias beyond a long are null. Other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block, the unit of the matrix products.
BLOCK = 1024
_LONG = 1 << 63


def blocks(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(ids, x): the kept vectors in blocks, x as row-major float64 bytes. Cut to the shared folder: each round reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
            ids, lists = batch.column(0).filter(fits), batch.column(1).filter(fits)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            whole = np.isfinite(x).all(axis=1)
            ids, x = ids.filter(pa.array(whole)), x[whole]
            for a in range(0, len(x), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + BLOCK].to_pylist()], pa.list_(pa.int64())), pa.array([x[a : a + BLOCK].tobytes()])], names=["ids", "x"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`").cast("array<double>"))
    return cut(rows.mapInArrow(run, "ids array<long>, x binary"))


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in Python's integers; scale is a power of two, so nothing is rounded but by floor."""
    whole = np.vectorize(lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)), otypes=[object])
    return whole(x)


class Centroids:
    """k integer centroids, and the exact nearest one of blocks of vectors."""

    def __init__(self, rows: list[list[int]], scale: int):
        self.rows, self.scale, self.dim = rows, scale, len(rows[0])
        self.most = max(abs(v) for r in rows for v in r)
        #: largest max|x| for which float64, and int64, hold all sums
        self.exact, self.fits = (isqrt((b - 1) // self.dim) - self.most for b in (1 << 53, _LONG))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(cluster, distance as object or int64, rows in float64's bound, parts): parts are (row numbers, their integers)."""
        with np.errstate(over="ignore"):
            q = np.floor(x * self.scale)
        most = np.abs(q).max(axis=1, initial=0)
        cluster, far = np.zeros(len(x), np.int32), np.zeros(len(x), object)
        quick = np.flatnonzero(most <= self.exact)
        middle = np.flatnonzero((most > self.exact) & (most <= min(self.fits, 2**52)))
        slow = np.flatnonzero(most > max(self.exact, min(self.fits, 2**52)))
        parts = []
        if len(quick):
            v, c = q[quick], np.array(self.rows, np.float64)
            d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
            cluster[quick] = d.argmin(axis=1)
            far[quick] = d.min(axis=1).astype(np.int64).astype(object)
            parts.append((quick, v))
        for rows, kind in ((middle, np.int64), (slow, object)):
            if len(rows):
                v = q[rows].astype(np.int64) if kind is np.int64 else _integers(x[rows], self.scale)
                c = np.array(self.rows, kind)
                d = np.stack([((v - c[i]) ** 2).sum(axis=1) for i in range(len(c))], axis=1)
                at = np.array([min(range(len(c)), key=lambda i, r=r: (r[i], i)) for r in d])
                cluster[rows], far[rows] = at, d[np.arange(len(d)), at].astype(object)
                parts.append((rows, v))
        return cluster, far, quick, parts

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, sum of vectors, sum of distances) a cluster, in Python's integers."""
        k = len(self.rows)
        cluster, far, _, parts = self.nearest(x)
        total = np.zeros((k, self.dim), object)
        for rows, v in parts:
            mine = (cluster[rows][None, :] == np.arange(k)[:, None]).astype(np.float64)
            if v.dtype == np.float64:  # at most BLOCK x 2^26: exact
                total = total + (mine @ v).astype(np.int64).astype(object)
            else:
                total = total + np.array([v[m > 0].astype(object).sum(axis=0) if m.any() else [0] * self.dim for m in mine], object).reshape(k, self.dim)
        inertia = np.zeros(k, object)
        np.add.at(inertia, cluster, far)
        return np.bincount(cluster, minlength=k).astype(object), total, inertia


def _combine(cut_blocks: DataFrame, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, dim = len(at.rows), at.dim
    zero = (np.zeros(k, object), np.zeros((k, dim), object), np.zeros(k, object))
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))  # noqa: E731 (new arrays; zero stays as it is)
    return cut_blocks.rdd.treeAggregate(zero, lambda acc, row: add(acc, at.sums(np.frombuffer(row.x).reshape(-1, dim))), add, depth=3)


def seeds(cut_blocks: DataFrame, k: int, dim: int, seed: int) -> list[bytes]:
    """The k kept vectors with the smallest hex sha256 of '<seed>:<id>', in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: list[tuple[str, bytes]] = []
            for ids, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = dim * 8
                hashed = ((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x[n * size : (n + 1) * size]) for n, i in enumerate(ids) if i is not None)
                best = heapq.nsmallest(k, [*best, *hashed])
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best]), pa.array([b[1] for b in best])], names=["h", "x"])

    return [bytes(r.x) for r in cut_blocks.mapInArrow(run, "h string, x binary").orderBy("h", "x").limit(k).collect()]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, dim: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) a kept vector, of the integers floor(scale * x).

    Each round assigns every vector to its nearest centroid (ties: the smaller number) and replaces every non-empty
    centroid by floor(sum / count) of its vectors; a last assignment follows. scale is a power of two."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two, or scale * x would be rounded")
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    held = blocks(vectors, id_col, vec_col, dim)
    first = seeds(held, k, dim, seed)
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    at = Centroids([[int(v) for v in _integers(np.frombuffer(x), scale)] for x in first], scale)
    for _ in range(rounds):
        n, total, _ = _combine(held, at)
        at = Centroids([[int(v) // int(n[i]) for v in total[i]] if n[i] else r for i, r in enumerate(at.rows)], scale)
    of_cluster = [int(v) for v in _combine(held, at)[2]]
    long = lambda v: v if v < _LONG else None
    inertias, inertia = [long(v) for v in of_cluster], long(sum(of_cluster))
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in at.rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine, far, _, _ = at.nearest(np.frombuffer(x).reshape(-1, dim))
                columns = [pa.array(ids, pa.int64()), pa.array(mine), pa.array([long(int(v)) for v in far], pa.int64()), pa.array([inertias[i] for i in mine], pa.int64()), pa.array([inertia] * len(ids), pa.int64()), pa.array([digests[i] for i in mine])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return held.mapInArrow(run, schema)
