"""Exact k-means over integer vectors, nearest centroids by the threshold algorithm.

Every dimension has a list of the centroids, sorted by their component. From a vector's
own value each list is walked outward, nearest first, one entry of every list in a step;
a centroid met for the first time gets its exact distance. What a list would give next is
its frontier: a centroid met in no list is at least as far as the sum of all frontiers, so
the walk ends when that sum strictly exceeds the best distance, and ties are still met.

Vectors are spread over tasks; only the sums and counts of a task's clusters leave it, and
only k centroids come to the driver. A component x is the integer floor(scale * x). Vectors
null, of another length, or with null or non-finite components take no part. All numbers
are exact: vectors too large for 64-bit arithmetic are computed as Python integers, and an
integer beyond 2**62, or a distance or inertia beyond 2**63 - 1, ends the query as in ANSI
arithmetic. Repeated vec_ids are rows of their own (as first centroids, the one with the
smaller components comes first); a null vec_id takes part, and is the last choice as a first
centroid. With fewer vectors than k there are fewer centroids. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept, map_batches

#: Vectors that are walked side by side.
TOGETHER = 2_048


def points(rows: DataFrame, dims: int, scale: float) -> DataFrame:
    """vec_id, p: the vectors that take part, as integers."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.when(F.abs(v.cast("double") * scale) < 2.0**62, F.floor(v.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is beyond 2**62"))))
    return rows.filter((F.size(x) == dims) & ~bad).select("vec_id", scaled.alias("p"))


class Centroids:
    """k centroids with their sorted lists."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        self.k, self.dims = len(values), len(values[0])
        self.safe = isqrt((1 << 62) // self.dims) // 2  # below it a squared distance fits in 64 bits
        self.narrow = max(abs(v) for c in values for v in c) < self.safe
        self.lists = {kind: self._sorted(kind) for kind in ([np.int64, object] if self.narrow else [object])}

    def _sorted(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.array(self.values, dtype=kind)
        order = np.argsort(c, axis=0, kind="stable")
        return c, order.T.copy(), np.take_along_axis(c, order, axis=0).T.copy()

    def nearest(self, p: np.ndarray, distances: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of p (int64), the smaller number of ties, and its squared distance unless they aren't wanted."""
        found, distance = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        wide = np.ones(len(p), bool) if not self.narrow else (p.max(axis=1) >= self.safe) | (p.min(axis=1) <= -self.safe)
        for kind, rows in ((np.int64, np.flatnonzero(~wide)), (object, np.flatnonzero(wide))):
            for i in range(0, len(rows), TOGETHER):
                part = rows[i : i + TOGETHER]
                at, d = self._walk(p[part].astype(kind), kind)
                found[part] = at
                if distances:
                    if kind is object and max(d) >= 1 << 63:
                        raise OverflowError("a squared distance doesn't fit in a long")
                    distance[part] = d.astype(np.int64)
        return found, distance

    def _walk(self, p: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        c, order, values = self.lists[kind]
        n, dims, k = len(p), self.dims, self.k
        # what an ended side of a list gives: beyond every gap; both sides end only when all have been met
        beyond = 2 * self.safe + 1 if kind is np.int64 else 1 << 80
        high = np.stack([np.searchsorted(values[j], p[:, j]) for j in range(dims)], axis=1)
        low = high - 1
        met = np.zeros((n, k), bool)
        best, best_at = np.zeros(n, kind), np.full(n, k)
        active, column = np.arange(n), np.arange(dims)
        while len(active):
            v, lo, hi = p[active], low[active], high[active]
            left = np.where(lo >= 0, v - values[column, np.maximum(lo, 0)], beyond)
            right = np.where(hi < k, values[column, np.minimum(hi, k - 1)] - v, beyond)
            frontier = np.minimum(left, right)
            going = ~met[active].all(axis=1)
            going &= (best_at[active] == k) | ~((frontier * frontier).sum(axis=1) > best[active]).astype(bool)
            active, lo, hi, left, right = active[going], lo[going], hi[going], left[going], right[going]
            down = (left <= right).astype(bool)
            entry = order[column, np.where(down, np.maximum(lo, 0), np.minimum(hi, k - 1))]
            low[active], high[active] = lo - down, hi + ~down
            new = np.zeros((len(active), k), bool)
            np.put_along_axis(new, entry, True, axis=1)
            new &= ~met[active]
            met[active] |= new
            for number in range(k):
                rows = active[new[:, number]]
                gap = p[rows] - c[number]
                d = (gap * gap).sum(axis=1)
                better = (best_at[rows] == k) | (d < best[rows]).astype(bool) | ((d == best[rows]).astype(bool) & (number < best_at[rows]))
                best[rows[better]], best_at[rows[better]] = d[better], number
        return best_at, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def _moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """One round: the floor of each cluster's mean; a centroid without vectors stays."""
    dims = centroids.dims
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            p = _matrix(batch.column(1), dims)
            if not len(p):
                continue
            at, _ = held.value.nearest(p, distances=False)
            exact = p if max(int(p.max()), -int(p.min())) < (1 << 62) // len(p) else p.astype(object)
            for number in np.unique(at).tolist():
                own = exact[at == number]
                before = sums.get(number, [0] * (dims + 1))
                sums[number] = [a + int(b) for a, b in zip(before, [*own.sum(axis=0), len(own)], strict=True)]
        rows = [(number, j, Decimal(total[j]), total[dims]) for number, total in sums.items() for j in range(dims)]
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.decimal128(38, 0)), pa.array(d, pa.int64())], ["cluster", "dim", "total", "n"])

    parts = vectors.mapInArrow(partial, "cluster int, dim int, total decimal(38,0), n long")
    values = [list(c) for c in centroids.values]
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k rows for each dimension
        values[r.cluster][r.dim] = int(r.total) // r.n
    return Centroids(values)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.p) for r in vectors.select(name.alias("_h"), "p").orderBy(F.asc_nulls_last("_h"), "p").limit(k).collect()]


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """vec_id, cluster, distance of vectors(vec_id, p)."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, distance = held.value.nearest(_matrix(batch.column(1), held.value.dims))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return map_batches(vectors, work, "vec_id long, cluster int, distance long")


def clusters(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of rows(vec_id, embedding, ...)."""
    spark = rows.sparkSession
    vectors = kept(points(rows, dims, scale).withColumn("vec_id", F.col("vec_id").cast("long")), "points")
    first = first_centroids(vectors, k, salt)
    if not first:
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    centroids = Centroids(first)
    for _ in range(rounds):
        moved = _moved(vectors, centroids)
        if moved.values == centroids.values:
            break  # every further round would give the same
        centroids = moved
    out = kept(assigned(vectors, centroids), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(wide.alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.values]
    inertia = sum(sums.values())
    if inertia >= 1 << 63:
        raise OverflowError("the inertia doesn't fit in a long")
    per_cluster = spark.createDataFrame([(number, total, inertia, names[number]) for number, total in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
