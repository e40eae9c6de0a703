"""Exact centroid clustering of integer vectors by the threshold algorithm.

Vectors become integers floor(scale * x).  For each dimension the centroids are
listed in the order of their value.  A vector finds its nearest centroid by
walking every list outward from its own value, one step in all dimensions at a
time; each centroid met is measured exactly once.  A centroid not met yet is, in
every dimension, at least as far as the next one of that list (the frontier), so
the squared frontier distances sum to a lower bound.  The walk ends when that sum
strictly exceeds the best exact distance (a centroid at the same distance but with
a smaller number still wins) or when no centroid is left.

Assignments and per-cluster sums are made where the rows are; only the sums (a
number of rows set by the parameters) reach the driver between rounds.  All
arithmetic is on integers and exact.

Defined cases: vectors that are NULL, have another number of entries or hold a
NULL or non-finite entry are left out; a row with a NULL vec_id is assigned but
never starts a centroid; repeated rows count each, and copies may start equal
centroids, of which the smaller number wins; with fewer vectors than centroids
there are as many centroids as vectors; an empty table gives no rows; extra
columns of any name are ignored.  Entries beyond +-2^19 are an error, because the
distance need not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_arrow, materialise
from fleetlens.llm.vectors import dense, vector_rows

_LARGEST = 1 << 27
#: Vectors walked at once.
_BLOCK = 1024


def quantised(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and floor(scale * x) of those."""
    ok, x = dense(column, dim)
    q = np.floor(x * scale)
    if len(q) and np.abs(q).max() >= _LARGEST:
        raise ValueError("a vector entry is too large for exact distances")
    return ok, q.astype(np.int64)


class SortedCentroids:
    """The centroids in each dimension's order of values."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # (dim, k) numbers
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        number, distance = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
        for i in range(0, len(q), _BLOCK):
            number[i:i + _BLOCK], distance[i:i + _BLOCK] = self._walk(q[i:i + _BLOCK])
        return number, distance

    def _walk(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dim = self.centroids.shape
        n, dims = len(q), np.arange(dim)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        met = np.zeros((n, k), bool)
        right = np.stack([np.searchsorted(self.values[d], q[:, d]) for d in dims], axis=1)
        left = right - 1
        at = np.arange(n)  # rows still walking
        beyond = np.int64(1) << 40  # past the end of a list: longer than any gap, yet its square sums within doubles
        while len(at):
            x, lo, hi = q[at], left[at], right[at]
            down = np.where(lo >= 0, x - self.values[dims, np.maximum(lo, 0)], beyond)
            up = np.where(hi < k, self.values[dims, np.minimum(hi, k - 1)] - x, beyond)
            frontier = np.square(np.minimum(down, up).astype(np.float64)).sum(axis=1)
            # The bound is compared in doubles: allow for its rounding, so a walk may go on but never ends early.
            go = frontier <= best[at] * (1 + 1e-12)
            at, lo, hi, down, up = at[go], lo[go], hi[go], down[go], up[go]
            if not len(at):
                break
            low = down <= up
            found = self.order[dims, np.clip(np.where(low, lo, hi), 0, k - 1)]
            before = met[at]
            now = before.copy()
            np.put_along_axis(now, found, True, axis=1)
            met[at] = now
            row, c = np.nonzero(now & ~before)
            d = np.square(q[at[row]] - self.centroids[c]).sum(axis=1)
            # Rows of one vector follow each other by centroid number, so the first minimum has the smallest number.
            if len(row):
                start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                least = np.minimum.reduceat(d, start)
                mine = np.minimum.reduceat(np.where(d == np.repeat(least, np.diff(np.r_[start, len(row)])), c, k), start)
                who = at[row[start]]
                better = (least < best[who]) | ((least == best[who]) & (mine < number[who]))
                best[who[better]], number[who[better]] = least[better], mine[better]
            left[at] = lo - low
            right[at] = hi + ~low
            at = at[~now.all(axis=1)]
        return number, best


def _seeds(rows: DataFrame, k: int, dim: int, scale: int, salt: int) -> np.ndarray:
    """The k kept vectors with the smallest hash of their id, in that order (ties by their entries)."""
    kept = rows.where(f"vec_id is not null and size(embedding) = {dim} and forall(embedding, "
                      "x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(name, "embedding").limit(k).select("embedding").collect()
    if not first:
        return np.empty((0, dim), np.int64)
    return quantised(pa.array([r[0] for r in first], pa.list_(pa.float64())), dim, scale)[1]


def _moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: every centroid with vectors moves to the floor of their mean."""
    k, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # k * dim numbers, set by the parameters

    def run(batches):
        walk = SortedCentroids(shared.value)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            _, q = quantised(b.column(0), dim, scale)
            number, _ = walk.nearest(q)
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            full = np.flatnonzero(np.bincount(number, minlength=k))
            if len(full):
                total[full] += np.add.reduceat(q[order], np.searchsorted(number[order], full), axis=0)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(has, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(has))),
                                          pa.array(np.repeat(count[has], dim)), pa.array(total[has].reshape(-1))], names=["cluster", "dim", "n", "total"])

    parts = map_arrow(rows.select("embedding"), run, "cluster int, dim int, n long, total long")
    sums = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # at most k * dim rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: int = 2) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256 of the final centroids."""
    rows = vector_rows(table)
    centroids = _seeds(rows, k, dim, scale, salt)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(rows, centroids, scale)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        walk = SortedCentroids(shared.value) if len(shared.value) else None
        for b in batches:
            ok, q = quantised(b.column(1), dim, scale)
            if walk is None or not len(q):
                continue
            number, distance = walk.nearest(q)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(number.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    found = materialise(map_arrow(rows, run, "vec_id long, cluster int, distance long"), "assigned")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in per.collect()}  # k rows at most
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = found.sparkSession.createDataFrame([(i, s, sum(inertia.values()), names[i]) for i, s in inertia.items()],
                                             "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
