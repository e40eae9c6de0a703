"""PCA whitening of integer embeddings by a bidiagonal qd solver.

1. Exact sums give the mean.
2. Every task reduces its centred rows block by block to a triangular R (QR);
   the Rs are merged by levels, so R'R is n times the covariance and no product
   of rows is ever formed.
3. ``bidiagonal`` takes R to bidiagonal form, finds its singular values by dqds and
   the whitening directions by twisted factorisations.
4. Rows are projected where they are; the covariance of the result is gathered the
   same way (mean and centred squares per task, merged by levels) and compared with
   the identity.

What reaches the driver is one R and one covariance, of the vectors' dimension.

Defined cases: NULL vectors and vectors with a NULL or non-finite entry are left
out, and vectors of another length than most have (of equally common lengths the
longest); rows with a NULL vec_id and repeated rows count and are returned;
components whose singular value is zero to working precision have no whitened value
and are left out (one vector, or equal ones, give no rows); an empty table gives no
rows; extra columns of any name are ignored; a deviation beyond a long is NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bidiagonal import EPS, eigen
from fleetlens.llm.common import map_arrow
from fleetlens.llm.vectors import dense, lengths, merged, state_rows, vector_rows

SCALE, OFFSET = 64, 1_000_000
_BLOCK = 4096
_LARGEST = float(1 << 52)


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and floor(SCALE * c) + OFFSET of those."""
    ok, c = dense(column, dim)
    x = np.floor(c * SCALE)
    if len(x) and np.abs(x).max() >= _LARGEST:
        raise ValueError("a vector entry is too large for exact sums")
    return ok, x.astype(np.int64) + OFFSET


def _sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors of the commonest length and their exact sums (Python integers)."""
    def run(batches):
        found: dict[int, list] = {}
        for b in batches:
            for dim in np.unique(lengths(b.column(0))):
                if dim > 0:
                    _, x = integers(b.column(0), int(dim))
                    n, s = found.get(dim, (0, np.zeros(dim, object)))
                    found[dim] = (n + len(x), s + (x.sum(axis=0) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0)))
        for dim, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(dim)] * dim, pa.int32()), pa.array(np.arange(dim, dtype=np.int32)), pa.array([n] * dim, pa.int64()),
                                              pa.array([str(v) for v in s])], names=["length", "dim", "n", "s"])

    parts = map_arrow(rows.select("embedding"), run, "length int, dim int, n long, s string")
    sums = parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = sums.where("dim = 0 and n > 0").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not most:
        return 0, np.zeros(0, object)
    found = {r["dim"]: int(r["s"]) for r in sums.where(F.col("length") == most[0]["length"]).collect()}  # one row a dimension
    return most[0]["n"], np.array([found[i] for i in range(len(found))], object)


class Centre:
    """Centred vectors, exactly as n * x - S."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums, self.dim = n, sums, len(sums)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit integers if they fit."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max(abs(int(s)) for s in self.sums))
        if largest < 1 << 61:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def rows(self, column: pa.Array) -> np.ndarray:
        return self.scaled(integers(column, self.dim)[1]).astype(float) / self.n

    def deviations(self, scaled: np.ndarray) -> pa.Array:
        largest = int(np.abs(scaled).max(initial=0))
        if largest ** 2 * self.dim < 1 << 63:
            return pa.array(np.square(scaled.astype(np.int64)).sum(axis=1))
        exact = np.square(scaled.astype(object)).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def triangular(parts: list[np.ndarray]) -> np.ndarray:
    """The R of the QR factorisation of stacked rows, square."""
    stacked = np.concatenate(parts)
    r = np.linalg.qr(stacked, mode="r")
    dim = stacked.shape[1]
    return r if len(r) == dim else np.concatenate([r, np.zeros((dim - len(r), dim))])


def _fold_rows(centre: Centre):
    def step(state, column):
        r = np.zeros((0, centre.dim)) if state is None else state.reshape(centre.dim, centre.dim)
        x = centre.rows(column)
        for i in range(0, len(x), _BLOCK):
            r = triangular([r, x[i:i + _BLOCK]])
        return triangular([r]).reshape(-1) if len(r) else np.zeros(centre.dim ** 2)
    return step


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Merges (n, mean, centred squares) states of one width."""
    total = parts[0]
    for p in parts[1:]:
        k = int(round((np.sqrt(4 * len(p) - 3) - 1) / 2))
        n, m = total[0], p[0]
        if m == 0:
            continue
        if n == 0:
            total = p
            continue
        gap = p[1:k + 1] - total[1:k + 1]
        squares = total[k + 1:] + p[k + 1:] + np.outer(gap, gap).reshape(-1) * (n * m / (n + m))
        total = np.concatenate([[n + m], total[1:k + 1] + gap * (m / (n + m)), squares])
    return total


def _fold_covariance(centre: Centre, directions: np.ndarray):
    k = directions.shape[1]

    def step(state, column):
        parts = [np.zeros(1 + k + k * k) if state is None else state]
        x = centre.rows(column)
        for i in range(0, len(x), _BLOCK):
            w = x[i:i + _BLOCK] @ directions
            mean = w.mean(axis=0)
            parts.append(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).reshape(-1)]))
        return _joined(parts)
    return step


def whiten(table: DataFrame, components: int = 32) -> DataFrame:
    """Per kept vector and component: vec_id, component, n, deviation, whitened,
    explained and identity_error."""
    rows = vector_rows(table)
    n, sums = _sums(rows)
    values, explained, error = [], [], 0.0
    directions = np.zeros((len(sums), 0))
    if n:
        centre = Centre(n, sums)
        dim = centre.dim
        r = merged(state_rows(rows, _fold_rows(centre)), lambda states: triangular([s.reshape(dim, dim) for s in states]).reshape(-1)).reshape(dim, dim)
        values, vectors = eigen(r)
        keep = np.flatnonzero(np.sqrt(values) > max(n, dim) ** 0.5 * dim * EPS * np.sqrt(values[0]))[:components] if values[0] > 0 else np.zeros(0, int)
        directions = vectors[:, keep] / np.sqrt(values[keep] / n)
        explained = (values[keep] / np.square(r).sum()).tolist() if len(keep) else []
        if len(keep):
            k = len(keep)
            got = merged(state_rows(rows, _fold_covariance(centre, directions)), _joined)
            error = float(np.abs(got[k + 1:].reshape(k, k) / n - np.eye(k)).max())

    def run(batches):
        centre = Centre(n, sums)
        k = directions.shape[1]
        for b in batches:
            if not k:
                continue
            ok, x = integers(b.column(1), centre.dim)
            scaled = centre.scaled(x)
            w = (scaled.astype(float) / n) @ directions
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(ok)), centre.deviations(scaled),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.reshape(-1)))], names=["vec_id", "deviation", "whitened"])

    found = map_arrow(rows, run, "vec_id long, deviation long, whitened array<double>")
    share = F.array(*[F.lit(e) for e in explained]) if explained else F.array().cast("array<double>")
    return (found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
