from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import bidiagonal as bd
from fleetlens.llm import whitening as wh
from fleetlens.llm.vectors import merged

VECTORS = "vec_id long, embedding array<float>, label int"


def orthogonal(rng, n):
    return np.linalg.qr(rng.normal(size=(n, n)))[0]


def check(r, tol=1e-11):
    values, vectors = bd.eigen(r)
    want = np.linalg.svd(r)[1] ** 2
    assert np.allclose(values, want, rtol=1e-12, atol=1e-14 * max(want[0], 1e-300))
    assert np.abs(vectors.T @ vectors - np.eye(len(r))).max() < tol
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() <= 1e-12 * max(want[0], 1e-300)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(1, 24), st.sampled_from(["normal", "equal", "close", "steep", "rank", "zero column", "block"]))
def test_eigenvectors_of_many_kinds(seed, n, kind):
    rng = np.random.default_rng(seed)
    s = {"normal": rng.uniform(1, 3, n), "equal": np.full(n, 2.0), "close": 1 + 1e-9 * rng.normal(size=n), "steep": 10.0 ** -rng.uniform(0, 7, n),
         "rank": np.where(np.arange(n) < (n + 1) // 2, 1.0, 0.0) * rng.uniform(1, 2, n), "zero column": rng.uniform(1, 3, n), "block": rng.uniform(1, 3, n)}[kind]
    m = orthogonal(rng, n) * s @ orthogonal(rng, n)
    if kind == "zero column":
        m[:, rng.integers(n)] = 0
    if kind == "block":
        m = np.diag(s)
    check(np.linalg.qr(m, mode="r"), 1e-9)


def test_glued_matrices_with_values_equal_to_working_precision():
    """Bidiagonals whose eigenvalues agree in pairs far beyond double precision."""
    n = 42
    b = np.diag(np.abs(np.arange(n) - n // 2) + 1.0) + np.diag(np.full(n - 1, 0.5), 1)
    check(b, 1e-9)


def test_dqds_is_accurate_for_small_values_too():
    a, b = 10.0 ** -np.arange(0, 12.0), 10.0 ** -np.arange(1, 12.0)
    from fractions import Fraction
    got = bd.dqds(a, b)
    det = Fraction(1)
    for x in a:
        det *= Fraction(float(x)) ** 2
    product = Fraction(1)
    for x in got:
        product *= Fraction(float(x))
    assert abs(float(product / det) - 1) < 1e-12  # the determinant needs the smallest value's digits


def table(spark, rows, clash=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in ("n", "component", "whitened", "a.b", "at")])
    return df


def plain(rows, dim, components=32):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*[x for _, x in kept], strict=True)]
    x = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for _, v in kept])
    e, u = np.linalg.eigh(x.T @ x / n)
    order = np.argsort(e)[::-1][:components]
    w = x @ u[:, order] / np.sqrt(e[order])
    return {i: (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), w[j]) for j, (i, v) in enumerate(kept)}, e[order] / e.sum(), n


def test_equals_a_plain_whitening(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(9, 9))
    rows = [(i, (rng.normal(size=9) @ mix * 3).tolist()) for i in range(700)]
    rows += [(800, None), (801, [1.0] * 8 + [None]), (802, [float("nan")] * 9), (803, [1.0]), (804, []), (805, [float("inf")] * 9)]
    want, explained, n = plain(rows, 9, 5)
    got = wh.whiten(table(spark, rows, clash=True).repartition(7), 5).collect()
    assert len(got) == 700 * 5 and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    sign = [np.sign(by[0, c + 1]["whitened"] * want[0][1][c]) for c in range(5)]
    for i, (deviation, w) in want.items():
        for c in range(5):
            r = by[i, c + 1]
            assert r["deviation"] == deviation and abs(r["whitened"] * sign[c] - w[c]) < 1e-8
            assert abs(r["explained"] / explained[c] - 1) < 1e-10 and r["identity_error"] < 1e-10


def test_repeated_rows_null_ids_constant_columns_and_tiny_tables(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [3.0, -2.0, 5.0]), (4, [0.0, 0.0, 5.0])]
    got = wh.whiten(table(spark, rows)).collect()
    assert len(got) == 4 * 2 and max(r["identity_error"] for r in got) < 1e-9  # the third column is constant
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 4) - 1) < 1e-9
    assert wh.whiten(table(spark, [])).collect() == [] and wh.whiten(table(spark, [(1, None)])).collect() == []
    assert wh.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == [] == wh.whiten(table(spark, [(1, [1.0]), (2, [1.0])])).collect()


def test_exact_deviation_beyond_64_bits():
    c = wh.Centre(10 ** 12, np.array([10 ** 18, 3 * 10 ** 18], object))
    scaled = c.scaled(np.array([[1_000_000, 3_000_001], [5_000_000, 3_000_000]]))
    assert scaled.tolist() == [[0, 10 ** 12], [4 * 10 ** 18, 0]]
    assert c.deviations(scaled[:1]).to_pylist() == [None] and c.deviations(scaled[:1] // 10 ** 6).to_pylist() == [10 ** 12]


def test_states_merge_by_levels(spark):
    rows = spark.range(100).selectExpr("id as part", "array(1.0D, cast(id as double)) as state")
    assert merged(rows, lambda s: np.sum(s, axis=0)).tolist() == [100.0, 4950.0]
    assert merged(rows.limit(0), lambda s: s[0]) is None


def test_blockwise_triangles_and_covariances_equal_whole_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) + 50
    parts = [wh.triangular([x[i:i + 3]]) for i in range(0, 500, 3)]
    assert np.allclose(wh.triangular(parts).T @ wh.triangular(parts), x.T @ x)
    states = [np.concatenate([[len(p)], p.mean(0), ((p - p.mean(0)).T @ (p - p.mean(0))).reshape(-1)]) for p in np.array_split(x, 9)]
    got = wh._joined([np.zeros(1 + 6 + 36), *states])
    assert np.allclose(got[7:].reshape(6, 6) / 500, np.cov(x.T, bias=True)) and np.allclose(got[1:7], x.mean(0))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_bidiagonal_form(n):
    r = np.random.default_rng(n).normal(size=(n, n))
    a, b, v = bd.bidiagonalise(r)
    m = np.diag(a) + (np.diag(b, 1) if n > 1 else 0)
    assert np.allclose(v @ m.T @ m @ v.T, r.T @ r)
