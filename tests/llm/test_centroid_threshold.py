from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm.centroid_threshold import SortedCentroids, cluster

VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, rows, clash=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in ("cluster", "distance", "a.b", "s", "all")])
    return df


def brute(rows, k, rounds, dim, scale=256, salt=2):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    cent = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            own = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if own:
                cent[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, m, d in found if m == j) for j in range(len(cent))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, m, d, per[m], sum(per.values()), name[m]) for i, m, d in found), key=str)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(1, 12), st.integers(1, 5), st.integers(1, 4), st.integers(1, 30))
def test_walk_equals_all_distances_with_ties(seed, k, dim, spread, n):
    rng = np.random.default_rng(seed)
    c = rng.integers(-spread, spread + 1, (k, dim))
    q = rng.integers(-2 * spread, 2 * spread + 1, (n, dim))
    d = np.square(q[:, None, :] - c[None]).sum(axis=2)
    number, distance = SortedCentroids(c).nearest(q)
    assert np.array_equal(number, d.argmin(axis=1)) and np.array_equal(distance, d.min(axis=1))


def test_walk_on_wide_vectors_and_large_entries():
    rng = np.random.default_rng(1)
    c, q = rng.integers(-2 ** 26, 2 ** 26, (40, 64)), rng.integers(-2 ** 26, 2 ** 26, (3000, 64))
    q[::7] = c[np.arange(len(q[::7])) % 40]
    d = np.square(q[:, None, :] - c[None]).sum(axis=2)
    number, distance = SortedCentroids(c).nearest(q)
    assert np.array_equal(number, d.argmin(axis=1)) and np.array_equal(distance, d.min(axis=1))


def test_far_centroids_are_not_measured():
    """The walk stops before it has met every centroid."""
    c = np.repeat(np.arange(200)[:, None] * 1000, 8, axis=1)
    walk = SortedCentroids(c)
    seen = []
    walk.centroids = type("Counted", (), {"shape": c.shape, "__getitem__": lambda self, i: seen.append(len(i)) or c[i]})()
    walk.nearest(c + 3)
    assert sum(seen) <= 3 * len(c)


@pytest.mark.parametrize("k", [3, 7])
def test_equals_the_plain_version(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=6) / 4 + 2 * (i % 4)).tolist()) for i in range(120)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, [1.0] * 5), (902, [0.1] * 5 + [None]), (903, [float("nan")] * 6),
             (904, [0.0] * 5 + [float("inf")]), (905, []), (906, [0.0] * 6)]
    got = sorted((tuple(r) for r in cluster(table(spark, rows, clash=True), k=k, rounds=3, dim=6).collect()), key=str)
    assert got == brute(rows, k, 3, 6)


def test_fewer_vectors_than_centroids_empty_and_too_large(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [4.0, 4.0])]
    got = sorted((tuple(r) for r in cluster(table(spark, rows), k=40, rounds=5, dim=2).collect()), key=str)
    assert got == brute(rows, 40, 5, 2)
    assert cluster(table(spark, []), dim=2).collect() == [] and cluster(table(spark, [(1, None)]), dim=2).collect() == []
    with pytest.raises(Exception, match="too large"):
        cluster(table(spark, [(1, [1e9, 0.0])]), dim=2).collect()
