from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import minhash_hamming as mh
from fleetlens.llm.jaccard_join import shingle_set

from .helpers import docs_table, edge_docs, edited, prose
from .test_jaccard_join import brute, rows_of_families


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(0, 64), st.integers(0, 40))
def test_signatures_within_the_distance_share_a_key(seed, errors, distance):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2 ** 16, 64).astype(np.uint16)
    b = a.copy()
    at = rng.permutation(64)[:errors]
    b[at] ^= rng.integers(1, 2 ** 16, len(at)).astype(np.uint16)
    k = mh.keys(np.stack([a, b]), distance)
    if errors <= distance:
        assert (k[0] == k[1]).any()
    if errors == 64:
        assert not np.isin(k[0], k[1]).any()


def test_distance_covers_the_pairs_at_the_threshold():
    """Sets at similarity exactly 0.8: 800 shared tokens of 1,000."""
    d = mh.signature_distance(80, 100)
    assert 20 < d < 32
    rng = np.random.default_rng(3)
    far = []
    for _ in range(400):
        t = rng.integers(0, 2 ** 63, 1000).astype(np.uint64)
        s = mh.minima([np.unique(t[:900]), np.unique(np.concatenate([t[:800], t[900:]]))])
        far.append((s[0] != s[1]).sum())
    assert max(far) <= d and 11 < np.mean(far) < 14.5  # expected 12.8


def test_minima_equal_a_plain_minimum():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (1, 2, 700, 3)]
    one = [mh.minima([s])[0] for s in sets]
    assert np.array_equal(mh.minima(sets), np.stack(one))
    assert np.array_equal(one[2], mh.minima([rng.permutation(sets[2])])[0])


@pytest.mark.parametrize("width", [4, 5])
def test_equals_all_pairs(spark, width):
    rows = rows_of_families()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in mh.near_duplicates(docs_table(spark, rows, clash=True), width).collect()}
    assert got == brute(rows, width, 80)


def test_hot_group_of_far_copies_and_of_copies(spark):
    """A group of which most pairs do not link, led by an outer member."""
    base = prose("hub", 150, 10 ** 6)
    rows = [(i, edited(base, f"hub{i}", 9 if i == 0 else i % 14)) for i in range(220)] + [(1000 + i, base.upper()) for i in range(200)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in mh.near_duplicates(docs_table(spark, rows)).collect()}
    want = brute(rows, 4, 80)
    assert got == want and 20 < len({c for _, c in want.values()}) < 200


def test_edge_rows(spark):
    got = mh.near_duplicates(edge_docs(spark, clash=True)).collect()
    assert len(got) == edge_docs(spark).count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[0] == [(0, 0, True)] and by[1] == [(0, 1, True)] and by[5] == [(1, 5, True)]
    assert sorted(by[None]) == [(0, None, True), (1, None, True)]
    assert sorted(by[4]) == [(1, 4, True), (1, 4, True)] and by[9] == [(1, 9, True)]
    assert mh.near_duplicates(docs_table(spark, [])).count() == 0


def test_texts_of_one_id_count_as_linked(spark):
    a, b = prose("a", 60, 10 ** 6), prose("b", 60, 10 ** 6)
    rows = [(7, a), (7, b), (9, edited(a, "x", 1)), (8, edited(b, "y", 1)), (3, prose("c", 60, 10 ** 6)), (7, a)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in mh.near_duplicates(docs_table(spark, rows)).collect())
    assert got == [(3, 3, True), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]


def test_short_sets_need_no_signature(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g"), (4, "a b c d e f g"), (5, "a b c d e f g h")]
    got = {r["doc_id"]: r["component_id"] for r in mh.near_duplicates(docs_table(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 4, 80).items()}
    assert len(shingle_set("a b c d e f g h", 4)) == 5
