from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import common, linking
from fleetlens.llm.components import components
from fleetlens.llm.jaccard_join import allocate, keep_one_per_component, near_duplicates, shingle_set

from .helpers import docs_table, edge_docs, edited, prose

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=4, num=85, den=100):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets, parent = {}, {}
    for doc, text in rows:
        w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        parent[doc] = doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(first, seed, n, sizes, edits):
    """Copies of one text with ever more words replaced."""
    base = prose(seed, sizes, 10 ** 6)
    return [(first + i, base if i == 0 else edited(base, (seed, i).__repr__(), e)) for i, e in enumerate([0, *edits][:n])]


def rows_of_families():
    rows, at = [], 100
    for size in (1, 3, 4, 5, 7, 9, 12, 14, 20, 33, 50, 120, 300, 900):
        for k in range(4):
            edits = [1, 1, 2, 3, max(1, size // 60), max(1, size // 40), max(1, size // 30), max(1, size // 25)]
            for e in family(at, f"{size}/{k}", 9, size, [min(size, x) for x in edits]):
                rows.append(e)
                at += 1
            # growing texts: similar to their neighbours only
            base = prose(f"grow{size}/{k}", size, 10 ** 6)
            for j in range(5):
                rows.append((at, base + " " + prose(f"tail{size}", max(1, size * j // 12), 10 ** 6)))
                at += 1
    common = prose("common", 60, 10 ** 6)
    rows += [(at + i, prose(f"own{i}", 40 + i, 10 ** 6) + " " + common) for i in range(40)]
    return rows


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_equals_all_pairs(spark, width, num):
    rows = rows_of_families()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_table(spark, rows, clash=True), width, num).collect()}
    assert got == brute(rows, width, num)


def test_large_group_of_near_copies_and_of_copies(spark):
    base = prose("hub", 200, 10 ** 6)
    rows = [(i, edited(base, f"hub{i}", 3)) for i in range(150)] + [(1000 + i, base.upper()) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_table(spark, rows)).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}
    assert set(got.values()) == {0}


def test_copies_too_far_from_their_leader_still_find_each_other(spark):
    """Edits from a small pool of places and words, so that copies share them
    and link to one another without linking to the first."""
    base, rows = prose("far", 120, 10 ** 6).split(" "), []
    for i in range(160):
        r, w = random.Random(i), list(base)
        for _ in range(i % 12):
            at = r.randrange(0, 12) * 10
            if r.random() < 0.8:
                w[at] = f"new{r.randrange(2)}"
            else:
                w[at:at + 1] = ["in", "stead"] if r.random() < 0.5 else []
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_table(spark, rows)).collect()}
    want = brute(rows)
    assert got == want and 3 < len({c for _, c in want.values()}) < 150


def linked_components(spark, sets, how):
    """{id: component} of sets that all meet in one bucket, by linking."""
    ids = sorted(sets)
    pairs = spark.createDataFrame([(ids[0], i) for i in ids[1:]], "a long, b long")
    tokens = spark.createDataFrame([(i, sorted(sets[i])) for i in ids], "id long, tokens array<long>")
    classes = spark.createDataFrame([(i, i) for i in ids], "id long, node long")
    return {r["id"]: r["component"] for r in linking.find_components(pairs, tokens, classes, linking.Threshold(*how)).collect()}


def test_far_members_are_not_indexed_by_what_they_lack(spark, monkeypatch):
    """400 sets with 20 of the 100 tokens around which 500 others lie: rows for
    what they lack grew with their number times the size of a set."""
    near = {i: {*range(100), 1000 + i} for i in range(500)}
    far = {500 + i: {*range(20), *range(10_000 + 100 * i, 10_080 + 100 * i)} for i in range(400)}
    twins = {2000 + i: far[500 + i] - {10_000 + 100 * i} for i in range(0, 400, 100)}
    held, real = [], linking.materialise

    def watched(df, name):
        out = real(df, name)
        if name == "rows":
            held.append(out.selectExpr("coalesce(sum(size(own)), 0)").first()[0])
        return out

    monkeypatch.setattr(linking, "materialise", watched)
    got = linked_components(spark, near | far | twins, (80, 100))
    assert {got[i] for i in near} == {0} and all(got[t] == got[t - 1500] == t - 1500 for t in twins)
    assert sum(held) < 2 * 80 * 2 * len(twins)


@pytest.mark.parametrize(("seed", "how"), [(1, (80, 100)), (2, (85, 100)), (3, (1, 2))])
def test_members_around_and_far_from_the_middle_find_each_other(spark, seed, how):
    """Sets with ever smaller parts of a common text and of one of six others,
    so links also cross the line between far and around."""
    r, (num, den) = random.Random(seed), how
    sets = {i: {*range(100), 5000 + i} for i in range(30)}
    for i in range(30, 230):
        g = 1000 * (1 + r.randrange(6))
        part = r.choice([0, 5, 30, 60, 75, 80, 85, 90, 100])
        one = {*range(part), *range(g, g + r.choice([10, 15, 20, 25, 30, 60, 100]))}
        sets[i] = one - set(r.sample(sorted(one), r.randrange(6))) | {9000 + r.randrange(40) for _ in range(r.randrange(4))}
    sets = {i: s for i, s in sets.items() if s not in [sets[j] for j in range(i) if j in sets]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i: find(i) for i in sets}
    got = linked_components(spark, sets, how)
    assert {i: got.get(i, i) for i in sets} == want
    assert 3 < len(set(want.values())) < len(sets) - 30


def test_written_steps_of_a_family_are_few(spark, monkeypatch):
    """Each written step costs a task for every partition, however few its rows
    are; a family that its middle decides needs no further components."""
    sets = {0: {*range(85), *range(2000, 2015)}} | {i: {*range(100), 1000 + i} for i in range(1, 40)} | {50: {*range(85), *range(3000, 3015)}}
    written, real = [], linking.materialise

    def watched(df, name):
        written.append(name)
        return real(df, name)

    monkeypatch.setattr(linking, "materialise", watched)
    got = linked_components(spark, sets, (80, 100))
    assert {got.get(i, i) for i in range(1, 40)} == {1} and got.get(0, 0) == 0 and got.get(50, 50) == 50
    assert len(written) <= 16 and written.count("components") <= 2


@pytest.mark.parametrize("few", [0, 200_000])
def test_shuffled_and_broadcast_joins_give_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    base = prose("hub", 120, 10 ** 6)
    rows = [(i, edited(base, f"hub{i}", 7 if i == 0 else i % 10)) for i in range(60)] + [(100 + i, base) for i in range(5)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_table(spark, rows)).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    got = near_duplicates(edge_docs(spark, clash=True)).collect()
    assert len(got) == edge_docs(spark).count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[0] == [(0, 0)] and by[1] == [(0, 1)] and by[5] == [(1, 5)]
    assert by[None] == [(0, None), (1, None)] or by[None] == [(1, None), (0, None)]
    assert sorted(by[4]) == [(1, 4), (1, 4)] and by[9] == [(1, 9)]
    assert near_duplicates(docs_table(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(2, prose("k", 50)), (1, prose("k", 50)), (1, prose("k", 50)), (3, None), (None, "x"), (None, "x"), (4, "")]
    docs = docs_table(spark, rows, clash=True)
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, None, None, 4], key=str)


def test_one_row_of_an_id_stays_beside_maps_and_odd_names(spark):
    rows = [(1, prose("k", 50)), (1, prose("k", 50)), (1, prose("m", 40)), (2, prose("k", 50)), (None, "x"), (None, "x")]
    docs = docs_table(spark, rows).selectExpr("*", "map('k', doc_id) as m", "7 as `a.b`")
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, None, None]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10 ** 9), st.sampled_from([(85, 100), (1, 2), (9, 10)]),
       st.sampled_from([1, 10 ** 3, 10 ** 7, 10 ** 9]))
def test_similar_sets_always_share_a_signature(n, more, less, seed, threshold, n_sets):
    """The completeness of the partition, whatever the cost model chose."""
    num, den = threshold
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2 ** 63, n + more).astype(np.uint64))
    b = np.concatenate([a[:max(1, len(a) - less)], rng.integers(0, 2 ** 63, more).astype(np.uint64)])
    b = np.unique(b)
    both = len(np.intersect1d(a, b))
    scheme = allocate(num, den, {s: n_sets for s in range(1, 600, 7)})
    if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
        assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


def test_cost_model_uses_one_deletion_segments_when_candidates_are_dear():
    many = allocate(85, 100, {s: 10 ** 8 for s in range(1, 3000, 7)}).bands
    few = allocate(85, 100, {s: 10 for s in range(1, 3000, 7)}).bands
    assert sum(b.deleting for b in many) > sum(b.deleting for b in few)
    assert all(b.plain + 2 * b.deleting >= 30 * b.high // 185 + 1 for b in many + few)


def test_shingles_count_words_not_prefixes():
    assert len(shingle_set("a B c d e", 4)) == 2 and len(shingle_set("a b", 4)) == 1
    assert np.array_equal(shingle_set("A  b\tC\nd", 4), shingle_set("a b c d", 4))
    assert not np.array_equal(shingle_set("a b", 4), shingle_set("ab", 4))
    assert len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(201, 200), (200, 202), (202, 201), (300, 300)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
