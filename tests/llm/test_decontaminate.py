from __future__ import annotations

import random
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm.decontaminate import Matcher, contamination, digest, drop_contaminated

from .helpers import docs_table, edge_docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    out = []
    for doc, text in rows:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(window, len(v))
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == v[s:s + k]:
                        hit.update(range(p, p + k))
                        ids |= {str(item)} - {"None"}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, prose("a", 25)), (2, prose("b", 4)), (10, prose("c", 10)), (3, None), (4, ""), (None, prose("d", 12)),
         (1, prose("a", 25)), (5, "..."), (6, prose("a", 25)[:60])]
ROWS = [(1, "Start. " + prose("a", 25).upper() + " end"), (2, prose("a", 25)[:80]), (3, prose("b", 4) + ", " + prose("b", 4)),
        (4, prose("c", 10) + prose("e", 50)), (5, None), (6, ""), (7, prose("d", 12)), (8, prose("z", 2000)),
        (8, prose("z", 2000)), (None, "É " + prose("c", 10)), (9, "x" * 60_000)]


@pytest.mark.parametrize("block_nodes", [10_000_000, 120])
def test_equals_brute_force(spark, block_nodes):
    got = digest(contamination(docs_table(spark, ROWS, clash=True), bench(spark, ITEMS), block_nodes=block_nodes)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS, ITEMS)


@pytest.mark.parametrize("block_nodes", [10_000_000, 120])
def test_spans_point_into_the_original_text(spark, block_nodes):
    text = "Ünï — \"" + prose("c", 10).upper() + "\", and more; " + prose("b", 4)
    got = contamination(docs_table(spark, [(1, text)]), bench(spark, ITEMS), block_nodes=block_nodes).first()
    assert [text[s["start"]:s["end"]] for s in got["spans"]] == [prose("c", 10).upper(), prose("b", 4)]
    assert got["items"] == ["10", "2"]


def test_empty_tables(spark):
    none = docs_table(spark, [])
    assert contamination(none, bench(spark, ITEMS)).count() == 0
    got = digest(contamination(docs_table(spark, ROWS), bench(spark, [(1, None)]))).collect()
    assert len(got) == len(ROWS) and not any(r["contaminated"] for r in got)


def test_edge_rows_and_drop_keep_all_columns(spark):
    docs = edge_docs(spark, clash=True)
    kept = drop_contaminated(docs, bench(spark, [(1, "ein Wort"), (2, "again three")]))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 3
    assert digest(contamination(docs, bench(spark, ITEMS))).count() == docs.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=30), st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=5), max_size=5))
def test_matcher_merges_like_a_set_of_positions(doc, patterns):
    n, spans, _ = Matcher([(str(i), p) for i, p in enumerate(patterns)]).find(" ".join(doc))
    want = {p + j for pat in patterns for p in range(len(doc) - len(pat) + 1) if doc[p:p + len(pat)] == pat for j in range(len(pat))}
    got = [p for s in spans for p in range(s["first_word"], s["end_word"])]
    assert n == len(doc) and got == sorted(want)


def test_a_document_word_costs_the_same_however_many_windows_there_are():
    import time
    doc = " ".join(f"d{i}" for i in range(200_000))

    def seconds(n):
        m = Matcher([(str(i), [f"w{i}", f"x{i}"]) for i in range(n)])
        m.find(doc[:1000])
        t = time.process_time()
        assert m.find(doc)[0] == 200_000
        return time.process_time() - t

    few, many = min(seconds(200) for _ in range(3)), min(seconds(100_000) for _ in range(2))
    assert many < 2 * few + 0.3


def test_more_item_words_than_characters_exist():
    m = Matcher([(str(i), [f"w{i}"]) for i in range(1_150_000)])
    n, spans, items = m.find("a w1149999 w1 b w7")
    assert n == 5 and items == ["1", "1149999", "7"] and [(s["first_word"], s["end_word"]) for s in spans] == [(1, 3), (4, 5)]


def test_codes_are_found_at_word_starts_only():
    words = [f"{i}" for i in range(5000)]
    m = Matcher([(w, [w, w]) for w in words])
    assert m.width == 3
    rng = random.Random(4)
    doc = [rng.choice(words) for _ in range(4000)]
    want = {a for a, b in zip(doc, doc[1:], strict=False) if a == b}
    assert set(m.find(" ".join(doc))[2]) == want


def test_columns_with_odd_names_stay(spark):
    docs = docs_table(spark, [(1, "one two"), (2, "x y z")]).selectExpr("*", "1 as `a.b`", "2 as `c``d`")
    got = drop_contaminated(docs, bench(spark, [(1, "x y")]))
    assert got.columns == docs.columns and [r["doc_id"] for r in got.collect()] == [1]
