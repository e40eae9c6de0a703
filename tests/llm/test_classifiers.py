"""Toxicity, quality and language: held-out accuracy, defined cases, folds."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from fleetlens.llm import lang_bitmask, quality_gbdt, toxicity
from fleetlens.llm.grams import Alphabet, code_points, packed, squeeze

from .helpers import docs_table, edge_docs, prose

SF = "/root/testdata/sf0.01"


def crc(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def labelled(spark, n=240):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = prose(i, r.randrange(5, 120))
        if bad:
            text += " grimwort " * r.randrange(1, 4) + prose(-i, 5)
        rows.append((i, text))
        labels.append((i, int(not bad), int(bad)))
    return docs_table(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r["held_out"] == (crc(d, 5) == 0) for d, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    out = [d for d in got if got[d]["held_out"]]
    assert sum(got[d]["predicted"] == int(d % 3 == 0) for d in out) >= 0.95 * len(out)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = labelled(spark)
    swapped = labels.selectExpr("doc_id", "quality", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, swapped))
    assert a == b


def test_toxicity_defined_cases(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 7, 7), (3, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    edge = edge_docs(spark, clash=True).unionByName(docs)
    got = toxicity.toxicity(edge, labels.unionByName(odd))
    assert got.count() == edge.count()
    blank = {r["score"] for r in got.collect() if r["doc_id"] in (0, 1, 2, 3)} & {r["score"] for r in got.where("doc_id is null").collect()}
    assert len(blank) == 1  # the intercept's
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 3 != 0").count() == docs.where("doc_id % 3 != 0").count()


def test_toxicity_on_the_held_out_rows_of_each_language(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    y, score = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    lang, said = np.array([r["lang"] for r in rows]), np.array([r["predicted"] for r in rows])
    caught = score > np.quantile(score[y == 0], 0.98)
    assert caught[y == 1].mean() >= 0.8
    assert all(caught[(y == 1) & (lang == x)].mean() > 0.5 for x in ("en", "de", "fr", "es"))
    rank = np.argsort(np.argsort(score))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc >= 0.96 and y[said == 1].mean() >= 0.95 and said[y == 1].mean() >= 0.75


def test_ratios_and_selection_equal_a_plain_version(spark):
    import math
    texts = [(i % 2, prose(i, 12, 30) + (" nasty word" if i % 2 and i % 3 else "")) for i in range(80)]
    rows = spark.createDataFrame(texts, "label int, text string")
    got = {r["gram"]: r["ratio"] for r in toxicity.gram_ratios(rows, 50, 3, 0.5, 1.0).collect()}
    pos, neg = {}, {}
    for y, t in texts:
        for g in {int(g) for part in toxicity.text_grams(t) for g in part.view(np.int64)}:
            (pos if y else neg)[g] = (pos if y else neg).get(g, 0) + 1
    n1, n0 = sum(y for y, _ in texts), sum(1 - y for y, _ in texts)
    every = []
    for g in set(pos) | set(neg):
        p, n = pos.get(g, 0), neg.get(g, 0)
        ratio = math.log((p + 1) / (n1 + 2)) - math.log((n + 1) / (n0 + 2))
        if p + n >= 3 and abs(ratio) >= 0.5:
            every.append((-abs(ratio) / math.sqrt(1 / (p + 1) + 1 / (n + 1)), g, ratio))
    best = sorted(every)[:50]
    assert len(got) == 50 and abs(max(s for s, _, _ in best) - max(s for s, g, _ in every if g in got)) < 1e-9
    assert all(abs(got[g] - r) < 1e-9 for _, g, r in best if g in got)


def test_text_grams_match_a_plain_version():
    text = "Ab  cé\n日 x"
    plain = " ab cé 日 x "
    got = toxicity.text_grams(text)
    for g, n in zip(got, (5, 6), strict=True):
        assert len(g) == len(plain) - n + 1
        same = [plain[i:i + n] for i in range(len(g))]
        assert len(set(g.tolist())) == len(set(same))


def test_quality_on_held_out_rows(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        text = prose(i, r.randrange(20, 200))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 8 else " | ".join(text.split())
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0), 0))
    docs, lab = docs_table(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_gbdt.quality(docs, lab).collect()}
    assert all(x["held_out"] == (crc(d, 5) == 0) and x["predicted"] == int(x["score"] >= 0.3) for d, x in got.items())
    out = [d for d in got if got[d]["held_out"]]
    assert sum(got[d]["predicted"] == int(d % 4 != 0) for d in out) >= 0.95 * len(out)


def test_quality_defined_cases(spark):
    docs, labels = labelled(spark, 60)
    edge = edge_docs(spark, clash=True)
    got = quality_gbdt.quality(edge.unionByName(docs), labels).collect()
    assert len(got) == edge.count() + 60 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_gbdt.quality(edge, labels.limit(0)).collect()} == {0.5}
    ones = quality_gbdt.quality(docs, labels.where("quality = 1")).collect()
    assert all(r["score"] > 0.99 for r in ones)


def test_quality_accuracy_on_the_test_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["predicted"] for r in quality_gbdt.quality(docs, labels).where("held_out").collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in got}
    assert np.mean([got[d] == t for d, t in truth.items()]) >= 0.95


def test_flat_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality_gbdt.STATISTICS)))
    y = (x[:, 0] * x[:, 3] > 0).astype(float)
    trees = quality_gbdt.fit(x, y, np.ones(500), trees=20, depth=3)
    for row, score in zip(x[:50], trees.score(x[:50]), strict=True):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert np.mean((trees.score(x) >= 0.5) == y) > 0.85


LETTERS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}


def texts_of(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(LETTERS[lang], k=r.randrange(2, 7))) for _ in range(n))


def test_language_on_held_out_rows(spark):
    rows = [(i, texts_of(lang, i, 60), lang if i % 10 else None) for i in range(300) for lang in [list(LETTERS)[i % 3]]]
    docs = docs_table(spark, rows, clash=True)
    got = {r["doc_id"]: r for r in lang_bitmask.language(docs).collect()}
    assert all(r["held_out"] == (crc(d, 3) == 1) for d, r in got.items())
    assert all(got[d]["lang_pred"] == list(LETTERS)[d % 3] for d in got)
    kept = lang_bitmask.keep_known_languages(docs)
    assert kept.columns == docs.columns and kept.count() == 300


def test_language_defined_cases(spark):
    rows = [(i, texts_of("aa", i, 60), "aa") for i in range(30)]
    edge = edge_docs(spark, clash=True)
    got = lang_bitmask.language(edge.unionByName(docs_table(spark, rows, clash=True))).collect()
    assert len(got) == edge.count() + 30
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("aa", "en", "und") for r in got)
    odd = lang_bitmask.language(docs_table(spark, [(900, None), (901, " \n"), (902, "...")] + rows)).where("doc_id >= 900").collect()
    assert {(r["lang_pred"], r["score"]) for r in odd} == {("und", 0.0)}
    unknown = lang_bitmask.language(docs_table(spark, [(1, "abc", None), (2, None, "aa"), (4, "12 34 !", "aa")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
    assert lang_bitmask.language(docs_table(spark, [])).count() == 0


def test_language_filter_has_no_false_negatives_and_corrects_false_positives():
    rng = np.random.default_rng(7)
    grams = {f"l{i:03}": rng.integers(0, 2 ** 60, 20_000).astype(np.uint64) for i in range(70)}
    f = lang_bitmask.BitSliced.build(grams)
    for i, lang in enumerate(f.langs):
        assert (f.masks(grams[lang])[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    fresh = rng.integers(0, 2 ** 60, 50_000).astype(np.uint64)
    raw = np.array([np.count_nonzero(f.masks(fresh)[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(70)])
    assert raw.max() > 0 and f.counts(fresh).max() < 0.005 * len(fresh)
    assert f.counts(grams["l007"])[7] == pytest.approx(20_000, rel=0.01)


def test_language_accuracy_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang_bitmask.language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97


def test_packed_grams_are_distinct_for_distinct_strings():
    a = packed(squeeze(code_points("abcd"), Alphabet.blanks(code_points("abcd"))), 4)
    assert len(a) == 3 and len(set(a.tolist())) == 3
    assert not set(packed(a[:0], 3).tolist())


def test_counts_and_decision_equal_exact_sets():
    """Without the filter: exact sets of n-grams for each language."""
    texts = {"aa": [prose(i, 40, 60) for i in range(8)], "bb": [prose(100 + i, 40, 60).replace("w", "v") for i in range(8)]}
    grams = {x: np.unique(np.concatenate([lang_bitmask.letter_grams(t) for t in ts])) for x, ts in texts.items()}
    model = lang_bitmask.BitSliced.build(grams)
    for seed in range(40):
        g = lang_bitmask.letter_grams(prose(seed, 60, 60) + " " + prose(seed, seed, 60).replace("w", "v"))
        exact = np.array([np.isin(g, grams[x]).sum() for x in ("aa", "bb")])
        assert np.abs(model.counts(g) - exact).max() <= 2
        if abs(exact[0] - exact[1]) > 4:
            assert np.argmax(model.counts(g)) == np.argmax(exact)


def test_a_dirty_language_column_stays_bounded(spark):
    rows = [(i, prose(i, 30), "en") for i in range(60)] + [(1000 + i, prose(i, 30), f"x{i}") for i in range(200)]
    model = lang_bitmask.train(docs_table(spark, rows), min_lang_docs=5)
    assert model.langs == ["en"]
    assert lang_bitmask.train(docs_table(spark, rows), min_lang_share=0.1).langs == ["en"]


def test_stages_keep_columns_with_odd_names(spark):
    docs, labels = labelled(spark)
    odd = docs.selectExpr("*", "1 as `a.b`", "map('k', 1) as m")
    for got in (toxicity.drop_toxic(odd, labels), lang_bitmask.keep_known_languages(odd)):
        assert got.columns == odd.columns and got.count() > 0


def test_splits_equal_a_plain_search():
    """Every feature and cut of every node tried one by one."""
    rng = np.random.default_rng(9)
    for _ in range(12):
        n, k, width, bins, l2 = 60, 3, 2, 8, 1.0
        x = np.round(rng.normal(size=(n, k)), 1)
        g, h, node = rng.normal(size=n), rng.uniform(0.1, 1, n), rng.integers(0, width, n)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)])
        feature, threshold, at = quality_gbdt._splits(binned, node, width, g, h, cuts, bins, l2)
        for i in range(width):
            mine = node == i
            whole = g[mine].sum() ** 2 / (h[mine].sum() + l2)
            gains = {}
            for j in range(k):
                for c in cuts[j]:
                    left, right = mine & (x[:, j] <= c), mine & (x[:, j] > c)
                    gains[j, c] = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - whole
            assert abs(gains[feature[i], threshold[i]] - max(gains.values())) < 1e-9
            assert ((binned[feature[i]] > at[i]) == (x[:, feature[i]] > threshold[i])).all()


def test_statistics_equal_plain_counts():
    import math
    text = "Ab cd cd EF | 12!\n\nAb cd? x_y é"
    got = dict(zip(quality_gbdt.STATISTICS, quality_gbdt.statistics(text), strict=True))
    words, n = text.split(), len(text)
    want = {"log_chars": math.log1p(n), "log_words": math.log1p(9), "word_length": sum(map(len, words)) / 9, "letters": 15 / n, "upper": 4 / 15, "digits": 2 / n,
            "blanks": 10 / n, "bars": 1 / 9, "bangs": 1 / 9, "distinct_words": 7 / 9, "top_word": 2 / 9, "repeats": 1 / 9, "log_lines": math.log1p(2),
            "repeated_lines": 0.0, "line_words": 4.5, "stops": 1 / 9, "signs": 1 / 9, "longest_word": 3.0}
    words = text.split()
    want |= {"log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / len(words), "letters": sum(map(str.isalpha, text)) / n,
             "upper": 4 / sum(map(str.isalpha, text)), "blanks": sum(map(str.isspace, text)) / n, "distinct_words": len(set(words)) / len(words),
             "line_words": len(words) / 2}
    for key in ("bars", "bangs", "top_word", "repeats", "stops", "signs"):
        want[key] = {"bars": 1, "bangs": 1, "top_word": 2, "repeats": 1, "stops": 1, "signs": 1}[key] / len(words)
    assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
    assert quality_gbdt.statistics("") == quality_gbdt.statistics(None) == [0.0] * len(quality_gbdt.STATISTICS)
