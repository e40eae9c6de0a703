"""Merkle audit, token files, page text, packing and multiset hash."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import html_extract, multiset_hash, packing, token_rans, warc_merkle
from fleetlens.session import scratch_path

from .helpers import docs_table, edge_docs, prose

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# --- packing ---

def plain_padding(cells, buckets):
    cells = sorted(cells)
    best = {0: 0}
    for _ in range(buckets):
        new = {}
        for j in range(1, len(cells) + 1):
            new[j] = min((best[i] + sum((cells[j - 1][0] - n) * c for n, c in cells[i:j]) for i in best if i < j), default=10 ** 18)
        best = {**{0: 0}, **{j: min(v, best.get(j, 10 ** 18)) for j, v in new.items()}}
    return best[len(cells)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=14), st.integers(1, 6))
def test_boundaries_are_optimal(hist, buckets):
    cells = sorted(hist.items())
    bounds = packing.boundaries(cells, buckets)
    assert len(bounds) <= buckets and bounds[-1] == cells[-1][0]
    padding = sum((min(b for b in bounds if b >= n) - n) * c for n, c in cells)
    assert padding == plain_padding(cells, min(buckets, len(cells)))


def test_pack_places_every_document_once(spark):
    rows = [(i, prose(i, random.Random(i).randrange(0, 400))) for i in range(500)] + [(1000, prose(9, 5000))]
    got = packing.pack(docs_table(spark, rows, clash=True), buckets=5, budget=1000, slice_rows=20).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(t.split()) + 1 for d, t in rows}
    assert len({(r["bucket"], r["batch"], r["place"]) for r in got}) == len(got)
    assert all(r["padded"] >= r["n_tokens"] and r["padding"] == r["padded"] - r["n_tokens"] for r in got)
    in_batch = Counter((r["bucket"], r["padded"], r["batch"]) for r in got)
    assert all(n * padded <= 1000 or n == 1 for (_, padded, _), n in in_batch.items())
    for bucket in {r["bucket"] for r in got}:  # only the last batch may be short
        sizes = Counter(r["batch"] for r in got if r["bucket"] == bucket)
        assert sorted(sizes) == list(range(len(sizes))) and len({n for b, n in sizes.items() if b < len(sizes) - 1}) <= 1


def test_pack_spreads_the_copies_of_one_key(spark):
    rows = [(None, prose(i, 9)) for i in range(3000)] + [(5, "a b c")] * 3000 + [(10 + i, prose(i, 4)) for i in range(500)]
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.enabled")
    for key in keys:
        spark.conf.set(key, "false")
    try:
        got = packing.pack(docs_table(spark, rows), buckets=2, budget=1000, slice_rows=100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key in keys:
            spark.conf.set(key, "true")
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    places = {(r["bucket"], r["batch"] * (1000 // r["padded"]) + r["place"]) for r in got}
    assert len(places) == len(rows)
    for bucket in {b for b, _ in places}:
        assert sorted(p for b, p in places if b == bucket) == list(range(sum(b == bucket for b, _ in places)))
    assert max(Counter(r["task"] for r in got).values()) < len(rows) / 3


def test_pack_edge_rows(spark):
    got = packing.pack(edge_docs(spark, clash=True)).collect()
    assert len(got) == edge_docs(spark).count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert packing.pack(docs_table(spark, [])).count() == 0


def test_pack_counts_token_ids_and_pads_least(spark):
    r = random.Random(8)
    rows = [(i, prose(i, r.randrange(0, 60) if i % 3 else r.randrange(1500, 3000), 10 ** 6)) for i in range(240)] + [(999, None)]
    plain = tokenizers.Tokenizer.from_file(VOCABULARY)
    want = {d: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}
    got = packing.pack(docs_table(spark, rows), VOCABULARY, buckets=6, budget=20_000).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and max(want.values()) > 4096
    assert sum(r["padding"] for r in got) == plain_padding(list(Counter(want.values()).items()), 6)
    assert {r["padded"] for r in got} <= set(want.values())  # every boundary is a real length
    in_batch = Counter((r["bucket"], r["padded"], r["batch"]) for r in got)
    assert all(n * padded <= 20_000 or n == 1 for (_, padded, _), n in in_batch.items())


# --- token files ---

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=5000), st.integers(0, 5000), st.integers(0, 5000))
def test_rans_round_trip_whole_and_from_checkpoints(ids, a, b):
    ids = np.array(ids, np.uint32)
    table = token_rans.Table(*token_rans.frequencies(ids))
    assert not len(ids) or table.freq.sum() == 1 << token_rans.SCALE_BITS
    block = token_rans.encode_ids(table, ids)
    assert np.array_equal(token_rans.decode_ids(table, block), ids)
    first, last = sorted((min(a, len(ids)), min(b, len(ids))))
    assert np.array_equal(token_rans.decode_ids(table, block, first, last), ids[first:last])


def test_rans_long_block_uses_checkpoints_and_is_near_the_entropy():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 400_000), 49_000).astype(np.uint32)
    table = token_rans.Table(*token_rans.frequencies(ids))
    block = token_rans.encode_ids(table, ids)
    assert len(block.offsets) > 2
    assert np.array_equal(token_rans.decode_ids(table, block, 300_000, 300_500), ids[300_000:300_500])
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert block.words.nbytes * 8 < 1.01 * -(p * np.log2(p)).sum() * len(ids) + 64 * token_rans.LANES


def test_shard_checksum_finds_a_changed_byte():
    docs = [(i, np.arange(i + 1, dtype="<u4").tobytes()) for i in range(50)]
    image = token_rans.shard_image(docs)
    assert [d for ids, _, _ in token_rans.read_shard(image) for d in ids] == list(range(50))
    with pytest.raises(ValueError):
        list(token_rans.read_shard(image[:-1] + bytes([image[-1] ^ 1])))


ODD_TEXTS = ["It's THE end, isn't it? I'll say: \"yes\".", "ÀÉÎ ﬁ Ǆ straße ΣΑΣ İstanbul", "a\x1cb c  d e",
             "<|endoftext|> in text <|STARTOFTEXT|>", "é é,\n x. y., z,. 1,2 3.", "日本語。テスト 😀 😀!", "word,\tword.\r\nWORD,", "a' s 't '", "x" * 3000]


def test_cached_words_equal_the_tokenizer():
    plain = tokenizers.Tokenizer.from_file(VOCABULARY)
    texts = [*ODD_TEXTS, *(prose(i, 50) for i in range(5))]
    mine = token_rans.WordTokenizer(VOCABULARY)
    for _ in range(2):
        got = mine.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_of_odd_and_plain_signs_in_small_pieces_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(token_rans, "PIECE_CHARS", 50)
    signs = [*"aAbzZ .,,..  \n\t\r'!?-12\x00\x0b\x1c\x85\xa0éÉßΣσİıﬁǅ日。😀<|\u3000e\u0301", "'s", "'ll", "The", "ing"]
    r, mine = random.Random(5), token_rans.WordTokenizer(VOCABULARY, cache_words=300)
    for _ in range(150):
        texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 60 if i else 400))) for i in range(12)]
        want = [mine.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(g, "<u4").tolist() for g in mine.encode(texts)] == want
        assert mine.counts(texts) == [len(w) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_cached_words_equal_the_tokenizer_on_any_text(text):
    got = token_rans.shared_tokenizer(VOCABULARY).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == token_rans.shared_tokenizer(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shard_ids", [1 << 22, 300])
def test_token_files_round_trip(spark, shard_ids):
    rows = [(7 * i % 1000, t) for i, t in enumerate([*ODD_TEXTS, None, "", *(prose(i, 200) for i in range(60))])] + [(None, "first"), (5000, None)]
    plain = tokenizers.Tokenizer.from_file(VOCABULARY)
    path = scratch_path(spark, "tokens")
    token_rans.write_tokens(docs_table(spark, rows, clash=True), path, VOCABULARY, shard_ids=shard_ids)
    got = {r["doc_id"]: r for r in token_rans.read_tokens(spark, path).collect()}
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        r = got.pop(doc)
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert not got


def test_token_files_edge_rows(spark):
    got = token_rans.token_digest(edge_docs(spark, clash=True), VOCABULARY).collect()
    assert len(got) == edge_docs(spark).count()
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert token_rans.token_digest(docs_table(spark, []), VOCABULARY).count() == 0


# --- multiset hash ---

def lanes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in multiset_hash.with_lanes(df, "t", "v").orderBy("i").collect()]


def test_fingerprint_is_a_homomorphic_multiset_hash(spark):
    p = [prose(i, 30) + ". " + prose(-i, 9) + "!" for i in range(6)]
    whole, shuffled, part, rest, doubled, empty, none = lanes(
        spark, ["\n".join(p), "\n\n" + "\n".join(reversed(p)) + " ", "\n".join(p[:2]), "\n".join(p[2:]), "\n".join([*p, p[0]]), " \n", None])
    assert whole == shuffled and whole != doubled and empty == none == [0] * len(multiset_hash.MODULI)
    df = spark.createDataFrame([(part, rest, whole)], "a array<long>, b array<long>, w array<long>")
    r = df.select(multiset_hash.add(F.col("a"), F.col("b")).alias("sum"), multiset_hash.subtract(F.col("w"), F.col("a")).alias("left"),
                  multiset_hash.likeness("w", "a").alias("l"), multiset_hash.likeness("w", "w").alias("same")).first()
    assert r["sum"] == whole and r["left"] == rest and r["same"] == 1.0 and 0.1 < r["l"] < 0.6


def test_likeness_is_the_multiset_jaccard_of_repeated_lines(spark):
    def text(seed, repeats):
        return "\n".join([prose(seed, 9)] * repeats + [prose(1000 * seed + i, 9) for i in range(40)])

    pairs = [(text(s, k), text(s, k // 2)) for s, k in enumerate((20, 40, 60, 90, 100) * 4, 1)]
    pairs += [(text(s, 90), text(s, 45) + "\n" + text(s + 50, 20)) for s in range(30, 40)]
    counts = [tuple(Counter(t.split("\n")) for t in p) for p in pairs]
    exact = [(x & y).total() / (x | y).total() for x, y in counts]
    flat = lanes(spark, [t for p in pairs for t in p])
    df = spark.createDataFrame([(i, flat[2 * i], flat[2 * i + 1]) for i in range(len(pairs))], "i int, a array<long>, b array<long>")
    got = [r["l"] for r in df.orderBy("i").select(multiset_hash.likeness("a", "b").alias("l")).collect()]
    off = np.abs(np.array(got) - exact)
    assert off.mean() < 0.06 and off.max() < 0.25


def test_likeness_of_texts_of_more_than_2_17_lines(spark):
    lines = [f"l{i}" for i in range(140_000)]
    whole, half, other = lanes(spark, ["\n".join(lines), "\n".join(lines[:70_000]), "\n".join(f"m{x}" for x in lines)])
    df = spark.createDataFrame([(whole, half, other)], "w array<long>, h array<long>, o array<long>")
    r = df.select(multiset_hash.likeness("w", "h").alias("half"), multiset_hash.likeness("w", "o").alias("none")).first()
    assert 0.35 < r["half"] <= 0.5 and r["none"] < 0.2


def test_fingerprints_follow_the_next_document(spark):
    rows = [(i * 3, "\n".join(prose(100 * i + j, 12) + "." for j in range(i % 7 + 2))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "é😀x"), (None, "no id"), (5000, "the last\nof all. lines")]
    got = {r["doc_id"]: r for r in multiset_hash.fingerprints(docs_table(spark, rows, clash=True)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    prints = dict(zip([t for _, t in order], lanes(spark, [t for _, t in order]), strict=True))
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 2
        edited = text[:len(text) - k] + after[:k]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1.0)
    assert len(got) == len(rows) and len(prints) > 60
    many = [r for d, r in got.items() if d is not None and d < 1000]
    assert np.mean([r["near_edited"] for r in many]) > np.mean([r["near_next"] for r in many]) + 0.15


def test_fingerprints_edge_rows(spark):
    docs = edge_docs(spark, clash=True)
    got = multiset_hash.fingerprints(docs).collect()
    assert len(got) == docs.count() and len({r["fingerprint"] for r in got if r["doc_id"] in (0, 1, 2)}) == 1
    assert multiset_hash.fingerprints(docs_table(spark, [])).count() == 0
    one = multiset_hash.fingerprints(docs_table(spark, [(5, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0


# --- page text ---

PAGE = """<!doctype html><html><head><title>T, t, t</title><style>p{}</style></head><body class=home>
<header><p>Header text, which is long enough to count as a paragraph, surely, and more.</p></header>
<div id="menu"><ul><li><a href=1>One</a></li><li><a href=2>Two, three</a></li></ul></div>
<div class="page"><div class="story"><h2>A  head&amp;line</h2><p>First paragraph, with <b>bold</b> and <a href=x>a link</a>, long
enough to score; it has commas, too.<p>Second &eacute;t&#xe9; &lt;b&gt; one<br>with a break, and no closing tag
<script>var x = "<p>not, this, text</p>";</script><blockquote>A quote, of some length, that belongs to it.</blockquote>
<div class="ad-box advert">Buy this, now, it is cheap, and good, and everyone wants it at once.</div>
<ul><li>Item one</li><li>Item <i>two</i></li></ul><ul><li><a href=r>Related, story, one</a></li></ul>
<form><p>Sign up, please, for the newsletter, it comes each day of the week.</p></form></div>
<div class="comments"><p>I liked this, really, thank you so much for writing it, all of it.</p></div></div>
<aside>Aside, text, here, which would otherwise be long enough to score.</aside><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE).split("\n") == [
        "A head&line", "First paragraph, with bold and a link, long enough to score; it has commas, too.",
        "Second été <b> one with a break, and no closing tag", "A quote, of some length, that belongs to it.", "Item one", "Item two"]


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>", ""), ("<p>one<p>two", "one\ntwo"), ("<nav>a</nav>", ""),
    ("<script>x", ""), ("<!-- c <p>no</p> --><p>yes", "yes"), ("<p>a < b && c &amp d</p>", "a < b && c & d"),
    ("<article><p>cut off in the middle of a ta", "cut off in the middle of a ta"), ("<p>x</p></div></p>", "x")])
def test_main_text_defined_cases(page, text):
    assert html_extract.main_text(page) == text


LONG = [f"Paragraph {i}, of some length, with commas, " + "and many more words " * 14 + "to its end." for i in range(20)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_an_article_keeps_all_its_sections():
    short = ["A short section of sixty characters, which is kept as well.", "So is this line."]
    nav = "<div><a href=1>Link one of many</a> <a href=2>Link two of many</a></div>"
    inside = f"<h1>Title</h1><section>{paragraphs(LONG)}</section><section>{paragraphs(short)}</section><p>The end.</p>"
    want = ["Title", *LONG, *short, "The end."]
    for page in (f"<body><nav>menu</nav><article>{inside}</article><footer>foot</footer></body>",
                 f"<body>{nav}<main><div><div>{inside}</div></div></main><aside>aside</aside></body>",
                 f"<body>{nav}<div>{inside}<ul><li><a href=3>Another story</a></li></ul></div><footer>foot</footer></body>"):
        assert html_extract.main_text(page).split("\n") == want


def test_a_title_and_a_closing_line_outside_the_body_div_are_kept():
    nav = "<div><a href=1>Link one of many</a> <a href=2>Link two of many</a></div>"
    page = (f"<body>{nav}<div><h1><a href=s>Title</a></h1><div class=x>By somebody</div><div>{paragraphs(LONG)}</div><p>The end.</p></div>"
            "<div class=sidebar>Other things</div></body>")
    assert html_extract.main_text(page).split("\n") == ["Title", "By somebody", *LONG, "The end."]


def test_text_around_that_is_not_mostly_the_article_stays_out():
    other = "".join(f"<div><ul><li>Entry {i} of a long list of things {k}</li></ul></div>" for i in range(200) for k in range(3))
    page = f"<body><div><div>{paragraphs(LONG)}</div></div><div>{other}</div></body>"
    assert html_extract.main_text(page).split("\n") == LONG


def test_sibling_articles_stay():
    page = f"<body><article><section>{paragraphs(LONG[:10])}</section></article><article>{paragraphs(LONG[10:])}</article></body>"
    assert html_extract.main_text(page).split("\n") == LONG


BAD_NAMES = ["post-comments", "comment-content", "commentlist", "main-menu", "page-footer", "post-share", "content-ad", "entryComments", "siteNav",
             "related_posts", "cookie-notice", "newsletter-body", "storySidebar", "sponsored article", "AdSlot", "social share", "breadcrumb", "widget text"]


@pytest.mark.parametrize("where", ["inside", "before", "after", "nested"])
def test_boilerplate_by_name_goes_wherever_it_stands(where):
    """Pages built block by block, so what must stay is known."""
    for i, name in enumerate(BAD_NAMES):
        for attr in (f'class="{name}"', f"id='{name}'"):
            for tag in ("div", "section", "article", "ul"):
                junk = f"<{tag} {attr}><p>Junk {i}, with commas, and a sentence of some length, as prose has.</p></{tag}>"
                good = [f"<p>{t}</p>" for t in LONG]
                body = {"inside": f"<article>{good[0]}{junk}{''.join(good[1:])}</article>", "before": f"{junk}<article>{''.join(good)}</article>",
                        "after": f"<div class='post'>{''.join(good)}</div>{junk}",
                        "nested": f"<main><div><section>{''.join(good[:4])}<div>{junk}</div></section>{''.join(good[4:])}</div></main>"}[where]
                assert html_extract.main_text(f"<html><body>{body}</body></html>").split("\n") == LONG, (name, tag, attr)


def test_roles_hidden_parts_and_the_container_of_the_whole_page():
    junk = [f"<div {a}><p>Junk, with commas, and a sentence of some length, as prose has.</p></div>" for a in (
        'role="complementary"', "role=navigation", 'role="contentinfo"', "hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display: none"')]
    page = f"<body class='sidebar-left'><div id='widget-page'><div class='post hidden-title'>{junk[0].join(f'<p>{t}</p>' for t in LONG)}{''.join(junk)}</div></div></body>"
    assert html_extract.main_text(page).split("\n") == LONG


def test_a_block_inside_a_link_is_link_text():
    links = "".join(f"<div><a href='/{i}'><p>Read, next, a headline that is long enough to count as prose {i}</p></a></div>" for i in range(30))
    page = f"<body><div>{paragraphs(LONG)}</div><div>{links}</div></body>"
    assert html_extract.main_text(page).split("\n") == LONG
    assert html_extract.main_text(f"<body><article><p><a>open link</p>{paragraphs(LONG)}</article></body>").split("\n") == ["open link", *LONG]


@pytest.mark.parametrize("part", ["<a ", '<a "', '<a b="', "<", "</x", "<x>", "<x><dt></dt>", '<a b=">" ', "<li>", "<!--", "&amp;", "<div class='a b'><a>", "= '", "<p>a"])
def test_parsing_takes_linear_time(part):
    import time

    def seconds(n):
        page = "<p>start</p>" + part * (n // len(part))
        t = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - t

    seconds(10_000)
    assert seconds(4_000_000) < 10 * seconds(1_000_000) + 2


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<p>" + "wört " * 40_000, "y")],
                                  "page_id long, url string, html string, found string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == 5 * 40_000 - 1
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_extract_gives_the_articles_of_the_test_table(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        truth[r["page_id"]] = "\n".join(p for p in parts if p)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == truth


# --- Merkle audit ---

def pages_table(spark, n=300):
    rows = [(i * 7, f"http://h/{i}", prose(i, 5 + i % 40)) for i in range(n)] + [(None, None, None), (None, "u", "x"), (7, "http://h/1", prose(1, 6)), (9, "", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_exactly_the_changed_records(spark):
    recs = warc_merkle.records(pages_table(spark), ids_per_file=100)
    assert recs.count() == 304
    changed = recs.withColumn("copy", F.sha2(F.when(F.col("page_id") == 700, F.concat("record", F.lit("!"))).otherwise(F.col("record")), 256))
    a = warc_merkle.leaves(changed, "copy")
    b = a.where("page_id is null or page_id != 1400").select("page_id", "file", "start", "length", F.col("copy").alias("hash"))
    extra = a.where("page_id = 21").selectExpr("-5L as page_id", "file", "start + 1000000 as start", "length", "hash")
    a, b = a.drop("copy"), b.unionByName(extra)
    found = {(r["page_id"], r["primary_sha256"] is None, r["replica_sha256"] is None) for r in warc_merkle.audit(a, b, span=500).collect()}
    assert found == {(700, False, False), (1400, False, True), (-5, True, False)}
    report = warc_merkle.fixity_report(a, b, span=500)
    assert {r["state"]: r["n"] for r in report.groupBy("state").agg(F.count("*").alias("n")).collect()} == {
        "intact": 302, "damaged": 1, "missing": 1, "extra": 1}
    assert warc_merkle.audit(a, a).count() == 0


def test_records_are_whole_and_offsets_contiguous(spark):
    pages = pages_table(spark, 50).unionByName(spark.createDataFrame([(14, "http://h/2", "twice")] * 90, "page_id long, url string, html string"))
    recs = warc_merkle.records(pages, ids_per_file=100)
    for r in recs.collect():
        body = r["record"].encode()
        assert len(body) == r["length"] and hashlib.sha256(body).hexdigest() == r["hash"]
        head, _, rest = body.partition(b"\r\n\r\n")
        assert int(head.rsplit(b": ", 1)[1]) == len(rest) - 4 and head.startswith(b"WARC/1.0\r\n")
    files, url = {}, {r["hash"]: r["url"] for r in recs.collect()}
    for r in warc_merkle.leaves(recs).collect():
        files.setdefault(r["file"], []).append(r)
    assert sum(map(len, files.values())) == pages.count()
    for rows in files.values():
        at, rows = 0, sorted(rows, key=lambda r: r["start"])
        for r in rows:
            assert r["start"] == at
            at += r["length"]
        keys = [(r["page_id"] is not None, r["page_id"], url[r["hash"]], r["hash"]) for r in rows]
        assert keys == sorted(keys)


def test_copies_of_one_record_are_placed_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc_merkle, "COPIES", 100)
    pages = spark.createDataFrame([(7, "u", "same")] * 3000 + [(8, "u", f"t{i}") for i in range(3000)], "page_id long, url string, html string")
    starts = sorted((r["start"], r["length"]) for r in warc_merkle.leaves(warc_merkle.records(pages)).collect())
    assert len(starts) == 6000 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_audit_of_empty_tables(spark):
    none = warc_merkle.leaves(warc_merkle.records(pages_table(spark).limit(0)))
    some = warc_merkle.leaves(warc_merkle.records(pages_table(spark, 3)))
    assert warc_merkle.fixity_report(none, none).count() == 0
    assert {r["state"] for r in warc_merkle.fixity_report(some, none).collect()} == {"missing"}
    assert {r["state"] for r in warc_merkle.fixity_report(none, some).collect()} == {"extra"}
