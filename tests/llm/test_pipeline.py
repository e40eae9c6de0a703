"""The pipeline against a plain version of each stage on the small tables."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fleetlens.llm import common, jaccard_join, lang_bitmask, packing, token_rans, toxicity

from .helpers import docs_table, edge_docs, edited, prose
from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as grouped

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def plain(spark):
    """Ids left after each stage, worked out row by row on the driver."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = []

    def keep(test):
        for d in [d for d in rows if not test(d)]:
            del rows[d]
        left.append(sorted(rows))
        return spark.createDataFrame([tuple(r) for r in rows.values()], docs.schema)

    model = toxicity.train(docs, labels)
    docs = keep(lambda d: model.score(rows[d]["text"]) < 0.5)
    languages = lang_bitmask.train(docs)
    found = {d: languages.decide(r["text"]) for d, r in rows.items()}
    keep(lambda d: found[d][0] != "und" and found[d][2] >= 0.1)
    component = grouped([(d, r["text"]) for d, r in rows.items()], 5, 80, 100)
    keep(lambda d: component[d][1] == d)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in contaminated([(d, r["text"]) for d, r in rows.items()], items) if r[5]}
    keep(lambda d: d not in hit)
    return left


def test_stages_equal_the_plain_version(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], plain, strict=True):
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == COLUMNS
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == want
        sizes.append(len(want))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in packed) == plain[3]
    assert len({(r["bucket"], r["batch"], r["place"]) for r in packed}) == len(packed)
    assert sizes[0] > sizes[1] > sizes[3] and sizes[-1] > 0.5 * sizes[0]


def test_run_applies_all_stages(spark, plain):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == plain[3]
    assert "pipeline" not in __spark_entry__.oracle_sql()


def test_stages_take_odd_rows(spark):
    """NULLs, repeated rows, extra columns with clashing names, empty tables."""
    extra = [(100 + i, prose(i, 40)) for i in range(20)] + [(200, edited(prose(3, 40), "e", 1))]
    for docs in (edge_docs(spark, clash=True).unionByName(docs_table(spark, extra, clash=True)), docs_table(spark, [])):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), "odd")
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == docs.count()


def test_workers_let_go_of_what_other_operators_keep(spark):
    """A worker process holds one operator's tokenizer, matcher or words at most."""
    docs = docs_table(spark, [(i, prose(i, 40)) for i in range(40)]).coalesce(1)

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([", ".join(k for k, _ in common._STORED)] * b.num_rows)], names=["held"])

    def in_worker(keeps=None):
        return {r["held"] for r in common.map_arrow(docs.select("doc_id"), held, "held string", keeps).collect()}

    packing.lengths(docs, VOCABULARY).collect()
    jaccard_join.near_duplicates(docs)
    assert in_worker("words") <= {"words", ""}  # or a worker that has not worked yet
    assert in_worker() == {""}
    common.stored("words", "hashes", dict)
    assert common.stored("tokenizer", 1, list) is common.stored("tokenizer", 1, list)
    assert list(common._STORED) == [("tokenizer", 1)]
    common.let_go("tokenizer")
    assert list(common._STORED) == [("tokenizer", 1)]
    common.let_go()
    assert not common._STORED


def test_batches_of_long_texts_are_bounded_by_their_size(spark):
    docs = docs_table(spark, [(i, "x" * 20_000) for i in range(400)]).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    got = [r["bytes"] for r in common.map_arrow(docs.select("doc_id", "text"), sizes, "bytes long").collect()]
    assert sum(got) > 7_000_000 and max(got) < 1_200_000


def test_packing_takes_no_rows_of_the_driver(spark):
    """They are unpickled by Python workers of a second kind, with a daemon of their own, on every executor."""
    docs = docs_table(spark, [(i, prose(i, 5 + i)) for i in range(60)])
    docs = corpus_pipeline.materialise(docs, "docs")
    plan = packing.pack(docs, VOCABULARY, buckets=4)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_counting_keeps_no_ids_of_words():
    texts = [prose(i, 300) for i in range(20)] + ["Ünïcode, words. \u00a0odd", ""]
    counting, whole = token_rans.WordTokenizer(VOCABULARY, only_counts=True), token_rans.WordTokenizer(VOCABULARY)
    for _ in range(2):
        assert counting.counts(texts) == [len(x) // 4 for x in whole.encode(texts)] == whole.counts(texts)
    assert counting.cache.n == whole.cache.n > 0 and not counting.cache.pool and not counting.cache.start
    small = token_rans.WordTokenizer(VOCABULARY, cache_words=10, only_counts=True)
    assert small.counts(texts) == counting.counts(texts) and small.cache.only_counts and not small.cache.pool


def test_every_operator_has_its_query():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_jaccard_join", "op4_warc_merkle"])
def test_queries_match_their_sql(spark, name):
    from fleetlens.plans.check import compare, duck_connect
    con = duck_connect(SF)
    res = compare(spark, con, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], SF)
    assert res["status"] == "ok", res


@pytest.mark.parametrize(("name", "columns"), [
    ("op3_toxicity", "doc_id held_out score predicted"), ("op5_token_files", "doc_id start n_tokens ids_crc32"),
    ("op6_html_text", "page_id url text n_chars"), ("op8_quality", "doc_id held_out score predicted"),
    ("op9_multiset_hash", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
    ("op10_language", "doc_id held_out lang_pred score coverage"), ("op7_packing", "doc_id n_tokens bucket padded batch place padding")])
def test_queries_return_a_row_for_each_document(spark, name, columns):
    got = __spark_entry__.queries()[name](spark, SF)
    source = "pages" if name.startswith("op6") else "documents"
    assert got.columns == columns.split()
    assert got.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert got.where(F.col(got.columns[0]).isNull()).count() == 0
