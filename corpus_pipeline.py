"""A training-corpus pipeline over ``documents``: drop toxic documents, drop texts
in no known language, keep one document of each near-duplicate group, drop
documents that hold benchmark passages, and pack what is left into batches.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and reads again as the next stage's docs.
All but the last return the columns of their input; the last returns one row for
each document with its bucket, batch and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.common import materialise, read_table
from fleetlens.llm.decontaminate import drop_contaminated
from fleetlens.llm.jaccard_join import keep_one_per_component
from fleetlens.llm.lang_bitmask import keep_known_languages
from fleetlens.llm.packing import pack
from fleetlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return keep_one_per_component(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the trained stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
