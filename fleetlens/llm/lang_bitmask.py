"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a bitmask with
one bit a language, an n-gram sets its languages' bits in ``HASHES`` slots, and
the AND of an n-gram's slots is the set of languages that contain it.  A text is
decided by popcounts of these masks per language over all its n-grams, corrected
for the false positives that each language's own fill implies.

The n-grams of a language are those that occur in at least ``min_docs`` of its
sampled documents, at ``share`` or more of the highest rate any language has,
the ``per_lang`` most frequent ones at most.  Training reads at most
``docs_per_lang`` documents of each language, chosen by the hash of the id.

A language needs ``min_lang_docs`` documents and a ``min_lang_share`` of all
documents with one, so there are at most 1 / min_lang_share languages whatever the
column holds, and the filter that goes to the executors has a fixed largest size.

Defined cases: NULL texts and texts without a letter give ``und`` with score 0;
so does every text when no language could be learned.  Ties go to the language
that is first in text order.  Documents with a NULL language or a NULL id teach
nothing.  Repeated rows are decided each; an empty table gives no rows.  Only
doc_id, text and lang are read, so extra columns may have any name.  Whole texts
count, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import annotate, bounded_per_class, doc_texts, held_out, map_arrow, quoted
from fleetlens.llm.grams import Alphabet, code_points, packed, squeeze

N = 4
#: Texts whose n-grams are counted at once.
SLICE = 500
SLOT_BITS = 19
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"


def letter_grams(text: str | None) -> np.ndarray:
    """The n-grams of the lower-cased letters, every other run one space."""
    cp = code_points((text or "").lower())
    letters = Alphabet.letters(cp)
    if not letters.any():
        return np.empty(0, np.uint64)
    symbols = squeeze(cp, ~letters)
    return packed(symbols, min(N, len(symbols)))


def _slot(grams: np.ndarray, seed: int) -> np.ndarray:
    mixed = grams ^ grams >> np.uint64(29)
    return mixed * np.uint64(seed) >> np.uint64(64 - SLOT_BITS)


@dataclass
class BitSliced:
    langs: list[str]
    table: np.ndarray   # (slots, words of 64 languages)
    false: np.ndarray   # chance of a false positive, per language

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> BitSliced:
        langs = sorted(grams)
        table = np.zeros((1 << SLOT_BITS, max(1, -(-len(langs) // 64))), np.uint64)
        false = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            bit = np.uint64(1) << np.uint64(i % 64)
            for seed in HASHES:
                table[_slot(grams[lang], seed), i // 64] |= bit
            false[i] = np.count_nonzero(table[:, i // 64] & bit) / len(table)
        return cls(langs, table, false ** len(HASHES))

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per n-gram, the bitmask of all languages that contain it."""
        found = self.table[_slot(grams, HASHES[0])]
        for seed in HASHES[1:]:
            found &= self.table[_slot(grams, seed)]
        return found

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Corrected number of the n-grams that each language contains."""
        masks = self.masks(grams)
        hits = np.array([np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.langs))], float)
        return np.maximum(hits - len(grams) * self.false, 0) / (1 - np.minimum(self.false, 0.999))

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share against the runner-up, and the share of the
        text's n-grams that it contains."""
        grams = letter_grams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        c = self.counts(grams)
        best = int(np.argmax(c))
        rest = np.delete(c, best).max() if len(c) > 1 else 0.0
        score = 0.0 if c[best] == 0 else float(c[best] / (c[best] + rest))
        return self.langs[best], score, float(min(1.0, c[best] / len(grams)))


def train(docs: DataFrame, docs_per_lang: int = 1000, per_lang: int = 20000, min_docs: int = 2,
          share: float = 0.2, min_lang_docs: int = 2, min_lang_share: float = 1 / 1024) -> BitSliced:
    known = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
             .where("doc_id is not null and lang is not null").where(~held_out("doc_id", FOLDS, HELD_OUT)))
    counts = known.groupBy("lang").agg(F.count("*").alias("docs"))
    every = counts.agg(F.sum("docs")).first()[0] or 0
    enough = counts.where(F.col("docs") >= max(min_lang_docs, min_lang_share * every)).select("lang")
    known = known.join(F.broadcast(enough), "lang", "left_semi")  # 1 / min_lang_share rows at most
    # docs_per_lang ids for each language at most: a proven bound for the broadcast.
    chosen = bounded_per_class(known, "doc_id", "lang", docs_per_lang).distinct()
    rows = doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def count(batches):
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(np.unique(letter_grams(text)))
            for lang, parts in by.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"])

    size = chosen.groupBy("lang").agg(F.count("*").alias("docs"))
    rate = (map_arrow(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            .join(F.broadcast(size), "lang").select("lang", "gram", "n", (F.col("n") / F.col("docs")).alias("rate")))
    # The rows of one n-gram are as many as there are languages.
    top = F.max("rate").over(Window.partitionBy("gram"))
    kept = rate.withColumn("top", top).where((F.col("n") >= min_docs) & (F.col("rate") >= share * F.col("top")))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    lists = (kept.withColumn("rn", best).where(F.col("rn") <= per_lang)
             .groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect())  # per_lang each
    return BitSliced.build({r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in lists})


FOUND = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
         T.StructField("coverage", T.DoubleType())]


def _factory(spark, model: BitSliced):
    shared = spark.sparkContext.broadcast(model)

    def factory():
        def decide(texts):
            got = [shared.value.decide(t) for t in texts]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[2] for g in got], pa.float64())]
        return decide
    return factory


def language(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, coverage."""
    df, name = annotate(doc_texts(docs), "text", FOUND, _factory(docs.sparkSession, train(docs, **how)), ["doc_id"])
    return df.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), f"{name}.lang_pred",
                     f"{name}.score", f"{name}.coverage")


def keep_known_languages(docs: DataFrame, min_coverage: float = 0.1, **how) -> DataFrame:
    """The rows of ``docs`` (all columns) in a learned language: a text without
    letters, or of whose n-grams the best language contains less than
    ``min_coverage``, is rejected."""
    df, name = annotate(docs, "text", FOUND, _factory(docs.sparkSession, train(docs, **how)))
    return df.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.coverage") >= min_coverage)).select(*quoted(docs.columns))
