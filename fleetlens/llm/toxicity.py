"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios, trained on labelled text.

Training reads at most ``per_class`` labelled documents of each class (chosen
by the hash of the id, weighted back to the class sizes of all labelled rows).
Spark counts in how many of them each 5- and 6-gram occurs, keeps, of those with
a log-count ratio of ``min_ratio`` or more either way, the ``n_features`` with
the largest standardised ratio, and a logistic regression is fitted, until it
stands still, on the binary features multiplied by their ratios.  Every
document's feature vector has length one, so a long text of a common language
does not outweigh a short one of a rare language.  5-grams are packed integers
and 6-grams 64-bit hashes, not hashes to few buckets, so a clean n-gram does not
share a feature with a toxic one; a bitmap filters the positions of a text before
the exact lookup.

Defined cases: NULL and empty texts, and texts without a known n-gram, get the
score of the intercept; labels other than 0 and 1, and labels with a NULL id, are
not used; of several labels of one id the largest counts.  With no labelled rows of
both classes every score is 0.  Repeated rows are scored each, and a labelled id
that occurs with several texts teaches each of them; an empty table gives no rows.
Only doc_id, text and the label are read, so extra columns may have any name.
Whole texts count, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import annotate, bounded_per_class, doc_texts, held_out, map_arrow, materialise, quoted
from fleetlens.llm.grams import Alphabet, code_points, hashed, packed, squeeze

FILTER_BITS = 22
#: Texts whose n-grams are counted at once.
SLICE = 200
FOLDS, HELD_OUT = 5, 0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(grams: np.ndarray) -> np.ndarray:
    return grams * _MIX >> np.uint64(64 - FILTER_BITS)


def text_grams(text: str | None) -> list[np.ndarray]:
    cp = code_points((text or "").lower())
    if not len(cp):
        return []
    symbols = squeeze(cp, Alphabet.blanks(cp))
    return [packed(symbols, 5), hashed(symbols, 6)]


@dataclass
class LinearModel:
    grams: np.ndarray    # sorted n-grams
    ratios: np.ndarray   # their log-count ratios
    coef: np.ndarray
    bias: float

    def __post_init__(self):
        self._filter = np.zeros(1 << FILTER_BITS, bool)
        self._filter[_slots(self.grams)] = True

    def features(self, text: str | None) -> np.ndarray:
        """Positions of the model's n-grams that occur in the text."""
        found = []
        for g in text_grams(text):
            g = np.unique(g[self._filter[_slots(g)]])
            at = np.searchsorted(self.grams, g)
            at[at == len(self.grams)] = 0
            found.append(at[self.grams[at] == g] if len(self.grams) else at[:0])
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def score(self, text: str | None) -> float:
        x = self.ratios[at] if len(at := self.features(text)) else np.zeros(0)
        return float(_sigmoid(self.bias + (x @ self.coef[at] / np.sqrt(x @ x) if len(x) else 0.0)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(label, text) of the bounded sample, written once, and the weight of a
    row of each class."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id", FOLDS, HELD_OUT))
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    # At most 2 * per_class ids: a proven bound for the broadcast.
    chosen = bounded_per_class(lab, "doc_id", "label", per_class)
    rows = materialise(doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("label", "text"), "labelled")
    have = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    of_all = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return rows, {c: max(1.0, of_all[c] / n) for c, n in have.items()}


def gram_ratios(rows: DataFrame, n_features: int, min_docs: int, min_ratio: float, smooth: float) -> DataFrame:
    """The n-grams with the largest standardised log-count ratio: gram, ratio."""
    def count(batches):
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            parts = [(np.unique(np.concatenate(g)), y) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                     if (g := text_grams(t))]
            if not parts:
                continue
            grams, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            ones = np.concatenate([np.full(len(p), y) for p, y in parts])
            pos = np.bincount(at, weights=ones, minlength=len(grams)).astype(np.int64)
            both = np.bincount(at, minlength=len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(pos), pa.array(both - pos)],
                                             names=["gram", "pos", "neg"])

    counts = (map_arrow(rows.select("label", "text"), count, "gram long, pos long, neg long")
              .groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .where(F.col("pos") + F.col("neg") >= min_docs))
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, n = F.col("pos") + smooth, F.col("neg") + smooth
    ratio = F.log(p / (size[1] + 2 * smooth)) - F.log(n / (size[0] + 2 * smooth))
    strength = F.abs(ratio) / F.sqrt(1 / p + 1 / n)
    return counts.select("gram", ratio.alias("ratio"), strength.alias("s")).where(F.abs("ratio") >= min_ratio).orderBy(F.desc("s"), "gram").limit(n_features)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, n_features: int = 20000,
          min_docs: int = 3, min_ratio: float = 1.0, smooth: float = 1.0, steps: int = 2000, l2: float = 0.01) -> LinearModel:
    rows, weight = training_rows(docs, labels, label, per_class)
    if len(weight) < 2:
        return LinearModel(np.empty(0, np.uint64), np.empty(0), np.empty(0), -40.0)
    best = gram_ratios(rows, n_features, min_docs, min_ratio, smooth).collect()  # n_features rows
    order = np.argsort(np.array([r["gram"] for r in best], np.int64).view(np.uint64))
    grams = np.array([r["gram"] for r in best], np.int64).view(np.uint64)[order]
    ratio = np.array([r["ratio"] for r in best])[order]
    shared = rows.sparkSession.sparkContext.broadcast(LinearModel(grams, ratio, ratio, 0.0))

    def featurise(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([shared.value.features(t).astype(np.int32).tobytes() for t in b.column(1).to_pylist()], pa.binary())],
                names=["label", "at"])

    # At most 2 * per_class rows of at most n_features positions.
    got = map_arrow(rows, featurise, "label int, at binary").collect()
    coef, bias = _fit([np.frombuffer(r["at"], np.int32) for r in got], np.array([r["label"] for r in got], float),
                      np.array([weight[r["label"]] for r in got]), ratio, steps, l2)
    return LinearModel(grams, ratio, coef, bias)


def _fit(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, ratio: np.ndarray, steps: int, l2: float, still: float = 1e-5):
    """Weighted logistic regression on rows of length one by accelerated
    gradient descent, until the gradient is ``still`` or ``steps`` are made."""
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at = np.concatenate(docs) if len(of) else np.empty(0, np.int64)
    x, total = ratio[at], weight.sum()
    x = x / np.sqrt(np.bincount(of, x * x, len(docs)))[of]
    # Curvature bound: a quarter of the squared row length, intercept included, and the penalty.
    rate = 1 / (0.25 * 2 + l2 / total)
    w, v, b, bv = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    for i in range(steps):
        pull = i / (i + 3)
        look, b_look = w + v * pull, b + bv * pull
        err = (_sigmoid(np.bincount(of, x * look[at], len(docs)) + b_look) - y) * weight / total
        slope = np.bincount(at, x * err[of], len(ratio)) + l2 / total * look
        if np.sqrt(slope @ slope + err.sum() ** 2) < still:
            break
        new_w, new_b = look - rate * slope, b_look - rate * err.sum()
        v, bv, w, b = new_w - w, new_b - b, new_w, new_b
    return w, float(b)


FOUND = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def scorer(spark, model, threshold: float):
    shared = spark.sparkContext.broadcast(model)

    def factory():
        def score(texts):
            s = [shared.value.score(t) for t in texts]
            return [pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())]
        return score
    return factory


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels, **how)
    df, name = annotate(doc_texts(docs), "text", FOUND, scorer(docs.sparkSession, model, threshold), ["doc_id"])
    return df.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), f"{name}.score", f"{name}.predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not predicted toxic."""
    model = train(docs, labels, **how)
    df, name = annotate(docs, "text", FOUND, scorer(docs.sparkSession, model, threshold))
    return df.where(F.col(f"{name}.predicted") == 0).select(*quoted(docs.columns))
