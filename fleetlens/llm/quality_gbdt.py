"""Quality classifier: histogram gradient-boosted trees over document
statistics, flattened into arrays for vectorised numpy traversal.

Training reads at most ``per_class`` labelled documents of each class (chosen
by the hash of the id, weighted back to the class sizes of all labelled rows);
their statistics, a fixed number of doubles a document, are fitted on the
driver.  Scoring computes the statistics of every whole text in the tasks and
walks all trees for a batch at a time.

Defined cases: NULL and empty texts have all-zero statistics and are scored
like any other; labels other than 0 and 1, and labels with a NULL id, are not
used; of several labels of one id the largest counts.  With labelled rows of
one class only, the score is that class; with none it is 0.5.  Repeated rows are
scored each; an empty table gives no rows; only doc_id, text and the label are
read, so extra columns may have any name.  Whole texts count, however long.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import annotate, bounded_per_class, doc_texts, held_out, map_arrow, materialise
from fleetlens.llm.grams import Alphabet, code_points

FOLDS, HELD_OUT = 5, 0

STATISTICS = ("log_chars", "log_words", "word_length", "letters", "upper", "digits", "blanks", "marks", "bars", "bangs",
              "signs", "distinct_words", "top_word", "repeats", "distinct_pairs", "no_letter_words", "upper_words",
              "log_lines", "repeated_lines", "line_words", "stops", "longest_word")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    text = text or ""
    cp = code_points(text)
    if not len(cp):
        return [0.0] * len(STATISTICS)
    n = len(cp)
    ascii_of = np.bincount(np.minimum(cp, 128), minlength=129)
    at = lambda chars: float(sum(ascii_of[ord(c)] for c in chars))
    letters = int(Alphabet.letters(cp).sum())
    digits = float(ascii_of[48:58].sum())
    blanks = int(Alphabet.blanks(cp).sum())
    upper = float(ascii_of[65:91].sum())
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), (n - blanks) / k, letters / n, upper / max(1, letters), digits / n, blanks / n,
        (n - letters - digits - blanks) / n, at("|") / k, at("!") / k, at("#$%&*@~^_=+<>\\") / k,
        len(counts) / k, (max(counts.values()) if counts else 0) / k, same / k,
        len(set(pairwise(words))) / max(1, len(words) - 1),
        sum(not w.isalpha() and not any(map(str.isalpha, w)) for w in counts) / max(1, len(counts)),
        sum(w.isupper() for w in counts) / max(1, len(counts)),
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        at(".?;:") / k, float(max(map(len, counts), default=0)),
    ]


def statistics_matrix(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


@dataclass
class Trees:
    """Complete binary trees of one depth; row t of each array is a tree."""

    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); larger values go right
    leaf: np.ndarray       # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            trees, rows = np.arange(len(self.feature))[:, None], np.arange(len(x))[None, :]
            node = np.zeros((len(self.feature), len(x)), np.int64)
            inner = self.feature.shape[1]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total += self.leaf[trees, node - inner].sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64,
        rate: float = 0.15, l2: float = 1.0) -> Trees:
    """Histogram boosting of the logistic loss."""
    inner, leaves, n_features = 2 ** depth - 1, 2 ** depth, x.shape[1]
    total = weight.sum()
    share = (weight * y).sum() / total if total else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    feature, threshold, leaf = [], [], []
    if total and 0 < share < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_features)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(n_features)])
        z = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (p - y), weight * p * (1 - p)
            node, f_of, t_of = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(depth):
                first, width = 2 ** level - 1, 2 ** level
                f_of[first:first + width], t_of[first:first + width], cut = _splits(binned, node - first, width, g, h, cuts, bins, l2)
                value = binned[f_of[node], np.arange(len(y))]
                node = 2 * node + 1 + (value > cut[node - first])
            at = node - inner
            values = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
            z += values[at]
            feature.append(f_of), threshold.append(t_of), leaf.append(values)
    return Trees(np.array(feature, np.int64).reshape(-1, inner), np.array(threshold).reshape(-1, inner),
                 np.array(leaf).reshape(-1, leaves), base)


def _splits(binned, node, width, g, h, cuts, bins, l2):
    """Best feature, threshold and bin cut for each node of a level; a node
    without a gain keeps an infinite threshold (all rows go left)."""
    best_gain = np.zeros(width)
    best = np.zeros(width, np.int64), np.full(width, np.inf), np.full(width, bins)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        key = node * bins + binned[j]
        gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
        hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
        gt, ht = gl[:, -1:], hl[:, -1:]
        gain = (gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2))[:, :len(cut)]
        at = gain.argmax(axis=1)
        better = gain[np.arange(width), at] > best_gain + 1e-12
        best_gain[better] = gain[np.arange(width), at][better]
        best[0][better], best[1][better], best[2][better] = j, cut[at[better]], at[better]
    return best


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, **how) -> Trees:
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id", FOLDS, HELD_OUT))
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    # At most 2 * per_class ids: a proven bound for the broadcast.
    chosen = bounded_per_class(lab, "doc_id", "label", per_class)
    rows = doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("label", "text")

    def measure(batches):
        for b in batches:
            x = statistics_matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    # At most 2 * per_class rows of len(STATISTICS) doubles; sorted, so that the fit does not depend on the partitioning.
    measured = materialise(map_arrow(rows, measure, "label int, x binary"), "statistics")
    got = sorted((r["label"], bytes(r["x"])) for r in measured.collect())
    y = np.array([r[0] for r in got], float)
    x = np.array([np.frombuffer(r[1]) for r in got]).reshape(len(got), len(STATISTICS))
    of_all = {r["label"]: r["n"] for r in lab.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = np.array([max(1.0, of_all[int(c)] / max(1, (y == c).sum())) for c in y])
    return fit(x, y, weight * len(y) / max(weight.sum(), 1e-9), **how)


FOUND = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))

    def factory():
        def score(texts):
            s = shared.value.score(statistics_matrix(texts))
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
        return score

    df, name = annotate(doc_texts(docs), "text", FOUND, factory, ["doc_id"])
    return df.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), f"{name}.score", f"{name}.predicted")
