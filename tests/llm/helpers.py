"""Small document tables for the operator tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = ("found", "score", "id", "sig", "n", "range", "label", "lanes", "component", "h", "hash", "n_tokens", "rank")


def docs_table(spark, rows, clash=False):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    return df


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def edited(text, seed, k):
    """k words replaced."""
    r, w = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(w)), k):
        w[i] = f"z{r.randrange(10 ** 9)}"
    return " ".join(w)


EDGE_TEXTS = [None, "", " ", "\n\n", "a", "ein Wort", "...", "ñandú Éa 東京", "x" * 50_000, "w " * 30_000]


def edge_docs(spark, clash=False):
    """NULL ids, repeated ids, repeated rows, odd and long texts."""
    rows = list(enumerate(EDGE_TEXTS)) + [(None, "no id"), (None, None), (3, "again three"), (3, "again three"), (4, "a")]
    return docs_table(spark, rows, clash)
