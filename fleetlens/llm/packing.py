"""Optimal length buckets: dynamic programming over the global length histogram
chooses the bucket boundaries with the least padding, and batches under a token
budget form inside each bucket.

A document's length is the number of its token ids plus one end id; without a
tokenizer it is the number of its words plus one.  The histogram counts every
length exactly, so the boundaries are optimal; it has at most as many cells as
the longest document has tokens, however many documents there are.  Every document
goes to the first bucket whose boundary holds it and is padded to it; a batch of a
bucket holds floor(budget / boundary) documents, one at least.  Positions in a
bucket follow the hash of the id.  They are numbered in slices of a bucket of
about ``slice_rows`` rows, with offsets from the slice counts, so no task sorts
a whole bucket.  Rows of equal id and length differ in nothing but their place:
they are numbered as one group with a count, and places are dealt out by
``slice_rows`` at a time, so neither does a task hold all copies of one id.  Rows
without an id are dealt to slices by their length and a hash of their text.

Defined cases: a NULL or empty text has length 1; a document longer than the
budget is a batch of its own; rows with a NULL id take their place by their
length and text; repeated rows take a place each; with fewer distinct lengths than
buckets there are fewer buckets; an empty table gives no rows; only doc_id and text
are read, so extra columns may have any name.  Whole texts count, however long.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import doc_texts, map_arrow, materialise
from fleetlens.llm.token_rans import shared_tokenizer

WORD = r"[^\x20\x09-\x0D]+"
#: Groups into which rows without an id are dealt, by the hash of their text.
NULL_GROUPS = 4096


def word_length(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long") + 1


def lengths(docs: DataFrame, tokenizer_path: str | None) -> DataFrame:
    """doc_id, salt and n_tokens of every document."""
    texts = doc_texts(docs).withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(NULL_GROUPS))).otherwise(F.lit(0)).cast("int"))
    if tokenizer_path is None:
        return texts.select("doc_id", "salt", word_length("text").alias("n_tokens"))

    def run(batches):
        tokenizer = shared_tokenizer(tokenizer_path, only_counts=True)
        for b in batches:
            n = [1 + k for i in range(0, b.num_rows, 512) for k in tokenizer.counts([t or "" for t in b.column(2).slice(i, 512).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "salt", "n_tokens"])

    return map_arrow(texts.select("doc_id", "salt", "text"), run, "doc_id long, salt int, n_tokens long", "tokenizer")


def boundaries(cells: list[tuple[int, int]], buckets: int) -> list[int]:
    """Boundaries with the least padding for (length, documents) cells.

    The padding of cells i..j-1 under boundary b is b * documents - tokens, so
    each layer takes the lower envelope of lines with falling slopes.
    """
    cells = sorted(cells)
    if not cells:
        return []
    count, tokens = [0], [0]
    for length, docs in cells:
        count.append(count[-1] + docs)
        tokens.append(tokens[-1] + length * docs)
    n = len(cells)
    best: list[float | int] = [0] + [float("inf")] * n
    back: list[list[int]] = []
    for _ in range(min(buckets, n)):
        new, came = [float("inf")] * (n + 1), [0] * (n + 1)
        lines: deque[tuple[int, int, int]] = deque()  # slope, height, start
        for j in range(1, n + 1):
            if best[j - 1] != float("inf"):
                line = (-count[j - 1], best[j - 1] + tokens[j - 1], j - 1)
                while len(lines) >= 2 and _hidden(lines[-2], lines[-1], line):
                    lines.pop()
                lines.append(line)
            b = cells[j - 1][0]
            while len(lines) >= 2 and lines[1][0] * b + lines[1][1] <= lines[0][0] * b + lines[0][1]:
                lines.popleft()
            if lines:
                new[j] = lines[0][0] * b + lines[0][1] + b * count[j] - tokens[j]
                came[j] = lines[0][2]
        best = new
        back.append(came)
    found, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        found.append(cells[j - 1][0])
        j = came[j]
    return sorted(found)


def _hidden(a, b, c) -> bool:
    """Whether the middle of three lines of falling slope is nowhere lowest."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, tokenizer_path: str | None = None, buckets: int = 16, budget: int = 32768, slice_rows: int = 50_000) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, padded (its boundary), batch
    (number inside the bucket), place (inside the batch), padding."""
    measured = lengths(docs, tokenizer_path)
    groups = materialise(measured.groupBy("doc_id", "salt", "n_tokens").agg(F.count("*").alias("copies")), "lengths")
    hist = [(r["n_tokens"], r["n"]) for r in groups.groupBy("n_tokens").agg(F.sum("copies").alias("n")).collect()]  # a row a length
    bounds = boundaries(hist, buckets)
    if not bounds:
        bounds = [1]
    size = [0] * len(bounds)
    for length, n in hist:
        size[sum(b < length for b in bounds)] += n
    slices = [max(1, -(-n // slice_rows)) for n in size]
    def of_bucket(values: list[int]) -> Column:
        return F.expr(f"element_at(array({', '.join(f'{v}L' for v in values)}), bucket + 1)")

    of = "size(filter(array(" + ", ".join(f"{b}L" for b in bounds) + "), b -> b < n_tokens))"
    order = F.xxhash64(F.coalesce("doc_id", "n_tokens"), "salt")
    # Few numbers a bucket as literals: rows of the driver's would take Python workers of a second kind on the executors.
    placed = (groups.withColumn("bucket", F.expr(of)).withColumn("padded", of_bucket(bounds))
              .withColumn("holds", of_bucket([max(1, budget // b) for b in bounds]))
              .withColumn("slice", F.pmod(order, of_bucket(slices))))
    counts = placed.groupBy("bucket", "slice").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "slice", F.coalesce(before, F.lit(0)).alias("offset"))
    earlier = Window.partitionBy("bucket", "slice").orderBy(order, "doc_id", "n_tokens", "salt").rowsBetween(Window.unboundedPreceding, -1)
    part = F.explode(F.expr(f"sequence(0L, (copies - 1) div {slice_rows}L)"))
    copy = F.explode(F.expr(f"sequence(part * {slice_rows}L, least(copies, (part + 1) * {slice_rows}L) - 1)"))
    at = F.col("offset") + F.col("rank") + F.col("copy")
    return (placed.withColumn("rank", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).join(offsets, ["bucket", "slice"])
            .withColumn("part", part).repartition("doc_id", "salt", "n_tokens", "part").withColumn("copy", copy)
            .select("doc_id", "n_tokens", "bucket", "padded", F.floor(at / F.col("holds")).cast("long").alias("batch"),
                    F.pmod(at, F.col("holds")).alias("place"), (F.col("padded") - F.col("n_tokens")).alias("padding")))
