"""Homomorphic multiset hash of a document's paragraphs, in DataFrame
expressions only.

A paragraph (non-blank trimmed line) is hashed to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors, each lane modulo
its power of two.  So it does not depend on the order of the paragraphs, equal
texts have equal fingerprints, and a paragraph is inserted or deleted by adding
or subtracting its vector (``add``, ``subtract``).  The lanes of a paragraph are

- 1 lane modulo 2^32: the number of its sentences;
- 64 lanes modulo 2^48: the sum over its sentences of a Cauchy variate drawn
  from a seeded hash of the sentence, in steps of 1 / 256;
- 8 lanes modulo 2^32: the halves of four seeded 64-bit hashes of the whole
  paragraph, which tell unequal multisets apart.

The Cauchy sums are a sketch of the 1-norm: where sentence s occurs x_s times in
one document and y_s times in the other, the difference of a lane is a Cauchy
variate of scale D, the sum of |x_s - y_s|, however often a sentence is repeated.
So the median of the 64 absolute differences estimates D (standard error about
a fifth), which is never below |n - m| for sentence counts n and m, and
(n + m - D) / (n + m + D) is the multiset Jaccard similarity.  A text has fewer
than 2^31 sentences, so a median of 256 D is far below the modulus.

Defined cases: a NULL text counts as empty; a text without a non-blank line has
the zero vector, whose likeness to itself is 1 and to any other vector 0;
repeated paragraphs count as often as they occur.  Rows with equal doc_id are
ordered by the hash of their text and then the text, a NULL doc_id comes first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import doc_texts

NORM_LANES = 64
NORM_BITS = 48
STEP = 256  # lane units of a variate of 1
SEEDS = (11, 23, 37, 53)
MODULI = [2 ** 32] + [2 ** NORM_BITS] * NORM_LANES + [2 ** 32] * (2 * len(SEEDS))
_SENTENCE = r"(?<=[.!?])\\s+|\\n"
_MASK = (1 << NORM_BITS) - 1


def _parts(text: str, pattern: str) -> str:
    return f"filter(transform(split({text}, '{pattern}'), x -> trim(x)), x -> x != '')"


def with_lanes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append the fingerprint of a text column as an array of lanes."""
    # tan of a uniform angle from -pi/2 to pi/2; the largest double below pi/2 has a tangent under 2^54.
    norms = ", ".join(f"aggregate(_h, 0L, (a, h) -> (a + cast({STEP}D * tan(xxhash64(h, {k}L) * {math.pi / 2 ** 64!r}D) as bigint)) & {_MASK}L)"
                      for k in range(NORM_LANES))
    wide = ", ".join(f"aggregate(_p, 0L, (a, p) -> a + (xxhash64(p, {s}) & 4294967295L)) & 4294967295L, "
                     f"aggregate(_p, 0L, (a, p) -> a + shiftrightunsigned(xxhash64(p, {s}), 32)) & 4294967295L" for s in SEEDS)
    kept = df.columns
    return (df.withColumn("_h", F.expr(f"transform({_parts(f"coalesce({text}, '')", _SENTENCE)}, x -> xxhash64(x))"))
            .withColumn("_p", F.expr(_parts(f"coalesce({text}, '')", r"\\n")))
            .withColumn("_s", F.expr(f"array({norms})")).withColumn("_w", F.expr(f"array({wide})"))
            .select(*kept, F.expr(
                "concat(array(cast(size(_h) as bigint)), _s, _w)").alias(out)))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    mods = F.array(*[F.lit(m).cast("long") for m in MODULI])
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + sign * y), mods, lambda x, m: F.pmod(x, m))


def add(a: Column, b: Column) -> Column:
    """Fingerprint lanes of the union of two paragraph multisets."""
    return _lanewise(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint lanes after deleting the paragraphs of ``b``."""
    return _lanewise(a, b, -1)


def to_hex(lanes: Column) -> Column:
    """Lanes as one lower-case hex string of fixed width."""
    def part(first: int, count: int, digits: int) -> Column:
        return F.array_join(F.transform(F.slice(lanes, first, count), lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")
    return F.concat(part(1, 1, 8), part(2, NORM_LANES, NORM_BITS // 4), part(2 + NORM_LANES, 2 * len(SEEDS), 8))


def likeness(a: str, b: str) -> Column:
    """Estimated multiset Jaccard similarity of two lane columns, 0 to 1."""
    n, m = f"element_at({a}, 1)", f"element_at({b}, 1)"
    half = 1 << (NORM_BITS - 1)
    step = f"abs(((x - y + {half}L) & {_MASK}L) - {half}L)"  # difference nearest to 0
    steps = (f"array_sort(zip_with(slice({a}, 2, {NORM_LANES}), slice({b}, 2, {NORM_LANES}), (x, y) -> {step}))")
    middle = f"aggregate(slice({steps}, {NORM_LANES // 2}, 2), 0D, (t, d) -> t + d) / {2 * STEP}"
    diff = f"greatest({middle}, abs({n} - {m}))"
    return F.expr(f"case when {a} = {b} then 1D when {n} + {m} = 0 then 0D "
                  f"else greatest(0D, least(1D, ({n} + {m} - {diff}) / ({n} + {m} + {diff}))) end")


def with_next(docs: DataFrame, lanes: str) -> DataFrame:
    """doc_id, text and lanes of each document beside ``next_text`` and
    ``next_lanes`` of the one that follows in ascending doc_id, the first
    document following the last.

    Rows are dealt to ranges of doc_id whose bounds are quantiles, four times
    as many as shuffle partitions.  The first row of a range also goes, marked,
    to the range before, so each text crosses the network once.
    """
    spark = docs.sparkSession
    docs = doc_texts(docs)
    n_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / n_ranges for i in range(1, n_ranges)]
    bounds = docs.agg(F.percentile_approx("doc_id", at, 100 * n_ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    placed = docs.withColumn("range", _range_of("doc_id", bounds))
    firsts = (placed.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"))).alias("f"))
              .orderBy("range").select("range", "f.doc_id").collect())  # a row per range
    before = [(r["doc_id"], firsts[i - 1]["range"], i == 0) for i, r in enumerate(firsts)]
    ahead = F.broadcast(spark.createDataFrame(before, "first_id long, to_range int, wraps boolean"))
    own = F.struct(F.col("range"), F.lit(False).alias("ahead"), F.lit(False).alias("wraps"))
    copy = F.struct(F.col("to_range").alias("range"), F.lit(True).alias("ahead"), F.col("wraps"))
    dealt = (placed.join(ahead, F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
             .select("doc_id", "text", F.explode(F.when(F.col("to_range").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"))
             .select("doc_id", "text", "to.*").repartition("range"))
    w = Window.partitionBy("range").orderBy("wraps", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    return (with_lanes(dealt, "text", lanes)
            .withColumn("next_text", F.lead("text").over(w)).withColumn("next_lanes", F.lead(lanes).over(w))
            .where("not ahead").select("doc_id", "text", lanes, "next_text", "next_lanes"))


def _range_of(column: str, bounds: list[int]) -> Column:
    """Number of bounds not above the value, by blocks of 64 bounds."""
    if not bounds:
        return F.lit(0)
    every = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    heads = "array(" + ", ".join(f"{b}L" for b in bounds[::64]) + ")"
    block = f"greatest(size(filter({heads}, b -> b <= {column})) - 1, 0)"
    return F.expr(f"case when {column} is null then 0 else {block} * 64 + "
                  f"size(filter(slice({every}, {block} * 64 + 1, 64), b -> b <= {column})) end")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256 and fingerprint of the text
    with its second half replaced by the start of the next document, and the
    likeness of the fingerprint to the edited and to the next text's."""
    rows = (with_next(docs, "lanes").withColumn("text", F.coalesce("text", F.lit("")))
            .withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), "
                                         "substring(coalesce(next_text, ''), 1, int(n_chars div 2)))")))
    rows = with_lanes(rows.select("doc_id", "n_chars", "edited", "lanes", "next_lanes"), "edited", "edited_lanes")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       to_hex(F.col("lanes")).alias("fingerprint"), to_hex(F.col("edited_lanes")).alias("edited_fingerprint"),
                       likeness("lanes", "edited_lanes").alias("near_edited"), likeness("lanes", "next_lanes").alias("near_next"))
