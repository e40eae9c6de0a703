"""Multi-dimensional physical layout: one sort order that serves filters on any
of several columns.

Each column is cut at its quantiles into 2^bits ranges; the bits of the range
numbers, interleaved, are the place on a space-filling curve.  The curve's first
bits name a box of all columns.  A file holds rows of one box only, sorted by
their place, and a box with many rows is dealt to several files, so the minima and
maxima of the footers let a filter on one day, one line or one vehicle skip most
files and row groups.  Point lookups on columns without an order in the layout
(trip ids) go by Parquet Bloom filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows sampled to find the quantiles; they move the boxes, never results.
SAMPLE_ROWS = 200_000
_PLACE, _BOX, _PART = "_place", "_box", "_part"


def quantile_cuts(df: DataFrame, column: str, ranges: int) -> list:
    """The upper-open cut points of ``ranges`` about equal parts of a column of
    any ordered type, by the sampled range partitioner (one row a cut)."""
    parts = (df.select(F.col(column).alias("v")).where("v is not null").repartitionByRange(ranges, "v")
             .groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("v")))
    return sorted(r["v"] for r in parts.collect())[1:]


def range_number(column: str, cuts: list) -> Column:
    """How many cuts are at or below the value (NULL: 0)."""
    n = F.lit(0)
    for c in cuts:
        n = n + F.coalesce((F.col(column) >= F.lit(c)).cast("int"), F.lit(0))
    return n


def interleaved(numbers: list[Column], bits: int) -> Column:
    """The bits of the numbers in turn, the highest first."""
    place = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for n in numbers:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(n.cast("long"), b).bitwiseAND(F.lit(1).cast("long")))
    return place


def write_curve(df: DataFrame, path: str, columns: list[str], tie: list[str], bits: int = 4, files: int | None = None,
                bloom: dict[str, int] | None = None, group_bytes: int | None = None) -> None:
    """Write ``df`` in the order of the curve over ``columns``.

    There are about ``files`` files (the session's shuffle width by default):
    as many boxes, a box with more rows than its share having more files, among
    which the rows are dealt by the key ``tie``.  ``bloom`` maps columns to their
    expected number of distinct values in a file; ``group_bytes`` is Parquet's row
    group size."""
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    sample = df.select(*columns).sample(min(1.0, SAMPLE_ROWS / max(total, 1)), seed=1) if total > SAMPLE_ROWS else df.select(*columns)
    numbers = [range_number(c, quantile_cuts(sample, c, 1 << bits)) for c in columns]
    rest = max(0, bits * len(columns) - max(0, files.bit_length() - 1))
    placed = df.withColumn(_PLACE, interleaved(numbers, bits)).withColumn(_BOX, F.shiftright(_PLACE, rest).cast("int"))
    counts = {r[_BOX]: r["n"] for r in placed.groupBy(_BOX).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``files`` boxes
    first, share, at = [], [], 0
    for box in range(max(counts, default=0) + 1):
        first.append(at)
        share.append(max(1, -(-counts.get(box, 0) * files // max(total, 1) // 2)))  # twice the mean, then another file
        at += share[-1] if box in counts else 0
    part = F.get(F.array(*map(F.lit, first)), F.col(_BOX)) + F.pmod(F.xxhash64(*tie), F.get(F.array(*map(F.lit, share)), F.col(_BOX))).cast("int")
    out = placed.withColumn(_PART, part).repartitionById(max(at, 1), F.col(_PART)).sortWithinPartitions(_PLACE, *tie)
    w = out.drop(_PLACE, _BOX, _PART).write.mode("errorifexists")
    for c, n in (bloom or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(n))
    if group_bytes:
        w = w.option("parquet.block.size", str(group_bytes))
    w.parquet(path)
