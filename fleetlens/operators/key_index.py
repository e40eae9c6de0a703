"""Uniqueness across loads: a load is tested against the stored keys through a
persisted bitmap index, not by a scan of the table.

Keys are whole numbers given mostly in sequence.  The index holds, for each range
of 32,768 keys that has one, a bitmap with one bit a key (4 KB), and the stored
keys themselves by coarse key range.  A load joins its ranges with the bitmaps: a
new range has none, and a set bit means the key is there.  Only for such hits are
stored keys counted, reading the ranges in which they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.manifest import Manifest, Transaction
from fleetlens.operators.tables import stored

BITMAPS, KEYS = "bitmaps", "keys"
#: Stored keys are kept in ranges of this many, to be read range by range.
RANGE = 1 << 24


def _range(key: str) -> Column:
    return F.floor(F.col(key) / RANGE).cast("long")


def _is_set(bitmap: str, position: str) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast({position} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), F.col(position) % 8)) % 2 == 1


def known_keys(keys: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, ...) whose key the index has."""
    placed = keys.withColumn("bucket", F.bitmap_bucket_number("key")).withColumn("position", F.bitmap_bit_position("key"))
    return placed.join(bitmaps.select("bucket", "bitmap"), "bucket").where(_is_set("bitmap", "position")).drop("bucket", "position", "bitmap")


def add_load(spark: SparkSession, root: str, load: DataFrame, key: str) -> DataFrame:
    """Test a load's key against all loads before and in itself, add its keys
    to the index, and return the violations as (key_value, dup_count): how
    often each repeated key of this load is now in all loads.  NULLs are no keys."""
    found = []

    def step(t: Transaction) -> None:
        keys = stored(load.select(F.col(key).cast("long").alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        twice, part = keys.where("n > 1"), F.floor(F.col("bucket") * 32768 / RANGE).cast("long")
        bits = keys.groupBy(F.bitmap_bucket_number("key").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bitmap"))
        bits = stored(bits.withColumn("part", part))
        old = None
        if t.has(BITMAPS):
            parts = [f"v{r['part']}" for r in bits.select("part").distinct().collect()]  # one for each 16 million keys
            old = t.manifest.frame(t.next, BITMAPS, parts)
            hits = stored(known_keys(keys, old))
            ranges = [r["r"] for r in hits.select(_range("key").alias("r")).distinct().collect()]  # one for each 16 million keys
            before = t.manifest.frame(t.next, KEYS, [f"v{r}" for r in ranges]).select("key", "n")
            both = hits.select("key").join(before, "key").unionByName(hits.select("key", "n"))
            twice = both.groupBy("key").agg(F.sum("n").alias("n")).unionByName(twice.join(hits.select("key"), "key", "left_anti"))
        found.append(stored(twice.select(F.col("key").alias("key_value"), F.col("n").alias("dup_count"))))
        if old is not None:
            same = old.join(bits.select("bucket"), "bucket", "left_semi")
            bits = same.unionByName(bits).groupBy("bucket", "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        t.upsert(BITMAPS, bits.select("bucket", "bitmap", "part"), ["bucket"], "part", part)
        rows = keys.withColumn("part", _range("key"))
        if t.has(KEYS):
            t.append(KEYS, rows)
        else:
            t.overwrite(KEYS, rows, "part")

    Manifest(spark, root).update(step)
    return found[-1]
