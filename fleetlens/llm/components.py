"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum (pre-aggregated before the shuffle) and a join,
so neither a hub nor a component meets in one task, and no link reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, release, small


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): every id that has a link, with the
    smallest id it is connected to.  Self links and NULL ends are ignored."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    rows = edges.count()  # stars never make it more
    while True:
        last = edges
        edges = materialise(_small_star(_large_star(last, rows), rows), "stars")
        release(last)
        # Done when every id hangs on one centre and no centre hangs on another.
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            edges.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty():
            break
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(ids.select(F.col("component").alias("id"), "component").distinct())


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(small(least, 2 * rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(down: DataFrame, rows: int) -> DataFrame:
    """Links a node and its smaller neighbours (u > v) to the smallest of them."""
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(small(least, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
