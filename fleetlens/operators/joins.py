"""Joins: dimension lookup, revenue per trip, membership and orphan checks.

No broadcast hints: the bus dimension and the parent key sets have no proven
size bound, so the planner decides from file statistics and AQE re-plans a
sort-merge join into a broadcast join only after measuring the shuffled side
at runtime (``spark.sql.adaptive.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.measures import from_unscaled
from fleetlens.operators.aggregates import revenue_cents_per_trip
from fleetlens.schemas import UNKNOWN_PLATE


NULL_KEY_SPREAD = 1024


def with_plate(trip: DataFrame, bus: DataFrame, unknown: str = UNKNOWN_PLATE,
               row_key: str = "trip_id") -> DataFrame:
    """Left join trips to buses; unmatched or missing bus -> ``unknown`` plate.

    Trips without a bus id can never match, but a plain equi-join would hash
    all of them to one partition.  Their join key is spread over
    ``NULL_KEY_SPREAD`` values derived from ``row_key`` and the join
    condition excludes them from matching, so they stay unmatched and are
    spread evenly.  A hot non-NULL bus is left to AQE's skew-join split.
    """
    plates = bus.select(F.col("bus_id").alias("_bus_id"), F.col("plate").alias("_plate"))
    spread = -(F.pmod(F.hash(F.col(row_key)), F.lit(NULL_KEY_SPREAD)).cast("bigint")) - 1
    keyed = trip.withColumn("_join_key", F.coalesce(F.col("bus_id"), spread))
    cond = (keyed["_join_key"] == plates["_bus_id"]) & keyed["bus_id"].isNotNull()
    return (keyed.join(plates, cond, "left")
            .withColumn("plate", F.coalesce(F.col("_plate"), F.lit(unknown)))
            .drop("_plate", "_bus_id", "_join_key"))


def with_revenue(trip: DataFrame, ticket: DataFrame) -> DataFrame:
    """Per trip: ticket revenue, 0 when the trip has no ticket.

    Tickets are aggregated to one row per trip before the join, so a trip
    with millions of validations never fans out.
    """
    return (trip.join(revenue_cents_per_trip(ticket), "trip_id", "left")
            .withColumn("revenue", from_unscaled(F.coalesce(F.col("trip_revenue_cents"), F.lit(0))))
            .drop("trip_revenue_cents"))


def keep_known(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children whose key exists in the parent (NULL keys dropped): semi join."""
    return child.join(parent.select(key), key, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children with a non-NULL key that has no parent (FK violations)."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
