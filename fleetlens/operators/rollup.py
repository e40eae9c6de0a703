"""Daily KPIs kept by deltas: inserts, updates and cascaded deletes change a
day's figures without a look at its other trips.

A day is stored as sums and counts, which add up and can be taken away again;
averages and rates are made from them when the table is read.  A change is given
as the rows that go and the rows that come, trips and their tickets; it is summed
per day and added to the stored days in one transaction.  The ledger of the
manifest remembers the change by its id, so a repeated one changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.measures import count_if, from_unscaled, on_time_flag, rounded_ratio, unscaled
from fleetlens.operators.aggregates import revenue_cents_per_trip
from fleetlens.operators.manifest import Manifest, Transaction
from fleetlens.operators.tables import stored

STATE, MONTH = "kpi_state", "service_month"
_SUMS = ("trips", "km_cents", "boardings", "boardings_n", "revenue_cents", "occupancy_units", "occupancy_n", "delay", "on_time", "km_n")


def day_state(trip: DataFrame, ticket: DataFrame, sign: int = 1) -> DataFrame:
    """(service_date, sums ...) of trips and the tickets of these trips, with a sign."""
    per_trip = trip.join(revenue_cents_per_trip(ticket), "trip_id", "left")
    sums = {
        "trips": F.count(F.lit(1)),
        "km_cents": F.coalesce(F.sum(unscaled("km")), F.lit(0)), "km_n": F.count("km"),
        "boardings": F.coalesce(F.sum(F.col("boardings").cast("long")), F.lit(0)), "boardings_n": F.count("boardings"),
        "revenue_cents": F.coalesce(F.sum("trip_revenue_cents"), F.lit(0)),
        "occupancy_units": F.coalesce(F.sum(unscaled("occupancy_pct")), F.lit(0)), "occupancy_n": F.count("occupancy_pct"),
        "delay": F.coalesce(F.sum(F.coalesce(F.col("delay_min"), F.lit(0)).cast("long")), F.lit(0)),
        "on_time": count_if(on_time_flag("delay_min")),
    }
    return per_trip.groupBy("service_date").agg(*[(F.lit(sign) * sums[c]).cast("long").alias(c) for c in _SUMS])


def finished(state: DataFrame) -> DataFrame:
    """The daily KPIs, as ``daily_kpi`` gives them, from the stored sums."""
    return state.select(
        "service_date", F.when(F.col("km_n") > 0, from_unscaled(F.col("km_cents"))).alias("total_km"),
        F.when(F.col("boardings_n") > 0, F.col("boardings")).alias("total_boardings"),
        from_unscaled(F.col("revenue_cents")).alias("total_revenue"),
        rounded_ratio(from_unscaled(F.col("occupancy_units")), F.col("occupancy_n"), 2).alias("avg_occupancy"),
        rounded_ratio(F.col("delay"), F.col("trips"), 2).alias("avg_delay_min"),
        rounded_ratio(F.col("on_time") * 100, F.col("trips"), 2).alias("on_time_pct"))


@dataclass
class Change:
    """Rows that go and rows that come.  A trip that changes is in both, and so
    are its tickets if its date changes; a new or deleted ticket of an unchanged
    trip comes with that trip's (trip_id, service_date) in ``dates``."""

    trips_out: DataFrame | None = None
    tickets_out: DataFrame | None = None
    trips_in: DataFrame | None = None
    tickets_in: DataFrame | None = None
    dates: DataFrame | None = None


def delta(change: Change) -> DataFrame:
    """Signed sums per day: reads the change only."""
    parts = []
    for trips, tickets, sign in ((change.trips_out, change.tickets_out, -1), (change.trips_in, change.tickets_in, 1)):
        if trips is not None:
            known = tickets if tickets is not None else trips.select("trip_id", F.lit(None).cast("decimal(12,2)").alias("amount_eur"))
            parts.append(day_state(trips, known, sign))
        if tickets is not None and change.dates is not None:
            cents = revenue_cents_per_trip(tickets).join(change.dates.select("trip_id", "service_date"), "trip_id")
            own = cents.groupBy("service_date").agg((F.lit(sign) * F.sum("trip_revenue_cents")).cast("long").alias("revenue_cents"))
            parts.append(own.select("service_date", *[(F.col(c) if c == "revenue_cents" else F.lit(0).cast("long")).alias(c) for c in _SUMS]))
    if not parts:
        raise ValueError("a change without rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("service_date").agg(*[F.sum(c).alias(c) for c in _SUMS])


def apply(spark: SparkSession, root: str, change: Change, change_id: str) -> DataFrame:
    """Add a change to the days stored at ``root`` and return the KPIs.  Days
    without trips go; a change that was applied before changes nothing."""
    def step(t: Transaction) -> None:
        new = stored(delta(change))
        if not t.append("changes", new.withColumn("change_id", F.lit(change_id)), load_id=change_id):
            return
        if t.has(STATE):
            old = t.read(STATE).drop(MONTH).join(new.select("service_date"), "service_date", "left_semi")
            new = old.unionByName(new).groupBy("service_date").agg(*[F.sum(c).alias(c) for c in _SUMS])
        t.upsert(STATE, new.withColumn(MONTH, F.date_format("service_date", "yyyy-MM")), ["service_date"], MONTH, F.date_format("service_date", "yyyy-MM"))

    Manifest(spark, root).update(step)
    return read(spark, root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The KPIs of all stored days that still have trips."""
    return finished(Manifest(spark, root).read(STATE).where("trips > 0"))
