"""Global and grouped KPI aggregations (overview tiles, per line, per day).

Every operator is one ``agg`` over partial-aggregable measures, so hot keys
(a line or a day holding a third of all trips) are combined map-side before
the shuffle.  Joins are always made after aggregating the many side to the
join key, never on raw rows (no fan-out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.measures import (avg_delay, count_if, decimal_sum, exact_avg, from_unscaled,
                                          long_sum, on_time_flag, on_time_rate, rounded_ratio, scaled_sum,
                                          unscaled)
from fleetlens.schemas import (BUS_STATUS_ACTIVE, BUS_STATUS_IN_MAINTENANCE,
                               TRIP_STATUS_CANCELLED, UNKNOWN_PLATE)


def _overview_measures() -> dict:
    """Dashboard tiles: trips, occupancy, delay (NULL skipped), boardings,
    energy (NULL as 0, whole kWh), punctuality (NULL delay on time)."""
    return {
        "trips": F.count(F.lit(1)),
        "avg_occupancy": exact_avg("occupancy_pct", 1),
        "avg_delay_min": avg_delay("delay_min", "skip_null", 1),
        "boardings": long_sum("boardings"),
        "energy_kwh": F.round(F.sum(F.coalesce(F.col("energy_kwh"), F.lit(0))), 0).cast("decimal(22,0)"),
        "on_time_pct": on_time_rate("delay_min", null_is_on_time=True, digits=1),
    }


def _report_measures() -> dict:
    """Report tiles: trips, boardings, occupancy, delay (NULL as 0), km, punctuality."""
    return {
        "trips": F.count(F.lit(1)),
        "boardings": long_sum("boardings"),
        "avg_occupancy": exact_avg("occupancy_pct", 1),
        "avg_delay_min": avg_delay("delay_min", "null_as_zero", 1),
        "total_km": decimal_sum("km", 0, "decimal(22,0)"),
        "on_time_pct": on_time_rate("delay_min", null_is_on_time=True, digits=1),
    }


def _null_as_zero(df: DataFrame, names) -> DataFrame:
    """Replace NULL by 0 (of the column's type) in ``names``; other columns kept."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c) if c in names else F.col(c)
                       for c in df.columns])


def overview_kpi(trip: DataFrame) -> DataFrame:
    return trip.agg(*[c.alias(n) for n, c in _overview_measures().items()])


def report_kpi(trip: DataFrame) -> DataFrame:
    return trip.agg(*[c.alias(n) for n, c in _report_measures().items()])


def report_kpi_nullsafe(trip: DataFrame) -> DataFrame:
    """``report_kpi`` with every missing measure replaced by 0 (empty input)."""
    kpi = report_kpi(trip)
    return _null_as_zero(kpi, kpi.columns)


def overview_and_report_kpi(trip: DataFrame) -> DataFrame:
    """The overview block (``o_<name>``) and the NULL-safe report block
    (``r_<name>``) from one aggregate pass over the trips.  Measures the two
    blocks share (trip count, punctuality, ...) are computed once."""
    o, r = _overview_measures(), _report_measures()
    row = trip.agg(*[c.alias("o_" + n) for n, c in o.items()], *[c.alias("r_" + n) for n, c in r.items()])
    return _null_as_zero(row, ["r_" + n for n in r])


def ticket_kpi(ticket: DataFrame) -> DataFrame:
    return ticket.agg(
        F.count(F.lit(1)).alias("validations"),
        decimal_sum("amount_eur", 2).alias("revenue"),
        exact_avg("amount_eur", 2).alias("avg_ticket"),
    )


def bus_count(bus: DataFrame) -> DataFrame:
    return bus.agg(F.count(F.lit(1)).alias("total_buses"))


def count_where(df: DataFrame, cond, name: str) -> DataFrame:
    """COUNT(*) of the rows matching ``cond`` (a filter, pushed to the scan)."""
    return df.where(cond).agg(F.count(F.lit(1)).alias(name))


def total_km(legacy_trip: DataFrame) -> DataFrame:
    return legacy_trip.agg(F.coalesce(scaled_sum("km"), F.lit(0)).cast("decimal(22,2)").alias("total_km"))


def avg_occupancy(legacy_trip: DataFrame) -> DataFrame:
    return legacy_trip.agg(exact_avg("occupancy_pct", 2).alias("avg_occupancy"))


def occupancy_and_km(legacy_trip: DataFrame) -> DataFrame:
    """``avg_occupancy`` and ``total_km`` in one aggregate pass."""
    return legacy_trip.agg(exact_avg("occupancy_pct", 2).alias("avg_occupancy"),
                           F.coalesce(scaled_sum("km"), F.lit(0)).cast("decimal(22,2)").alias("total_km"))


def line_punctuality(trip: DataFrame) -> DataFrame:
    """Per line: punctuality with NULL delay counted late, delay average
    skipping NULLs (the dashboard chart)."""
    return (trip.groupBy("line")
            .agg(on_time_rate("delay_min", null_is_on_time=False, digits=1).alias("on_time_pct"),
                 avg_delay("delay_min", "skip_null", 1).alias("avg_delay_min"))
            .orderBy("line"))


def line_report(trip: DataFrame) -> DataFrame:
    """Per line: trips, delay (NULL as 0), punctuality (NULL on time)."""
    return (trip.groupBy("line")
            .agg(F.count(F.lit(1)).alias("trips"),
                 avg_delay("delay_min", "null_as_zero", 1).alias("avg_delay_min"),
                 on_time_rate("delay_min", null_is_on_time=True, digits=1).alias("on_time_pct"))
            .orderBy("line"))


def counts_by(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def daily_averages(trip: DataFrame) -> DataFrame:
    return (trip.groupBy("service_date")
            .agg(avg_delay("delay_min", "skip_null", 2).alias("avg_delay_min"),
                 exact_avg("occupancy_pct", 2).alias("avg_occupancy"))
            .orderBy("service_date"))


def fare_summary(ticket: DataFrame) -> DataFrame:
    return (ticket.groupBy("fare_type")
            .agg(F.count(F.lit(1)).alias("ticket_count"),
                 decimal_sum("amount_eur", 2).alias("revenue"))
            .orderBy(F.desc("ticket_count"), F.asc("fare_type")))


def daily_revenue(ticket: DataFrame) -> DataFrame:
    """Revenue per validation date (the ticket's own date, not the trip's)."""
    return (ticket.groupBy(F.to_date("validated_at").alias("validation_date"))
            .agg(decimal_sum("amount_eur", 2).alias("revenue"))
            .orderBy("validation_date"))


def revenue_cents_per_trip(ticket: DataFrame) -> DataFrame:
    """Ticket revenue per trip id in cents (BIGINT): the many side
    pre-aggregated to the join key, map-side combined."""
    return (ticket.where(F.col("trip_id").isNotNull())
            .groupBy("trip_id").agg(F.sum(unscaled("amount_eur")).alias("trip_revenue_cents")))


def daily_kpi(trip: DataFrame, ticket: DataFrame) -> DataFrame:
    """Daily KPI rollup: km, boardings, ticket revenue of the day's trips,
    occupancy, delay (NULL as 0) and punctuality (NULL on time), 2 digits.

    Plan: tickets -> partial/final aggregate by trip_id -> left join on
    trip_id (the aggregate is already hash-partitioned by trip_id, so only
    the trip side is exchanged; AQE turns it into a broadcast when the
    runtime size allows) -> partial/final aggregate by service_date.
    """
    return daily_kpi_from_revenue(trip, revenue_cents_per_trip(ticket))


def daily_kpi_from_revenue(trip: DataFrame, trip_revenue_cents: DataFrame) -> DataFrame:
    """``daily_kpi`` from trips and an already aggregated per-trip revenue
    table (trip_id, trip_revenue_cents): one row per trip on both sides."""
    per_trip = trip.join(trip_revenue_cents.select("trip_id", "trip_revenue_cents"), "trip_id", "left")
    revenue = from_unscaled(F.sum(F.coalesce(F.col("trip_revenue_cents"), F.lit(0))))
    return (per_trip.groupBy("service_date")
            .agg(scaled_sum("km").alias("total_km"),
                 long_sum("boardings").alias("total_boardings"),
                 revenue.alias("total_revenue"),
                 exact_avg("occupancy_pct", 2).alias("avg_occupancy"),
                 avg_delay("delay_min", "null_as_zero", 2).alias("avg_delay_min"),
                 on_time_rate("delay_min", null_is_on_time=True, digits=2).alias("on_time_pct")))


def daily_kpi_active(trip: DataFrame, exclude_status: str = TRIP_STATUS_CANCELLED,
                     threshold: int = 5) -> DataFrame:
    """Daily KPIs over active (not cancelled) trips only.

    Early trips count as 0 delay, on time means ``delay < threshold``, and
    every average divides by max(active trips, 1), so a day with only
    cancelled trips still appears with zeros.  Filtered aggregation
    (``sum(when ...)``) keeps such days without a second pass.
    """
    active = ~F.col("status").eqNullSafe(exclude_status)
    n_active = count_if(active)
    divisor = F.greatest(n_active, F.lit(1))
    delay = F.col("delay_min")
    clamped = F.when(delay.isNull(), F.lit(None)).otherwise(F.greatest(delay, F.lit(0)))

    def active_sum(c):
        return F.sum(F.when(active, c))

    return (trip.groupBy("service_date")
            .agg(F.coalesce(scaled_sum(F.when(active, F.col("km"))), F.lit(0)).cast("decimal(22,2)")
                 .alias("total_km"),
                 F.coalesce(active_sum(F.col("boardings")), F.lit(0)).cast("bigint").alias("total_boardings"),
                 rounded_ratio(F.coalesce(active_sum(F.col("occupancy_pct")), F.lit(0)), divisor, 2)
                 .alias("avg_occupancy"),
                 rounded_ratio(F.coalesce(active_sum(clamped), F.lit(0)), divisor, 2).alias("avg_delay_min"),
                 rounded_ratio(count_if(active & on_time_flag(delay, threshold, inclusive=False,
                                                              null_is_on_time=False)) * 100, divisor, 2)
                 .alias("on_time_pct"),
                 n_active.cast("bigint").alias("active_trips")))


def vehicle_mileage(trip: DataFrame, bus: DataFrame) -> DataFrame:
    """Km and average occupancy per plate (unmatched buses -> 'Unbekannt').

    Trips are reduced to one row per bus before the join; the exact average
    is carried as (sum, count) through the join and combined per plate.
    """
    per_bus = trip.groupBy("bus_id").agg(F.sum(unscaled("km")).alias("km_cents"),
                                         F.sum("occupancy_pct").alias("occ_sum"),
                                         F.count("occupancy_pct").alias("occ_n"))
    joined = per_bus.join(bus.select("bus_id", "plate"), "bus_id", "left")
    return (joined.groupBy(F.coalesce(F.col("plate"), F.lit(UNKNOWN_PLATE)).alias("plate"))
            .agg(from_unscaled(F.sum("km_cents")).alias("total_km"),
                 rounded_ratio(F.sum("occ_sum"), F.sum("occ_n"), 2).alias("avg_occupancy")))


def bus_status_counts(bus: DataFrame) -> DataFrame:
    """Total, active and in-maintenance buses in one scan."""
    return bus.agg(F.count(F.lit(1)).alias("total_buses"),
                   count_if(F.col("status") == BUS_STATUS_ACTIVE).cast("bigint").alias("active_buses"),
                   count_if(F.col("status") == BUS_STATUS_IN_MAINTENANCE).cast("bigint").alias("in_maintenance"))


def kpi_suite(bus, maintenance, legacy_trip, as_of) -> DataFrame:
    """The six fleet KPIs as (metric, value, error) rows.

    Inputs are zero-argument callables returning DataFrames, so a missing or
    broken table only fails the metrics that read it: its error text goes to
    ``error`` and the other metrics are still computed.  The four bus and
    maintenance counts and the two trip measures fuse into three scans.
    """
    from pyspark.errors import AnalysisException

    from fleetlens.operators.filters import overdue

    groups = [
        (("total_buses", "active_buses", "in_maintenance"), lambda: bus_status_counts(bus())),
        (("overdue_maintenance",),
         lambda: overdue(maintenance(), as_of).agg(F.count(F.lit(1)).alias("overdue_maintenance"))),
        (("total_km", "avg_occupancy"), lambda: occupancy_and_km(legacy_trip())),
    ]
    spark = None
    parts = []
    for names, build in groups:
        try:
            wide = build()
            spark = wide.sparkSession
            args = ", ".join(f"'{n}', CAST(`{n}` AS DECIMAL(22,2))" for n in names)
            parts.append(wide.selectExpr(f"stack({len(names)}, {args}) AS (metric, value)")
                         .withColumn("error", F.lit(None).cast("string")))
        except AnalysisException as e:  # missing table or column: report, keep going
            parts.append((names, str(e)))
    if spark is None:
        raise ValueError("no KPI input could be read")
    out = None
    for p in parts:
        if isinstance(p, tuple):
            names, msg = p
            p = spark.createDataFrame([(n, None, msg) for n in names],
                                      "metric string, value decimal(22,2), error string")
        out = p if out is None else out.unionByName(p)
    return out
