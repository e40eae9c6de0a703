"""Sorting, top-k and surrogate keys.

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every partition
keeps its own top n and only those reach the final merge (no global sort).
Every ordering ends in a total-order tie-break and states its NULL order
(PostgreSQL puts NULLs first in DESC and last in ASC).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.measures import avg_delay
from fleetlens.functions.scalars import null_skipping_concat
from fleetlens.operators.filters import overdue, select_as, since
from fleetlens.operators.joins import with_plate
from fleetlens.schemas import RECENT_TRIP_DISPLAY
from fleetlens.session import checkpoint_root


def _recent_order():
    return [F.col("service_date").desc_nulls_first(), F.col("start_sec").desc_nulls_first(),
            F.col("trip_id").desc_nulls_first()]


def top_recent(trip: DataFrame, n: int = 50, mapping=RECENT_TRIP_DISPLAY) -> DataFrame:
    """Newest ``n`` trips by date and start time, displayed with ``mapping``."""
    top = trip.orderBy(*_recent_order()).limit(n)
    return select_as(top, mapping)


def top_recent_formatted(trip: DataFrame, n: int = 15) -> DataFrame:
    """Newest ``n`` trips for the printed report: date as DD.MM.YYYY,
    occupancy with a '%' sign (NULL-skipping concat)."""
    top = trip.orderBy(*_recent_order()).limit(n)
    return top.select(
        F.date_format("service_date", "dd.MM.yyyy").alias("Datum"),
        F.col("line").alias("Linie"),
        F.col("direction").alias("Richtung"),
        F.col("vehicle_no").alias("Fahrzeug"),
        F.col("delay_min").alias("Versp. min"),
        null_skipping_concat(F.col("occupancy_pct").cast("string"), F.lit("%")).alias("Auslastung"),
        F.col("boardings").alias("Passagiere"),
        F.col("status").alias("Status"),
    )


def top_counts(df: DataFrame, col: str, n: int = 10, name: str = "n") -> DataFrame:
    """The ``n`` most frequent values of ``col`` (partial counts, then top-n)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.col(name).desc(), F.col(col).asc_nulls_last()).limit(n))


def problem_lines(trip: DataFrame, as_of: _dt.date, days: int = 7, n: int = 3) -> DataFrame:
    """Lines with the worst average delay over the last ``days`` days.

    A line whose delays are all NULL has a NULL average and sorts first.
    """
    recent = since(trip, "service_date", as_of, days)
    return (recent.groupBy("line")
            .agg(avg_delay("delay_min", "skip_null", 1).alias("avg_delay_min"),
                 F.count(F.lit(1)).alias("trip_count"))
            .orderBy(F.col("avg_delay_min").desc_nulls_first(), F.col("line").asc())
            .limit(n))


def latest_days(daily_kpi: DataFrame, n: int = 2) -> DataFrame:
    return (daily_kpi.select("service_date", "on_time_pct", "total_boardings",
                             "avg_occupancy", "total_revenue")
            .orderBy(F.col("service_date").desc()).limit(n))


def kpi_series(daily_kpi: DataFrame) -> DataFrame:
    return daily_kpi.select("service_date", "total_km", "total_boardings", "total_revenue",
                            "avg_occupancy", "avg_delay_min", "on_time_pct").orderBy("service_date")


def recent_with_plate(legacy_trip: DataFrame, bus: DataFrame, n: int = 15) -> DataFrame:
    """Newest legacy trips with their plate.  The top-n is taken before the
    dimension join, so only ``n`` rows are joined."""
    top = legacy_trip.orderBy(F.col("service_date").desc_nulls_first(),
                              F.col("trip_id").desc()).limit(n)
    return with_plate(top, bus).select("service_date", "plate", "km", "occupancy_pct")


def top_odometer(bus: DataFrame, n: int = 10, min_km: int | None = None) -> DataFrame:
    src = bus if min_km is None else bus.where(F.col("odometer_km") >= min_km)
    return (src.select("bus_id", "plate", "odometer_km")
            .orderBy(F.col("odometer_km").desc_nulls_last(), F.col("bus_id").asc()).limit(n))


def overdue_list(maintenance: DataFrame, bus: DataFrame, as_of: _dt.date) -> DataFrame:
    """All overdue maintenance rows with the bus plate and due date."""
    return (with_plate(overdue(maintenance, as_of), bus, row_key="maintenance_id")
            .select("maintenance_id", "bus_id", "plate", "kind", "status", "next_due"))


def with_surrogate_key(df: DataFrame, name: str, order, partitions: int | None = None,
                       after: int = 0) -> DataFrame:
    """Sequential ids after+1..after+N following the total order ``order``
    (``after`` is the largest id already given, 0 for a new table).

    Two phases, no single-partition window: range-partition and sort by the
    order, cut the lineage with a reliable checkpoint (the counts and the
    numbering must see the same partitioning), count rows per partition,
    turn the counts into offsets (one row per partition: a bounded table,
    broadcast), and add the row position inside the partition.
    """
    checkpoint_root(df.sparkSession)  # reliable checkpoints go to the shared root
    cols = [F.col(c).asc_nulls_first() for c in order]
    # as many range partitions as the session's shuffle width (sized to the data
    # on a cluster), so each sorted range stays a normal shuffle-partition size
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    staged = ranged.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pos = staged.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = pos.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
                            .alias("_offset"))
    return (pos.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_pos") + 1 + after)
            .drop("_mid", "_part", "_pos", "_offset"))
