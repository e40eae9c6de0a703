"""Classification operators: target flags, warnings, traffic lights and the
trip-level rules of the fleet timetable (weekend, hour band, derived status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.measures import exact_avg
from fleetlens.functions.scalars import dayofweek_is_weekend
from fleetlens.schemas import (DELAY_LIMIT_MIN, PUNCTUALITY_TARGET_PCT, TARGET_CRITICAL, TARGET_OK,
                               TRIP_STATUS_CANCELLED, TRIP_STATUS_LATE, TRIP_STATUS_ON_SCHEDULE)

# Fixed values of the traffic-light rules: punctuality >= 95 green, >= 85
# yellow, else red; occupancy 60..80 green, else yellow.
GREEN, YELLOW, RED = "green", "yellow", "red"
UP, DOWN, FLAT = "up", "down", "flat"
PUNCTUALITY_GREEN_FROM = 95
PUNCTUALITY_YELLOW_FROM = 85
OCCUPANCY_GREEN = (60, 80)
# Hour bands of the timetable: peak 7-9 and 16-18, night from 22 to 5.
PEAK_HOURS = ((7, 9), (16, 18))
NIGHT_FROM, NIGHT_TO = 22, 5


def target_flag(col, target: float = PUNCTUALITY_TARGET_PCT) -> Column:
    """'gut' when the value reaches the target, else 'kritisch' (NULL too)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c >= target, F.lit(TARGET_OK)).otherwise(F.lit(TARGET_CRITICAL))


def warn_flags(kpi: DataFrame) -> DataFrame:
    """Report warnings: average delay above the limit, punctuality below target."""
    return kpi.select(
        "*",
        F.coalesce(F.col("avg_delay_min") > DELAY_LIMIT_MIN, F.lit(False)).alias("delay_warn"),
        F.coalesce(F.col("on_time_pct") < PUNCTUALITY_TARGET_PCT, F.lit(False)).alias("on_time_warn"),
    )


def vs_target(df: DataFrame) -> DataFrame:
    """Per row (line or day): below the punctuality target, above the delay limit."""
    return df.select(
        "*",
        (F.col("on_time_pct") < PUNCTUALITY_TARGET_PCT).alias("below_target"),
        (F.col("avg_delay_min") > DELAY_LIMIT_MIN).alias("over_delay_limit"),
    )


def _direction(delta: Column) -> Column:
    return (F.when(delta > 0, F.lit(UP)).when(delta < 0, F.lit(DOWN))
            .when(delta == 0, F.lit(FLAT)))


def traffic_light(trend: DataFrame) -> DataFrame:
    """Status lights on a trend frame (``trend`` output of the daily KPIs)."""
    p, o = F.col("on_time_pct"), F.col("avg_occupancy")
    return trend.select(
        "*",
        F.when(p >= PUNCTUALITY_GREEN_FROM, F.lit(GREEN))
         .when(p >= PUNCTUALITY_YELLOW_FROM, F.lit(YELLOW))
         .when(p.isNotNull(), F.lit(RED)).alias("punctuality_light"),
        F.when(o.between(*OCCUPANCY_GREEN), F.lit(GREEN))
         .when(o.isNotNull(), F.lit(YELLOW)).alias("occupancy_light"),
        _direction(F.col("total_revenue_delta")).alias("revenue_trend"),
        _direction(F.col("total_boardings_delta")).alias("boardings_trend"),
    )


def is_weekend(date_col) -> Column:
    return dayofweek_is_weekend(date_col)


def weekend_split(trip: DataFrame) -> DataFrame:
    return (trip.groupBy(is_weekend("service_date").alias("is_weekend"))
            .agg(F.count(F.lit(1)).alias("trip_count"),
                 F.sum("boardings").cast("bigint").alias("boardings")))


def hour_band(sec_col) -> Column:
    """'peak', 'night' or 'normal' for a time of day in seconds (NULL stays NULL)."""
    s = F.col(sec_col) if isinstance(sec_col, str) else sec_col
    h = (s / 3600).cast("int")
    peak = None
    for lo, hi in PEAK_HOURS:
        cond = h.between(lo, hi)
        peak = cond if peak is None else (peak | cond)
    return (F.when(s.isNull(), F.lit(None)).when(peak, F.lit("peak"))
            .when((h >= NIGHT_FROM) | (h <= NIGHT_TO), F.lit("night")).otherwise(F.lit("normal")))


def hour_band_summary(trip: DataFrame) -> DataFrame:
    return (trip.groupBy(hour_band("start_sec").alias("hour_band"))
            .agg(F.count(F.lit(1)).alias("trip_count"),
                 exact_avg("occupancy_pct", 2).alias("avg_occupancy")))


def derive_status(trip: DataFrame, threshold: int = 5) -> DataFrame:
    """Status from the delay (cancelled kept, late from ``threshold`` minutes)
    and whether it agrees with the stored status.  NULL delay -> NULL."""
    d, s = F.col("delay_min"), F.col("status")
    derived = (F.when(s == TRIP_STATUS_CANCELLED, F.lit(TRIP_STATUS_CANCELLED))
               .when(d.isNull(), F.lit(None))
               .when(d >= threshold, F.lit(TRIP_STATUS_LATE))
               .otherwise(F.lit(TRIP_STATUS_ON_SCHEDULE)))
    return trip.select("trip_id", "status", derived.alias("derived_status"),
                       (derived == s).alias("status_matches"))
