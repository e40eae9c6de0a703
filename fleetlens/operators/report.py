"""Report assembly: KPI cards, problem-line text, metric table, run manifest,
nested fleet snapshot and period reports.

Every operator here works on results that are already reduced (one-row KPI
blocks or top-n frames); arrays are only collected from frames with a limit.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.measures import (avg_delay, count_if, decimal_sum, exact_avg, from_unscaled, on_time_flag, on_time_rate, rounded_ratio,
                                          unscaled)
from fleetlens.functions.scalars import fixed_digits, thousands
from fleetlens.operators.aggregates import bus_status_counts, occupancy_and_km, overview_and_report_kpi
from fleetlens.operators.filters import overdue
from fleetlens.operators.joins import with_plate
from fleetlens.operators.topk import overdue_list, top_odometer
from fleetlens.schemas import (DASHBOARD_TILES, DELAY_LIMIT_MIN, NO_PROBLEM_LINES,
                               PROBLEM_LINE_TEMPLATE, PUNCTUALITY_TARGET_PCT, REPORT_KIND_LABELS,
                               REPORT_TILES)


def _txt(c: Column) -> Column:
    """Python str() of a possibly missing value: NULL prints as 'None'."""
    return F.coalesce(c, F.lit("None"))


def _cards(one_row: DataFrame, groups) -> DataFrame:
    """Stack the tiles of a one-row frame into (card_set, position, label,
    value_text, warn) rows; ``groups`` = [(card_set, [(label, text, warn)])]."""
    cols = []
    for set_name, tiles in groups:
        for i, (label, text, warn) in enumerate(tiles):
            cols += [F.lit(set_name), F.lit(i + 1), F.lit(label), text, warn]
    args = ", ".join(f"_a{j}" for j in range(len(cols)))
    wide = one_row.select(*[c.alias(f"_a{j}") for j, c in enumerate(cols)])
    return wide.selectExpr(f"stack({len(cols) // 5}, {args}) AS (card_set, position, label, value_text, warn)")


def _dashboard_tiles(o) -> list:
    """The six dashboard tiles; ``o(name)`` gives an overview measure."""
    no = F.lit(False)
    p = o("on_time_pct")
    return [
        (DASHBOARD_TILES[0], thousands(o("trips")), no),
        (DASHBOARD_TILES[1], F.concat(_txt(fixed_digits(o("avg_occupancy"), 1)), F.lit("%")), no),
        (DASHBOARD_TILES[2], F.concat(_txt(fixed_digits(o("avg_delay_min"), 1)), F.lit(" min")), no),
        (DASHBOARD_TILES[3], _txt(thousands(o("boardings"))), no),
        (DASHBOARD_TILES[4], F.concat(_txt(thousands(o("energy_kwh"))), F.lit(" kWh")), no),
        (DASHBOARD_TILES[5], F.concat(_txt(fixed_digits(p, 1)), F.lit("%")),
         F.coalesce(p < PUNCTUALITY_TARGET_PCT, F.lit(True))),
    ]


def _report_tiles(r) -> list:
    """The six report tiles; ``r(name)`` gives a NULL-safe report measure."""
    no = F.lit(False)
    p = r("on_time_pct")
    return [
        (REPORT_TILES[0], thousands(r("trips")), no),
        (REPORT_TILES[1], thousands(r("boardings")), no),
        (REPORT_TILES[2], F.concat(fixed_digits(r("avg_occupancy"), 1), F.lit("%")), no),
        (REPORT_TILES[3], fixed_digits(r("avg_delay_min"), 1), r("avg_delay_min") > DELAY_LIMIT_MIN),
        (REPORT_TILES[4], thousands(r("total_km")), no),
        (REPORT_TILES[5], F.concat(fixed_digits(p, 1), F.lit("%")), p < PUNCTUALITY_TARGET_PCT),
    ]


def kpi_cards(overview: DataFrame, report_nullsafe: DataFrame) -> DataFrame:
    """The six dashboard tiles (from the overview KPIs) and the six report
    tiles (from the NULL-safe report KPIs) as one long table."""
    return _cards(overview, [("dashboard", _dashboard_tiles(F.col))]).unionByName(
        _cards(report_nullsafe, [("report", _report_tiles(F.col))]))


def kpi_cards_from_trips(trip: DataFrame) -> DataFrame:
    """``kpi_cards`` of a trip table in one scan: both blocks come from one
    aggregate row and all twelve tiles from one ``stack``."""
    row = overview_and_report_kpi(trip)
    return _cards(row, [("dashboard", _dashboard_tiles(lambda n: F.col("o_" + n))),
                        ("report", _report_tiles(lambda n: F.col("r_" + n)))])


def problem_lines_text(problem_lines: DataFrame) -> DataFrame:
    """One text: a line per problem line in rank order, joined by newlines;
    a fixed sentence when there is none.  Input is the top-n frame."""
    w = Window.orderBy(F.col("avg_delay_min").desc_nulls_first(), F.col("line").asc())
    ranked = problem_lines.withColumn("_rank", F.row_number().over(w))
    head, rest = PROBLEM_LINE_TEMPLATE.split("{line}")
    mid, rest = rest.split("{avg}")
    mid2, tail = rest.split("{n}")
    line_text = F.concat(F.lit(head), F.col("line"), F.lit(mid),
                         _txt(fixed_digits(F.col("avg_delay_min"), 1)), F.lit(mid2),
                         F.col("trip_count").cast("string"), F.lit(tail))
    items = F.array_sort(F.collect_list(F.struct(F.col("_rank"), line_text.alias("t"))))
    joined = F.array_join(F.transform(items, lambda x: x["t"]), "\n")
    return ranked.agg(F.coalesce(F.when(F.size(items) > 0, joined), F.lit(NO_PROBLEM_LINES))
                      .alias("problem_lines_text"))


def metric_table(trend_latest: DataFrame) -> DataFrame:
    """(metric, value, trend, status) rows from the newest trend row with lights."""
    o = F.col
    none = F.lit(None).cast("string")
    rows = [
        ("punctuality", F.concat(fixed_digits(o("on_time_pct"), 2), F.lit("%")), none, o("punctuality_light")),
        ("boardings", o("total_boardings").cast("string"), o("boardings_trend"), none),
        ("occupancy", F.concat(fixed_digits(o("avg_occupancy"), 2), F.lit("%")), none, o("occupancy_light")),
        ("revenue", F.concat(o("total_revenue").cast("string"), F.lit(" €")), o("revenue_trend"), none),
    ]
    cols = []
    for name, value, trend, status in rows:
        cols += [F.lit(name), value, trend, status]
    wide = trend_latest.select(*[c.alias(f"_m{j}") for j, c in enumerate(cols)])
    args = ", ".join(f"_m{j}" for j in range(len(cols)))
    return wide.selectExpr(f"stack({len(rows)}, {args}) AS (metric, value, trend, status)")


def report_manifest(written: DataFrame, kind: str, run_ts: _dt.datetime,
                    tz: str = "Europe/Berlin") -> DataFrame:
    """Per dataset of a report run: row count, kind label, period and
    creation time in the local zone, and a no-data marker.

    ``written`` is what ``write_report`` returns, so the counts are those of
    the written files and no source is read again; ``run_ts`` is a UTC
    timestamp passed in (never the clock inside)."""
    label = REPORT_KIND_LABELS.get(kind, REPORT_KIND_LABELS["monthly"])
    parts = written.select("dataset", "row_count")
    utc_wall = F.lit(run_ts.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall)  # session-zone independent
    return parts.select(
        "dataset", "row_count",
        F.lit(label).alias("kind_label"),
        F.date_format(local, "MMMM yyyy").alias("period_label"),
        F.date_format(local, "dd.MM.yyyy HH:mm").alias("created_at"),
        (F.col("row_count") > 0).alias("has_data"),
    )


def fleet_snapshot(bus: DataFrame, maintenance: DataFrame, legacy_trip: DataFrame,
                   as_of: _dt.date) -> DataFrame:
    """One record: bus counts, overdue maintenance, average occupancy and total
    km, from one scan of each table.  The one-row parts are combined by a union
    and a global ``first`` (no cross join)."""
    parts = [bus_status_counts(bus), occupancy_and_km(legacy_trip),
             overdue(maintenance, as_of).agg(F.count(F.lit(1)).alias("overdue_maintenance"))]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    names = [c for p in parts for c in p.columns]
    return merged.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names]).withColumn(
        "report_date", F.date_format(F.lit(as_of), "dd.MM.yyyy"))


def fleet_snapshot_lists(bus: DataFrame, maintenance: DataFrame, legacy_trip: DataFrame,
                         as_of: _dt.date, n_list: int = 10) -> DataFrame:
    """The lists beside the record as (list, place, ref_id, plate, day, value):
    every overdue maintenance (no place), and the top ``n_list`` recent trips
    and odometer readings in order."""
    late = overdue_list(maintenance, bus, as_of).select(
        F.lit("overdue").alias("list"), F.lit(None).cast("int").alias("place"), F.col("maintenance_id").alias("ref_id"),
        "plate", F.col("next_due").alias("day"), F.col("kind").alias("value"))

    def ranked(df: DataFrame, order, name: str, ref, day, value) -> DataFrame:
        # a top-n frame, so the window sees n_list rows
        place = F.row_number().over(Window.orderBy(*order))
        return df.select(F.lit(name).alias("list"), place.alias("place"), ref.cast("bigint").alias("ref_id"), "plate",
                         day.cast("date").alias("day"), value.cast("string").alias("value"))

    none = F.lit(None)
    newest = [F.col("service_date").desc_nulls_first(), F.col("trip_id").desc()]
    trips = with_plate(legacy_trip.orderBy(*newest).limit(n_list), bus)
    return (late.unionByName(ranked(trips, newest, "recent_trips", F.col("trip_id"), F.col("service_date"), F.col("line")))
            .unionByName(ranked(top_odometer(bus, n_list), [F.col("odometer_km").desc(), F.col("bus_id")], "high_odometer",
                                F.col("bus_id"), none, F.col("odometer_km"))))


PERIOD_UNITS = ("day", "week", "month")


def _in_periods(trip: DataFrame, period: str, start, end) -> tuple[DataFrame, Column]:
    if period not in PERIOD_UNITS:
        raise ValueError(f"period must be one of {PERIOD_UNITS}")
    if start is not None:
        trip = trip.where(F.col("service_date") >= F.lit(start))
    if end is not None:
        trip = trip.where(F.col("service_date") < F.lit(end))
    return trip, F.to_date(F.date_trunc(period, F.col("service_date")))


def period_line_report(trip: DataFrame, period: str = "month", start: _dt.date | None = None,
                       end: _dt.date | None = None) -> DataFrame:
    """The report's table of lines, for each period: trips, average delay and
    punctuality of each line."""
    src, bucket = _in_periods(trip, period, start, end)
    return (src.groupBy(bucket.alias("period_start"), "line")
            .agg(F.count(F.lit(1)).alias("trips"),
                 avg_delay("delay_min", "null_as_zero", 1).alias("avg_delay_min"),
                 on_time_rate("delay_min", null_is_on_time=True, digits=1).alias("on_time_pct"))
            .orderBy("period_start", "line"))


def period_report(trip: DataFrame, period: str = "month", start: _dt.date | None = None,
                  end: _dt.date | None = None) -> DataFrame:
    """Report KPIs per day, week (Monday start) or month, optionally restricted
    to ``start <= service_date < end`` (a pushed-down date filter)."""
    src, bucket = _in_periods(trip, period, start, end)
    return (src.groupBy(bucket.alias("period_start"))
            .agg(F.count(F.lit(1)).alias("trips"),
                 F.sum("boardings").cast("bigint").alias("boardings"),
                 exact_avg("occupancy_pct", 1).alias("avg_occupancy"),
                 avg_delay("delay_min", "null_as_zero", 1).alias("avg_delay_min"),
                 decimal_sum("km", 0, "decimal(22,0)").alias("total_km"),
                 on_time_rate("delay_min", null_is_on_time=True, digits=1).alias("on_time_pct"))
            .orderBy("period_start"))


def period_cube(trip: DataFrame) -> DataFrame:
    """The report KPIs of every day, week and month, of all lines (line NULL)
    and of each line, in one pass: (grain, scope, period_start, line, ...).

    Trips are summed once per day and line; the six groupings are sets over
    those sums, which add up, so the trips are neither read nor expanded again."""
    sums = trip.groupBy("service_date", "line").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("boardings").cast("bigint")).alias("b"),
        F.sum(unscaled("occupancy_pct")).alias("o"), F.count("occupancy_pct").alias("o_n"),
        F.sum(F.coalesce(F.col("delay_min"), F.lit(0)).cast("bigint")).alias("d"), F.sum(unscaled("km")).alias("k"),
        count_if(on_time_flag("delay_min")).alias("t"))
    units = sums.select("*", *[F.to_date(F.date_trunc(u, F.col("service_date"))).alias(u) for u in PERIOD_UNITS])
    # The line counts as a value of its own where it is NULL in the trips, told apart by the grouping id.
    sets = [[u, *line] for u in PERIOD_UNITS for line in ([], ["line"])]
    grouped = units.groupingSets(sets, *PERIOD_UNITS, "line").agg(
        *[F.grouping(u).alias(f"g_{u}") for u in PERIOD_UNITS], F.grouping("line").alias("g_line"),
        *[F.sum(c).alias(f"s_{c}") for c in ("n", "b", "o", "o_n", "d", "k", "t")])
    grain, start = F.lit(None).cast("string"), F.lit(None).cast("date")
    for u in PERIOD_UNITS:
        grain, start = F.when(F.col(f"g_{u}") == 0, F.lit(u)).otherwise(grain), F.when(F.col(f"g_{u}") == 0, F.col(u)).otherwise(start)
    return grouped.select(
        grain.alias("grain"), F.when(F.col("g_line") == 1, F.lit("all")).otherwise(F.lit("line")).alias("scope"), start.alias("period_start"), "line",
        F.col("s_n").alias("trips"), F.col("s_b").alias("boardings"),
        rounded_ratio(from_unscaled(F.col("s_o")), F.col("s_o_n"), 1).alias("avg_occupancy"), rounded_ratio(F.col("s_d"), F.col("s_n"), 1).alias("avg_delay_min"),
        F.round(from_unscaled(F.col("s_k")), 0).cast("decimal(22,0)").alias("total_km"), rounded_ratio(F.col("s_t") * 100, F.col("s_n"), 1).alias("on_time_pct"))
