"""Registered queries, one per operator of the inventory.

Each query binds the test tables (``FleetTables``), applies the library
operator(s) and returns the result DataFrame; the oracle SQL next to it
computes the same result independently in DuckDB.  Queries that write
(sinks, CSV ingest, streams) use fresh directories below the session's
checkpoint root and return what they read back.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from fleetlens.functions.scalars import STRIP_PATTERN, lenient_cast, lenient_time_seconds, seconds_to_hms
from fleetlens.operators import aggregates as agg
from fleetlens.operators import classify as cls
from fleetlens.operators import filters as flt
from fleetlens.operators import joins as jn
from fleetlens.operators import quality as dq
from fleetlens.operators import report as rpt
from fleetlens.operators import tables as tbl
from fleetlens.operators import text as txt
from fleetlens.operators import topk
from fleetlens.operators import windows as win
from fleetlens.operators.batch_import import import_batch
from fleetlens.plans.oracle_sql import (BINDINGS, MAINTENANCE_AS_OF, TRIP_AS_OF, avg2, avg_int, lenient_bigint, on_time, rnd,
                                        with_tables)
from fleetlens.plans.registry import register
from fleetlens.schemas import (DAILY_KPI, KPI_SERIES_DISPLAY, RECENT_TRIP_DISPLAY, TICKET, TICKET_ORDER, TRIP,
                               TRIP_LIMITS)
from fleetlens.session import scratch_path
from fleetlens.sources import bindings as bnd
from fleetlens.sources.bindings import FleetTables
from fleetlens.sources.depots import union_depots
from fleetlens.sources.files import read_tickets_csv, read_trips_csv, write_csv
from fleetlens.sources.sql import run_sql
from fleetlens.streaming.daily_revenue import stream_daily_revenue
from fleetlens.streaming.upsert_kpi import MONTH, stream_upsert_kpi, with_month

T = FleetTables

# --------------------------------------------------------------------------
# shared SQL pieces
# --------------------------------------------------------------------------


def _daily_sql(boardings: str = "t.boardings") -> str:
    return f"""
SELECT t.service_date,
       CAST(SUM(t.km) AS DECIMAL(22,2)) AS total_km,
       CAST(SUM({boardings}) AS BIGINT) AS total_boardings,
       CAST(SUM(COALESCE(r.trip_revenue, 0)) AS DECIMAL(22,2)) AS total_revenue,
       {avg2('t.occupancy_pct', 2)} AS avg_occupancy,
       {avg_int('COALESCE(t.delay_min, 0)', 2, 'COUNT(*)')} AS avg_delay_min,
       {on_time(2)} AS on_time_pct
FROM trip t LEFT JOIN (SELECT trip_id, SUM(amount_eur) AS trip_revenue FROM ticket GROUP BY trip_id) r
  ON t.trip_id = r.trip_id
GROUP BY t.service_date"""


DAILY = with_tables("trip", "ticket", extra=(("daily", _daily_sql()),))
DAILY_KPI_SQL = with_tables("trip", "ticket") + _daily_sql()


def _daily(t: FleetTables):
    return agg.daily_kpi(t.trip, t.ticket)


# --------------------------------------------------------------------------
# A8 flagship and the other grouped aggregations
# --------------------------------------------------------------------------


@register("daily_kpi", DAILY_KPI_SQL)
def q_daily_kpi(spark, d):
    return _daily(T(spark, d))


@register("agg_line_punctuality", with_tables("trip") + f"""
SELECT line, {on_time(1, null_on_time=False)} AS on_time_pct, {avg_int('delay_min', 1)} AS avg_delay_min
FROM trip GROUP BY line""")
def q_line_punctuality(spark, d):
    return agg.line_punctuality(T(spark, d).trip)


@register("agg_line_report", with_tables("trip") + f"""
SELECT line, COUNT(*) AS trips, {avg_int('COALESCE(delay_min, 0)', 1, 'COUNT(*)')} AS avg_delay_min,
       {on_time(1)} AS on_time_pct
FROM trip GROUP BY line""")
def q_line_report(spark, d):
    return agg.line_report(T(spark, d).trip)


@register("agg_status_counts", with_tables("trip") + """
SELECT status, COUNT(*) AS trip_count FROM trip GROUP BY status""")
def q_status_counts(spark, d):
    return agg.counts_by(T(spark, d).trip, "status", "trip_count")


@register("agg_daily_delay_occupancy", with_tables("trip") + f"""
SELECT service_date, {avg_int('delay_min', 2)} AS avg_delay_min, {avg2('occupancy_pct', 2)} AS avg_occupancy
FROM trip GROUP BY service_date""")
def q_daily_delay_occupancy(spark, d):
    return agg.daily_averages(T(spark, d).trip)


@register("agg_fare_type", with_tables("ticket") + """
SELECT fare_type, COUNT(*) AS ticket_count, CAST(ROUND(SUM(amount_eur), 2) AS DECIMAL(22,2)) AS revenue
FROM ticket GROUP BY fare_type""")
def q_fare_type(spark, d):
    return agg.fare_summary(T(spark, d).ticket)


@register("agg_payment_method", with_tables("ticket") + """
SELECT payment_method, COUNT(*) AS ticket_count FROM ticket GROUP BY payment_method""")
def q_payment_method(spark, d):
    return agg.counts_by(T(spark, d).ticket, "payment_method", "ticket_count")


DAILY_REVENUE_SQL = with_tables("ticket") + """
SELECT CAST(validated_at AS DATE) AS validation_date, CAST(ROUND(SUM(amount_eur), 2) AS DECIMAL(22,2)) AS revenue
FROM ticket GROUP BY 1"""


@register("agg_daily_revenue", DAILY_REVENUE_SQL)
def q_daily_revenue(spark, d):
    return agg.daily_revenue(T(spark, d).ticket)


_ACT = "(status IS DISTINCT FROM 'ausgefallen')"
_NACT = f"GREATEST(SUM(CASE WHEN {_ACT} THEN 1 ELSE 0 END), 1)"


@register("daily_kpi_active", with_tables("trip", extra=(("trip_a", f"""
SELECT * REPLACE (CASE WHEN service_date = DATE '{bnd.CANCELLED_DAY}' THEN 'ausgefallen' ELSE status END AS status)
FROM trip"""),)) + f"""
SELECT service_date,
       CAST(COALESCE(SUM(CASE WHEN {_ACT} THEN km END), 0) AS DECIMAL(22,2)) AS total_km,
       CAST(COALESCE(SUM(CASE WHEN {_ACT} THEN boardings END), 0) AS BIGINT) AS total_boardings,
       {rnd(f"COALESCE(SUM(CASE WHEN {_ACT} THEN occupancy_pct END), 0) * 100", _NACT, 2, 2)} AS avg_occupancy,
       {rnd(f"COALESCE(SUM(CASE WHEN {_ACT} AND delay_min IS NOT NULL THEN GREATEST(delay_min, 0) END), 0)", _NACT, 2)} AS avg_delay_min,
       {rnd(f"SUM(CASE WHEN {_ACT} AND delay_min < 5 THEN 1 ELSE 0 END) * 100", _NACT, 2)} AS on_time_pct,
       CAST(SUM(CASE WHEN {_ACT} THEN 1 ELSE 0 END) AS BIGINT) AS active_trips
FROM trip_a GROUP BY service_date""")
def q_daily_kpi_active(spark, d):
    trip = T(spark, d).trip
    forced = trip.withColumn("status", F.when(F.col("service_date") == F.lit(bnd.CANCELLED_DAY),
                                              F.lit("ausgefallen")).otherwise(F.col("status")))
    return agg.daily_kpi_active(forced)


@register("agg_vehicle_mileage", with_tables("trip", "bus") + f"""
SELECT COALESCE(b.plate, 'Unbekannt') AS plate, CAST(SUM(t.km) AS DECIMAL(22,2)) AS total_km,
       {avg2('t.occupancy_pct', 2)} AS avg_occupancy
FROM trip t LEFT JOIN bus b ON t.bus_id = b.bus_id GROUP BY 1""")
def q_vehicle_mileage(spark, d):
    t = T(spark, d)
    return agg.vehicle_mileage(t.trip, t.bus)


# --------------------------------------------------------------------------
# global aggregations
# --------------------------------------------------------------------------

_OVERVIEW_SQL = f"""
SELECT COUNT(*) AS trips, {avg2('occupancy_pct', 1)} AS avg_occupancy, {avg_int('delay_min', 1)} AS avg_delay_min,
       CAST(SUM(boardings) AS BIGINT) AS boardings,
       CAST(ROUND(SUM(COALESCE(energy_kwh, 0)), 0) AS DECIMAL(22,0)) AS energy_kwh,
       {on_time(1)} AS on_time_pct
FROM trip"""
_REPORT_SQL = f"""
SELECT COUNT(*) AS trips, CAST(SUM(boardings) AS BIGINT) AS boardings, {avg2('occupancy_pct', 1)} AS avg_occupancy,
       {avg_int('COALESCE(delay_min, 0)', 1, 'COUNT(*)')} AS avg_delay_min,
       CAST(ROUND(SUM(km), 0) AS DECIMAL(22,0)) AS total_km, {on_time(1)} AS on_time_pct
FROM trip"""
_REPORT_NULLSAFE_SQL = f"""
SELECT COALESCE(trips, 0) AS trips, COALESCE(boardings, 0) AS boardings, COALESCE(avg_occupancy, 0) AS avg_occupancy,
       COALESCE(avg_delay_min, 0) AS avg_delay_min, COALESCE(total_km, 0) AS total_km,
       COALESCE(on_time_pct, 0) AS on_time_pct
FROM ({_REPORT_SQL})"""


@register("agg_overview_kpi", with_tables("trip") + _OVERVIEW_SQL)
def q_overview(spark, d):
    return agg.overview_kpi(T(spark, d).trip)


@register("agg_report_kpi", with_tables("trip") + _REPORT_SQL)
def q_report_kpi(spark, d):
    return agg.report_kpi(T(spark, d).trip)


@register("agg_report_kpi_nullsafe", with_tables("trip") + _REPORT_NULLSAFE_SQL)
def q_report_kpi_nullsafe(spark, d):
    return agg.report_kpi_nullsafe(T(spark, d).trip)


@register("agg_ticket_kpi", with_tables("ticket") + f"""
SELECT COUNT(*) AS validations, CAST(ROUND(SUM(amount_eur), 2) AS DECIMAL(22,2)) AS revenue,
       {avg2('amount_eur', 2)} AS avg_ticket
FROM ticket""")
def q_ticket_kpi(spark, d):
    return agg.ticket_kpi(T(spark, d).ticket)


@register("agg_bus_count", with_tables("bus") + "SELECT COUNT(*) AS total_buses FROM bus")
def q_bus_count(spark, d):
    return agg.bus_count(T(spark, d).bus)


@register("agg_total_km", with_tables("trip") + """
SELECT CAST(COALESCE(SUM(km), 0) AS DECIMAL(22,2)) AS total_km FROM trip""")
def q_total_km(spark, d):
    return agg.total_km(T(spark, d).legacy_trip)


@register("agg_avg_occupancy", with_tables("trip") + f"SELECT {avg2('occupancy_pct', 2)} AS avg_occupancy FROM trip")
def q_avg_occupancy(spark, d):
    return agg.avg_occupancy(T(spark, d).legacy_trip)


@register("kpi_suite", with_tables("bus", "maintenance", "trip") + f"""
SELECT 'total_buses' AS metric, CAST(COUNT(*) AS DECIMAL(22,2)) AS value, CAST(NULL AS VARCHAR) AS error FROM bus
UNION ALL SELECT 'active_buses', CAST(COUNT(*) FILTER (WHERE status = 'aktiv') AS DECIMAL(22,2)), NULL FROM bus
UNION ALL SELECT 'in_maintenance', CAST(COUNT(*) FILTER (WHERE status = 'in_wartung') AS DECIMAL(22,2)), NULL FROM bus
UNION ALL SELECT 'overdue_maintenance', CAST(COUNT(*) AS DECIMAL(22,2)), NULL FROM maintenance
  WHERE status = 'überfällig' OR next_due < {MAINTENANCE_AS_OF}
UNION ALL SELECT 'total_km', CAST(COALESCE(SUM(km), 0) AS DECIMAL(22,2)), NULL FROM trip
UNION ALL SELECT 'avg_occupancy', CAST({avg2('occupancy_pct', 2)} AS DECIMAL(22,2)), NULL FROM trip""")
def q_kpi_suite(spark, d):
    t = T(spark, d)
    return agg.kpi_suite(lambda: t.bus, lambda: t.maintenance, lambda: t.legacy_trip, bnd.MAINTENANCE_AS_OF)


# --------------------------------------------------------------------------
# projections and filters
# --------------------------------------------------------------------------

_RECENT_SELECT = ", ".join(f'{src} AS "{dst}"' for src, dst in RECENT_TRIP_DISPLAY)


@register("proj_recent_trip_columns", with_tables("trip") + f"SELECT {_RECENT_SELECT} FROM trip")
def q_proj_recent(spark, d):
    return flt.select_as(T(spark, d).trip, RECENT_TRIP_DISPLAY)


_KPI_SERIES_COLS = ("service_date", "total_km", "total_boardings", "total_revenue", "avg_occupancy",
                    "avg_delay_min", "on_time_pct")


@register("proj_kpi_display", DAILY + "SELECT " + ", ".join(
    f'{c} AS "{n}"' for c, n in zip(_KPI_SERIES_COLS, KPI_SERIES_DISPLAY)) + " FROM daily")
def q_proj_kpi_display(spark, d):
    return flt.rename_positional(topk.kpi_series(_daily(T(spark, d))), KPI_SERIES_DISPLAY)


@register("filter_bus_active", with_tables("bus") + "SELECT COUNT(*) AS active_buses FROM bus WHERE status = 'aktiv'")
def q_bus_active(spark, d):
    return agg.count_where(T(spark, d).bus, F.col("status") == "aktiv", "active_buses")


@register("filter_bus_in_maintenance", with_tables("bus") + """
SELECT COUNT(*) AS in_maintenance FROM bus WHERE status = 'in_wartung'""")
def q_bus_in_maintenance(spark, d):
    return agg.count_where(T(spark, d).bus, F.col("status") == "in_wartung", "in_maintenance")


@register("filter_overdue", with_tables("maintenance") + f"""
SELECT * FROM maintenance WHERE status = 'überfällig' OR next_due < {MAINTENANCE_AS_OF}""")
def q_overdue(spark, d):
    return flt.overdue(T(spark, d).maintenance, bnd.MAINTENANCE_AS_OF)


@register("filter_last_n_days", with_tables("trip") + f"""
SELECT * FROM trip WHERE service_date >= {TRIP_AS_OF} - INTERVAL 7 DAY""")
def q_last_n_days(spark, d):
    return flt.since(T(spark, d).trip, "service_date", bnd.TRIP_AS_OF, 7)


@register("filter_known_trips", with_tables("stray_ticket", "trip") + """
SELECT * FROM stray_ticket WHERE trip_id IN (SELECT trip_id FROM trip)""")
def q_known_trips(spark, d):
    t = T(spark, d)
    return jn.keep_known(t.stray_ticket, t.trip, "trip_id")


@register("filter_not_cancelled", with_tables("trip") + """
SELECT * FROM trip WHERE status IS DISTINCT FROM 'ausgefallen'""")
def q_not_cancelled(spark, d):
    return flt.active_only(T(spark, d).trip)


# --------------------------------------------------------------------------
# joins
# --------------------------------------------------------------------------


@register("join_trip_bus_left", with_tables("trip", "bus") + """
SELECT t.*, COALESCE(b.plate, 'Unbekannt') AS plate FROM trip t LEFT JOIN bus b ON t.bus_id = b.bus_id""")
def q_trip_bus(spark, d):
    t = T(spark, d)
    return jn.with_plate(t.trip, t.bus)


@register("join_revenue_per_trip", with_tables("trip", "ticket") + """
SELECT t.trip_id, t.service_date, CAST(COALESCE(r.rev, 0) AS DECIMAL(22,2)) AS revenue
FROM trip t LEFT JOIN (SELECT trip_id, SUM(amount_eur) AS rev FROM ticket GROUP BY trip_id) r ON t.trip_id = r.trip_id""")
def q_revenue_per_trip(spark, d):
    t = T(spark, d)
    return jn.with_revenue(t.trip, t.ticket).select("trip_id", "service_date", "revenue")


@register("join_orphans_anti", with_tables("stray_ticket", "trip") + """
SELECT * FROM stray_ticket c WHERE c.trip_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM trip p WHERE p.trip_id = c.trip_id)""")
def q_orphans(spark, d):
    t = T(spark, d)
    return jn.orphans(t.stray_ticket, t.trip, "trip_id")


# --------------------------------------------------------------------------
# shares and trends
# --------------------------------------------------------------------------


@register("share_by_status", with_tables("trip") + f"""
SELECT status, trip_count, {rnd('trip_count * 100', 'SUM(trip_count) OVER ()', 2)} AS share_pct
FROM (SELECT status, COUNT(*) AS trip_count FROM trip GROUP BY status)""")
def q_share_status(spark, d):
    return win.share(agg.counts_by(T(spark, d).trip, "status", "trip_count"), "trip_count")


@register("share_by_payment", with_tables("ticket") + f"""
SELECT payment_method, ticket_count, {rnd('ticket_count * 100', 'SUM(ticket_count) OVER ()', 2)} AS share_pct
FROM (SELECT payment_method, COUNT(*) AS ticket_count FROM ticket GROUP BY payment_method)""")
def q_share_payment(spark, d):
    return win.share(agg.counts_by(T(spark, d).ticket, "payment_method", "ticket_count"), "ticket_count")


def _trend_sql(src: str) -> str:
    return f"""
SELECT *,
       on_time_pct - COALESCE(LAG(on_time_pct) OVER (ORDER BY service_date), on_time_pct) AS on_time_pct_delta,
       CAST(total_revenue - COALESCE(LAG(total_revenue) OVER (ORDER BY service_date), total_revenue)
            AS DECIMAL(22,2)) AS total_revenue_delta,
       total_boardings - COALESCE(LAG(total_boardings) OVER (ORDER BY service_date), total_boardings)
            AS total_boardings_delta
FROM {src}"""


_TREND_LATEST = f"SELECT * FROM ({_trend_sql('(SELECT * FROM daily ORDER BY service_date DESC LIMIT 2)')}) " \
                "ORDER BY service_date DESC LIMIT 1"


@register("trend_day_over_day", DAILY + _TREND_LATEST)
def q_trend_latest(spark, d):
    return win.trend(_daily(T(spark, d)), latest_only=True)


@register("trend_all_days", DAILY + _trend_sql("daily"))
def q_trend_all(spark, d):
    return win.trend(_daily(T(spark, d)))


# --------------------------------------------------------------------------
# sort, limit, top-k
# --------------------------------------------------------------------------

_RECENT_ORDER = "ORDER BY service_date DESC NULLS FIRST, start_sec DESC NULLS FIRST, trip_id DESC"


@register("topk_recent_trips_50", with_tables("trip") + f"SELECT {_RECENT_SELECT} FROM trip {_RECENT_ORDER} LIMIT 50")
def q_recent50(spark, d):
    return topk.top_recent(T(spark, d).trip, 50)


@register("topk_recent_trips_15", with_tables("trip") + f"""
SELECT strftime(service_date, '%d.%m.%Y') AS "Datum", line AS "Linie", direction AS "Richtung",
       vehicle_no AS "Fahrzeug", delay_min AS "Versp. min", concat(CAST(occupancy_pct AS VARCHAR), '%') AS "Auslastung",
       boardings AS "Passagiere", status AS "Status"
FROM trip {_RECENT_ORDER} LIMIT 15""")
def q_recent15(spark, d):
    return topk.top_recent_formatted(T(spark, d).trip, 15)


@register("topk_stops", with_tables("ticket") + """
SELECT stop, COUNT(*) AS boardings FROM ticket GROUP BY stop ORDER BY boardings DESC, stop ASC LIMIT 10""")
def q_top_stops(spark, d):
    return topk.top_counts(T(spark, d).ticket, "stop", 10, "boardings")


_PROBLEM_LINES_SQL = f"""
SELECT line, {avg_int('delay_min', 1)} AS avg_delay_min, COUNT(*) AS trip_count
FROM trip WHERE service_date >= {TRIP_AS_OF} - INTERVAL 7 DAY
GROUP BY line ORDER BY avg_delay_min DESC NULLS FIRST, line ASC LIMIT 3"""


@register("topk_problem_lines", with_tables("trip") + _PROBLEM_LINES_SQL)
def q_problem_lines(spark, d):
    return topk.problem_lines(T(spark, d).trip, bnd.TRIP_AS_OF)


_ORDER_NF = ", ".join(f"{c} NULLS FIRST" for c in TICKET_ORDER)


@register("surrogate_keys", with_tables("ticket") + f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY {_ORDER_NF}) AS ticket_id FROM ticket""")
def q_surrogate(spark, d):
    return topk.with_surrogate_key(T(spark, d).ticket, "ticket_id", TICKET_ORDER)


@register("latest_two_days", DAILY + """
SELECT service_date, on_time_pct, total_boardings, avg_occupancy, total_revenue
FROM daily ORDER BY service_date DESC LIMIT 2""")
def q_latest_two(spark, d):
    return topk.latest_days(_daily(T(spark, d)), 2)


@register("kpi_series", DAILY + "SELECT " + ", ".join(_KPI_SERIES_COLS) + " FROM daily ORDER BY service_date")
def q_kpi_series(spark, d):
    return topk.kpi_series(_daily(T(spark, d)))


@register("legacy_recent_trips", with_tables("trip", "bus") + """
SELECT t.service_date, COALESCE(b.plate, 'Unbekannt') AS plate, t.km, t.occupancy_pct
FROM trip t LEFT JOIN bus b ON t.bus_id = b.bus_id
ORDER BY t.service_date DESC NULLS FIRST, t.trip_id DESC LIMIT 15""")
def q_legacy_recent(spark, d):
    t = T(spark, d)
    return topk.recent_with_plate(t.legacy_trip, t.bus, 15)


@register("topk_high_odometer", with_tables("bus") + """
SELECT bus_id, plate, odometer_km FROM bus ORDER BY odometer_km DESC NULLS LAST, bus_id ASC LIMIT 10""")
def q_high_odometer(spark, d):
    return topk.top_odometer(T(spark, d).bus, 10)


_OVERDUE_LIST_SQL = f"""
SELECT m.maintenance_id, m.bus_id, COALESCE(b.plate, 'Unbekannt') AS plate, m.kind, m.status, m.next_due
FROM maintenance m LEFT JOIN bus b ON m.bus_id = b.bus_id
WHERE m.status = 'überfällig' OR m.next_due < {MAINTENANCE_AS_OF}"""


@register("list_overdue_maintenance", with_tables("maintenance", "bus") + _OVERDUE_LIST_SQL)
def q_overdue_list(spark, d):
    t = T(spark, d)
    return topk.overdue_list(t.maintenance, t.bus, bnd.MAINTENANCE_AS_OF)


# --------------------------------------------------------------------------
# data quality
# --------------------------------------------------------------------------


@register("dq_pk_unique", DAILY.replace("WITH trip", f"WITH bus AS ({BINDINGS['bus']}\n),\ntrip", 1) + """
, twice AS (SELECT *, unnest(CASE WHEN trip_id % 1000 = 1 THEN [1, 2] ELSE [1] END) AS copy FROM trip)
SELECT 'trip.trip_id' AS key_name, CAST(trip_id AS VARCHAR) AS key_value, COUNT(*) AS dup_count FROM twice GROUP BY trip_id HAVING COUNT(*) > 1
UNION ALL SELECT 'daily_kpi.service_date', CAST(service_date AS VARCHAR), COUNT(*) FROM daily GROUP BY service_date HAVING COUNT(*) > 1
UNION ALL SELECT 'bus.plate', plate, COUNT(*) FROM (SELECT concat('P', CAST(odometer_km % 100000 AS VARCHAR)) AS plate FROM bus)
  GROUP BY plate HAVING COUNT(*) > 1""")
def q_pk_unique(spark, d):
    """The trip key (every 1000th trip twice, as the test table's is unique),
    the day key of the KPI table, and UNIQUE(plate) on shortened plates."""
    t = T(spark, d)
    copies = F.when(F.col("trip_id") % 1000 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    plates = t.bus.select(F.concat(F.lit("P"), (F.col("odometer_km") % 100000).cast("string")).alias("plate"))
    return dq.key_violations([("trip.trip_id", t.trip.select("trip_id", F.explode(copies)), "trip_id"),
                              ("daily_kpi.service_date", _daily(t), "service_date"), ("bus.plate", plates, "plate")])


_NN_COLS = ("trip_id", "service_date", "line", "start_sec", "delay_min", "energy_kwh", "status")


@register("dq_not_null", with_tables("trip") + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM trip"
    for c in _NN_COLS))
def q_not_null(spark, d):
    return dq.null_counts(T(spark, d).trip, list(_NN_COLS))


@register("dq_foreign_key", with_tables("stray_ticket", "trip", "bus", "maintenance") + """
SELECT 'ticket.trip_id' AS fk_name, COUNT(*) AS orphan_count FROM stray_ticket c
  WHERE c.trip_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trip p WHERE p.trip_id = c.trip_id)
UNION ALL SELECT 'trip.bus_id', COUNT(*) FROM trip c
  WHERE c.bus_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bus p WHERE p.bus_id = c.bus_id)
UNION ALL SELECT 'maintenance.bus_id', COUNT(*) FROM maintenance c
  WHERE c.bus_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bus p WHERE p.bus_id = c.bus_id)""")
def q_foreign_key(spark, d):
    t = T(spark, d)
    return dq.orphan_counts([("ticket.trip_id", t.stray_ticket, t.trip, "trip_id"),
                             ("trip.bus_id", t.trip, t.bus, "bus_id"),
                             ("maintenance.bus_id", t.maintenance, t.bus, "bus_id")])


def _limit_sql(col, kind, arg):
    if kind == "varchar":
        return f"'{col} varchar({arg})'", f"length({col}) > {arg}"
    p, s = arg
    return f"'{col} numeric({p},{s})'", f"abs({col}) >= {10 ** (p - s)}"


@register("dq_length_precision", with_tables("trip") + "\nUNION ALL ".join(
    "SELECT {0} AS rule, CAST(COUNT(*) FILTER (WHERE {1}) AS BIGINT) AS violation_count FROM trip".format(
        *_limit_sql(c, k, a)) for c, (k, a) in TRIP_LIMITS.items()))
def q_length_precision(spark, d):
    return dq.domain_violations(T(spark, d).trip, TRIP_LIMITS)


@register("dq_fill_defaults", with_tables("trip") + """
SELECT * REPLACE (COALESCE(status, 'planmäßig') AS status), TRUE AS productive FROM trip""")
def q_fill_defaults(spark, d):
    return dq.fill_defaults(T(spark, d).trip, {"status": "planmäßig", "productive": True})


_TIME_RE = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def _time_part(i: int) -> str:
    return f"TRY_CAST(regexp_extract(time_raw, '{_TIME_RE}', {i}) AS INT)"


_TIME_OK = f"COALESCE({_time_part(1)} < 24 AND {_time_part(2)} < 60 AND {_time_part(3)} < 60, FALSE)"


@register("dq_coerce_report", with_tables("raw_ticket") + f"""
SELECT 'trip_id' AS column_name, CAST(COUNT(*) FILTER (WHERE trip_id_raw IS NOT NULL AND ({lenient_bigint('trip_id_raw')}) IS NULL) AS BIGINT) AS lost_count FROM raw_ticket
UNION ALL SELECT 'amount_eur', CAST(COUNT(*) FILTER (WHERE amount_raw IS NOT NULL AND TRY_CAST(amount_raw AS DECIMAL(12,2)) IS NULL) AS BIGINT) FROM raw_ticket
UNION ALL SELECT 'validated_time', CAST(COUNT(*) FILTER (WHERE time_raw IS NOT NULL AND NOT {_TIME_OK}) AS BIGINT) FROM raw_ticket""")
def q_coerce_report(spark, d):
    raw = T(spark, d).raw_ticket
    return dq.coercion_losses(raw, {
        "trip_id": ("trip_id_raw", lenient_cast(F.col("trip_id_raw"), "bigint")),
        "amount_eur": ("amount_raw", lenient_cast(F.col("amount_raw"), "decimal(12,2)")),
        "validated_time": ("time_raw", lenient_time_seconds("time_raw")),
    })


@register("validate_period", """
SELECT event_id AS request_id, period, COALESCE(period IN ('daily', 'weekly', 'monthly'), FALSE) AS is_valid
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly'
                                         ELSE event_type END AS period FROM events)""")
def q_validate_period(spark, d):
    ev = T(spark, d).raw("events")
    m = F.col("event_id") % 4
    period = (F.when(m == 0, F.lit("daily")).when(m == 1, F.lit("weekly")).when(m == 2, F.lit("monthly"))
              .otherwise(F.col("event_type")))
    return dq.valid_period(ev.select(F.col("event_id").alias("request_id"), period.alias("period")), "period")


# --------------------------------------------------------------------------
# classification
# --------------------------------------------------------------------------


@register("flag_punctuality_target", DAILY + """
SELECT service_date, on_time_pct, CASE WHEN on_time_pct >= 80 THEN 'gut' ELSE 'kritisch' END AS target_flag
FROM daily""")
def q_target_flag(spark, d):
    daily = _daily(T(spark, d))
    return daily.select("service_date", "on_time_pct", cls.target_flag("on_time_pct").alias("target_flag"))


@register("flag_report_warnings", with_tables("trip") + f"""
SELECT *, COALESCE(avg_delay_min > 5, FALSE) AS delay_warn, COALESCE(on_time_pct < 80, FALSE) AS on_time_warn
FROM ({_REPORT_NULLSAFE_SQL})""")
def q_report_warnings(spark, d):
    return cls.warn_flags(agg.report_kpi_nullsafe(T(spark, d).trip))


@register("flag_target_lines", with_tables("trip") + f"""
SELECT *, on_time_pct < 80 AS below_target, avg_delay_min > 5 AS over_delay_limit FROM (
SELECT line, {on_time(1, null_on_time=False)} AS on_time_pct, {avg_int('delay_min', 1)} AS avg_delay_min
FROM trip GROUP BY line)""")
def q_target_lines(spark, d):
    return cls.vs_target(agg.line_punctuality(T(spark, d).trip))


_LIGHTS = """
       CASE WHEN on_time_pct >= 95 THEN 'green' WHEN on_time_pct >= 85 THEN 'yellow'
            WHEN on_time_pct IS NOT NULL THEN 'red' END AS punctuality_light,
       CASE WHEN avg_occupancy BETWEEN 60 AND 80 THEN 'green' WHEN avg_occupancy IS NOT NULL THEN 'yellow' END
            AS occupancy_light,
       CASE WHEN total_revenue_delta > 0 THEN 'up' WHEN total_revenue_delta < 0 THEN 'down'
            WHEN total_revenue_delta = 0 THEN 'flat' END AS revenue_trend,
       CASE WHEN total_boardings_delta > 0 THEN 'up' WHEN total_boardings_delta < 0 THEN 'down'
            WHEN total_boardings_delta = 0 THEN 'flat' END AS boardings_trend"""


@register("traffic_light", DAILY + f"SELECT *, {_LIGHTS} FROM ({_trend_sql('daily')})")
def q_traffic_light(spark, d):
    return cls.traffic_light(win.trend(_daily(T(spark, d))))


@register("weekend_flag", with_tables("trip") + """
SELECT dayofweek(service_date) IN (0, 6) AS is_weekend, COUNT(*) AS trip_count,
       CAST(SUM(boardings) AS BIGINT) AS boardings
FROM trip GROUP BY 1""")
def q_weekend(spark, d):
    return cls.weekend_split(T(spark, d).trip)


@register("hour_band", with_tables("trip") + f"""
SELECT CASE WHEN start_sec IS NULL THEN NULL
            WHEN start_sec // 3600 BETWEEN 7 AND 9 OR start_sec // 3600 BETWEEN 16 AND 18 THEN 'peak'
            WHEN start_sec // 3600 >= 22 OR start_sec // 3600 <= 5 THEN 'night' ELSE 'normal' END AS hour_band,
       COUNT(*) AS trip_count, {avg2('occupancy_pct', 2)} AS avg_occupancy
FROM trip GROUP BY 1""")
def q_hour_band(spark, d):
    return cls.hour_band_summary(T(spark, d).trip)


@register("derive_status", with_tables("trip") + """
SELECT trip_id, status, derived_status, derived_status = status AS status_matches FROM (
SELECT *, CASE WHEN status = 'ausgefallen' THEN 'ausgefallen' WHEN delay_min IS NULL THEN NULL
               WHEN delay_min >= 5 THEN 'verspätet' ELSE 'planmäßig' END AS derived_status FROM trip)""")
def q_derive_status(spark, d):
    return cls.derive_status(T(spark, d).trip)


# --------------------------------------------------------------------------
# report assembly and text
# --------------------------------------------------------------------------

def _fmt1(x):
    return f"printf('%.1f', {x})"


_CARDS_SQL = f"""
SELECT 'dashboard' AS card_set, 1 AS position, 'Fahrten gesamt' AS label, format('{{:,}}', trips) AS value_text, FALSE AS warn FROM o
UNION ALL SELECT 'dashboard', 2, 'Ø Auslastung', concat(COALESCE({_fmt1('avg_occupancy')}, 'None'), '%'), FALSE FROM o
UNION ALL SELECT 'dashboard', 3, 'Ø Verspätung', concat(COALESCE({_fmt1('avg_delay_min')}, 'None'), ' min'), FALSE FROM o
UNION ALL SELECT 'dashboard', 4, 'Passagiere', COALESCE(format('{{:,}}', boardings), 'None'), FALSE FROM o
UNION ALL SELECT 'dashboard', 5, 'Energie', concat(COALESCE(format('{{:,}}', CAST(energy_kwh AS BIGINT)), 'None'), ' kWh'), FALSE FROM o
UNION ALL SELECT 'dashboard', 6, 'Pünktlichkeit', concat(COALESCE({_fmt1('on_time_pct')}, 'None'), '%'),
                 COALESCE(on_time_pct < 80, TRUE) FROM o
UNION ALL SELECT 'report', 1, 'Fahrten gesamt', format('{{:,}}', trips), FALSE FROM r
UNION ALL SELECT 'report', 2, 'Passagiere', format('{{:,}}', boardings), FALSE FROM r
UNION ALL SELECT 'report', 3, 'Ø Auslastung', concat({_fmt1('avg_occupancy')}, '%'), FALSE FROM r
UNION ALL SELECT 'report', 4, 'Ø Verspätung min', {_fmt1('avg_delay_min')}, avg_delay_min > 5 FROM r
UNION ALL SELECT 'report', 5, 'Gesamt-km', format('{{:,}}', CAST(total_km AS BIGINT)), FALSE FROM r
UNION ALL SELECT 'report', 6, 'Pünktlichkeit', concat({_fmt1('on_time_pct')}, '%'), on_time_pct < 80 FROM r"""


@register("kpi_cards", with_tables("trip", extra=(("o", _OVERVIEW_SQL), ("r", _REPORT_NULLSAFE_SQL)))
          + _CARDS_SQL)
def q_kpi_cards(spark, d):
    return rpt.kpi_cards_from_trips(T(spark, d).trip)


@register("problem_lines_text", with_tables("trip", extra=(("k4", _PROBLEM_LINES_SQL),)) + f"""
SELECT COALESCE(string_agg(concat('- Linie ', line, ': ', COALESCE({_fmt1('avg_delay_min')}, 'None'),
                                  ' Min Ø Verspätung (', CAST(trip_count AS VARCHAR), ' Fahrten)'),
                           chr(10) ORDER BY avg_delay_min DESC NULLS FIRST, line),
                'Alle Linien im grünen Bereich.') AS problem_lines_text
FROM k4""")
def q_problem_lines_text(spark, d):
    return rpt.problem_lines_text(topk.problem_lines(T(spark, d).trip, bnd.TRIP_AS_OF))


@register("metric_table", DAILY + f"""
, lit AS (SELECT *, {_LIGHTS} FROM ({_TREND_LATEST}))
SELECT 'punctuality' AS metric, concat(printf('%.2f', on_time_pct), '%') AS value, CAST(NULL AS VARCHAR) AS trend,
       punctuality_light AS status FROM lit
UNION ALL SELECT 'boardings', CAST(total_boardings AS VARCHAR), boardings_trend, NULL FROM lit
UNION ALL SELECT 'occupancy', concat(printf('%.2f', avg_occupancy), '%'), NULL, occupancy_light FROM lit
UNION ALL SELECT 'revenue', concat(CAST(total_revenue AS VARCHAR), ' €'), revenue_trend, NULL FROM lit""")
def q_metric_table(spark, d):
    latest = win.trend(_daily(T(spark, d)), latest_only=True)
    return rpt.metric_table(cls.traffic_light(latest))


RUN_TS = _dt.datetime(2026, 4, 7, 6, 0, 0)  # fixed report run time (UTC) for reproducible manifests


@register("report_manifest", with_tables("trip", extra=(("g2", _REPORT_SQL),)) + """
SELECT dataset, row_count, 'Wöchentlicher' AS kind_label, 'April 2026' AS period_label,
       '07.04.2026 08:00' AS created_at, row_count > 0 AS has_data FROM (
  SELECT 'report_kpi' AS dataset, COUNT(*) AS row_count FROM g2
  UNION ALL SELECT 'recent_trips', LEAST(COUNT(*), 15) FROM trip
  UNION ALL SELECT 'line_report', COUNT(DISTINCT line) FROM trip)""")
def q_report_manifest(spark, d):
    trip = T(spark, d).trip
    frames = {"report_kpi": agg.report_kpi(trip), "recent_trips": topk.top_recent_formatted(trip, 15),
              "line_report": agg.line_report(trip)}
    written = tbl.write_report(frames, scratch_path(spark, "reports"), RUN_TS, "weekly", fmt="json")
    return rpt.report_manifest(written, "weekly", RUN_TS)


@register("fleet_snapshot", with_tables("bus", "maintenance", "trip", extra=(("ov", _OVERDUE_LIST_SQL),)) + f"""
SELECT (SELECT COUNT(*) FROM bus) AS total_buses,
       (SELECT COUNT(*) FILTER (WHERE status = 'aktiv') FROM bus) AS active_buses,
       (SELECT COUNT(*) FILTER (WHERE status = 'in_wartung') FROM bus) AS in_maintenance,
       (SELECT COUNT(*) FROM ov) AS overdue_maintenance,
       (SELECT {avg2('occupancy_pct', 2)} FROM trip) AS avg_occupancy,
       (SELECT CAST(COALESCE(SUM(km), 0) AS DECIMAL(22,2)) FROM trip) AS total_km,
       '20.01.2024' AS report_date""")
def q_fleet_snapshot(spark, d):
    t = T(spark, d)
    return rpt.fleet_snapshot(t.bus, t.maintenance, t.legacy_trip, bnd.MAINTENANCE_AS_OF)


@register("fleet_snapshot_lists", with_tables("bus", "maintenance", "trip", extra=(("ov", _OVERDUE_LIST_SQL),)) + """
SELECT 'overdue' AS list, CAST(NULL AS INT) AS place, maintenance_id AS ref_id, plate, next_due AS day, kind AS value FROM ov
UNION ALL SELECT 'recent_trips', CAST(place AS INT), t.trip_id, COALESCE(b.plate, 'Unbekannt'), t.service_date, t.line
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY service_date DESC NULLS FIRST, trip_id DESC) AS place FROM trip) t
  LEFT JOIN bus b ON t.bus_id = b.bus_id WHERE place <= 10
UNION ALL SELECT 'high_odometer', CAST(place AS INT), bus_id, plate, NULL, CAST(odometer_km AS VARCHAR)
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY odometer_km DESC NULLS LAST, bus_id) AS place FROM bus) WHERE place <= 10""")
def q_fleet_snapshot_lists(spark, d):
    t = T(spark, d)
    return rpt.fleet_snapshot_lists(t.bus, t.maintenance, t.legacy_trip, bnd.MAINTENANCE_AS_OF, 10)


def _period_sql(unit: str) -> str:
    return with_tables("trip") + f"""
SELECT CAST(date_trunc('{unit}', service_date) AS DATE) AS period_start, COUNT(*) AS trips,
       CAST(SUM(boardings) AS BIGINT) AS boardings, {avg2('occupancy_pct', 1)} AS avg_occupancy,
       {avg_int('COALESCE(delay_min, 0)', 1, 'COUNT(*)')} AS avg_delay_min,
       CAST(ROUND(SUM(km), 0) AS DECIMAL(22,0)) AS total_km, {on_time(1)} AS on_time_pct
FROM trip GROUP BY 1"""


def _period_line_sql(unit: str) -> str:
    return with_tables("trip") + f"""
SELECT CAST(date_trunc('{unit}', service_date) AS DATE) AS period_start, line, COUNT(*) AS trips,
       {avg_int('COALESCE(delay_min, 0)', 1, 'COUNT(*)')} AS avg_delay_min, {on_time(1)} AS on_time_pct
FROM trip GROUP BY 1, 2"""


# period_report is the monthly one
for _unit, _suffix in (("day", "_daily"), ("week", "_weekly"), ("month", "")):
    register(f"period_report{_suffix}", _period_sql(_unit))(
        lambda spark, d, unit=_unit: rpt.period_report(T(spark, d).trip, unit))
    register(f"period_line_report{_suffix}", _period_line_sql(_unit))(
        lambda spark, d, unit=_unit: rpt.period_line_report(T(spark, d).trip, unit))


def _markdown_texts(t: FleetTables):
    conv = t.raw("conversations")
    turn = F.col("turn") % 3
    decorated = (F.when(turn == 0, F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text")))
                 .when(turn == 1, F.concat(F.lit("**"), F.col("text"), F.lit("**"))).otherwise(F.col("text")))
    conv_texts = conv.select(F.lit("conversation").alias("source"),
                             F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
                             .alias("text_id"), decorated.alias("text"))
    docs = t.raw("documents").select(F.lit("document").alias("source"), F.col("doc_id").cast("string")
                                     .alias("text_id"), "text")
    return conv_texts.unionByName(docs)


_SQL_WS = STRIP_PATTERN.replace("'", "''")
_MD_TEXTS = f"""
SELECT 'conversation' AS source, concat(CAST(conv_id AS VARCHAR), '/', CAST(turn AS VARCHAR)) AS text_id,
       CASE turn % 3 WHEN 0 THEN concat('## ', role, chr(10) || chr(10), text)
                     WHEN 1 THEN concat('**', text, '**') ELSE text END AS text
FROM conversations
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), text FROM documents"""


@register("markdown_paragraphs", f"""
WITH texts AS ({_MD_TEXTS}),
parts AS (SELECT source, text_id, unnest(p) AS raw, CAST(generate_subscripts(p, 1) - 1 AS INT) AS paragraph_no
          FROM (SELECT source, text_id, string_split(text, chr(10) || chr(10)) AS p FROM texts)),
stripped AS (SELECT source, text_id, paragraph_no, regexp_replace(raw, '{_SQL_WS}', '', 'g') AS s FROM parts)
SELECT source, text_id, paragraph_no,
       replace(replace(replace(replace(s, '**', ''), '###', ''), '##', ''), '#', '') AS paragraph
FROM stripped WHERE s <> ''""")
def q_markdown(spark, d):
    return txt.markdown_paragraphs(_markdown_texts(T(spark, d)), ["source", "text_id"])


@register("text_lines_stats", f"""
WITH texts AS (SELECT 'document' AS source, CAST(doc_id AS VARCHAR) AS text_id, text FROM documents
               UNION ALL SELECT 'conversation', concat(CAST(conv_id AS VARCHAR), '/', CAST(turn AS VARCHAR)), text FROM conversations),
parts AS (SELECT source, text_id, CAST(length(text) AS INT) AS raw_chars, unnest(p) AS raw,
                 CAST(generate_subscripts(p, 1) - 1 AS INT) AS line_no
          FROM (SELECT *, string_split(text, chr(10)) AS p FROM texts))
SELECT source, text_id, raw_chars, line_no, regexp_replace(raw, '{_SQL_WS}', '', 'g') AS line,
       regexp_replace(raw, '{_SQL_WS}', '', 'g') = '' AS is_blank
FROM parts""")
def q_text_lines(spark, d):
    t = T(spark, d)
    docs = t.raw("documents").select(F.lit("document").alias("source"), F.col("doc_id").cast("string").alias("text_id"), "text")
    turns = t.raw("conversations").select(F.lit("conversation").alias("source"),
                                          F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"), "text")
    return txt.text_lines_stats(docs.unionByName(turns), ["source", "text_id"])


# --------------------------------------------------------------------------
# sources
# --------------------------------------------------------------------------

_BAD_TIME_EVERY = 37


def _trip_csv_frame(trip):
    hms = seconds_to_hms("start_sec")
    start = F.when(F.col("trip_id") % _BAD_TIME_EVERY == 0, F.lit("25:61:00")).otherwise(hms)
    none = F.lit(None).cast("string")
    return trip.select(
        F.col("trip_id").cast("string").alias("trip_id"),
        F.date_format("service_date", "yyyy-MM-dd").alias("service_date"),
        "line", "direction", "vehicle_no", "driver_id", start.alias("start_time"),
        none.alias("end_time"), hms.alias("planned_start"), none.alias("planned_end"),
        *[F.col(c).cast("string").alias(c) for c in ("delay_min", "km", "boardings", "occupancy_pct",
                                                     "energy_kwh")],
        "status", F.lit("true").alias("productive"), none.alias("trip_type"))


def _ticket_csv_frame(raw):
    return raw.select(F.col("trip_id_raw").alias("trip_id"), F.col("validated_at_raw").alias("validated_at"),
                      "fare_type", F.col("amount_raw").alias("amount_eur"), "payment_method", "stop")


@register("src_csv_trips", with_tables("trip") + f"""
SELECT trip_id, service_date, line, direction, vehicle_no, driver_id,
       CASE WHEN trip_id % {_BAD_TIME_EVERY} = 0 THEN NULL ELSE start_sec END AS start_sec,
       CAST(NULL AS INT) AS end_sec, start_sec AS planned_start_sec, CAST(NULL AS INT) AS planned_end_sec,
       delay_min, km, boardings, occupancy_pct, energy_kwh, status, TRUE AS productive,
       CAST(1 AS SMALLINT) AS trip_type
FROM trip""")
def q_csv_trips(spark, d):
    """Two exports: one in the usual order, one with its fields turned round,
    other header names and without the productive and trip-type fields."""
    rows = _trip_csv_frame(T(spark, d).trip)
    usual, turned = scratch_path(spark, "trips-csv"), scratch_path(spark, "trips-csv-turned")
    names = {f"x_{c}": c for c in rows.columns}
    odd = F.col("trip_id").cast("bigint") % 2 == 1
    write_csv(rows.where(~odd), usual)
    write_csv(rows.where(odd).select(*[F.col(c).alias(f"x_{c}") for c in reversed(rows.columns) if c not in ("productive", "trip_type")]), turned)
    return read_trips_csv(spark, [usual, turned], names)


@register("src_csv_tickets", with_tables("raw_ticket") + f"""
SELECT {lenient_bigint('trip_id_raw')} AS trip_id, CAST(validated_at_raw AS TIMESTAMP) AS validated_at, fare_type,
       TRY_CAST(amount_raw AS DECIMAL(12,2)) AS amount_eur, payment_method, stop
FROM raw_ticket""")
def q_csv_tickets(spark, d):
    frame = _ticket_csv_frame(T(spark, d).raw_ticket)
    card = F.col("payment_method") == "Karte"
    usual, turned = scratch_path(spark, "tickets-csv"), scratch_path(spark, "tickets-csv-turned")
    write_csv(frame.where(~card), usual)
    write_csv(frame.where(card).select(*reversed(frame.columns), F.lit("x").alias("remark")), turned)
    return read_tickets_csv(spark, [usual, turned])


@register("src_table_scan", with_tables("trip") + "SELECT * FROM trip")
def q_table_scan(spark, d):
    return T(spark, d).trip


@register("src_multi_depot_union", with_tables("trip") + f"""
SELECT {', '.join(c for c in TRIP.fieldNames() if c not in ('start_sec', 'energy_kwh'))},
       CASE WHEN trip_id % 3 = 2 THEN NULL ELSE start_sec END AS start_sec,
       CASE WHEN trip_id % 3 = 1 THEN NULL ELSE energy_kwh END AS energy_kwh,
       CASE trip_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END AS depot
FROM trip""")
def q_depots(spark, d):
    trip = T(spark, d).trip
    k = F.col("trip_id") % 3
    return union_depots({"north": trip.where(k == 0),
                         "south": trip.where(k == 1).drop("energy_kwh"),
                         "west": trip.where(k == 2).drop("start_sec")})


_ADHOC = """SELECT line, direction, COUNT(*) AS trips, CAST(SUM(boardings) AS BIGINT) AS boardings,
       MAX(service_date) AS last_day
FROM trip GROUP BY line, direction"""


@register("src_ad_hoc_sql", with_tables("trip") + _ADHOC)
def q_ad_hoc(spark, d):
    return run_sql(spark, _ADHOC, {"trip": T(spark, d).trip})


# --------------------------------------------------------------------------
# sinks and table maintenance (write, then read back)
# --------------------------------------------------------------------------

_SPLIT_DAY = _dt.date(1998, 1, 1)


@register("sink_append", with_tables("trip") + "SELECT * FROM trip")
def q_append(spark, d):
    trip = T(spark, d).trip
    path = scratch_path(spark, "append")
    tbl.append(trip.where(F.col("service_date") < F.lit(_SPLIT_DAY)), path)
    tbl.append(trip.where(F.col("service_date") >= F.lit(_SPLIT_DAY)), path)
    return spark.read.schema(trip.schema).parquet(path)


@register("sink_full_refresh", with_tables("ticket") + "SELECT * FROM ticket")
def q_full_refresh(spark, d):
    ticket = T(spark, d).ticket
    path = scratch_path(spark, "refresh")
    tbl.overwrite(ticket.where(F.col("payment_method") == "Bar"), path)
    tbl.overwrite(ticket, path)
    return tbl.read_stored(spark, path)


@register("sink_upsert_daily", with_tables("trip", "ticket", extra=(
    ("daily", _daily_sql()), ("daily2", _daily_sql("t.boardings * 2")))) + f"""
SELECT * FROM daily WHERE service_date < DATE '{bnd.UPSERT_FROM}'
UNION ALL SELECT * FROM daily2 WHERE service_date >= DATE '{bnd.UPSERT_FROM}'
UNION ALL SELECT * REPLACE (CAST(service_date + INTERVAL 1 DAY AS DATE) AS service_date)
          FROM daily2 WHERE service_date = (SELECT MAX(service_date) FROM daily2)""")
def q_upsert(spark, d):
    """Writes the KPI table by month, upserts changed days and one new day into
    it, and reads it back."""
    t = T(spark, d)
    path = scratch_path(spark, "kpi-upsert")
    tbl.upsert_table(with_month(_daily(t)), path, ["service_date"], MONTH)
    doubled = agg.daily_kpi(t.trip.withColumn("boardings", F.col("boardings") * 2), t.ticket)
    # the last day arrives twice: as itself and as the day after
    last = F.lit(tbl.read_stored(spark, path).agg(F.max("service_date")).first()[0])
    days = F.when(F.col("service_date") == last, F.array("service_date", F.date_add("service_date", 1))).otherwise(F.array("service_date"))
    incoming = (doubled.where(F.col("service_date") >= F.lit(bnd.UPSERT_FROM)).withColumn("days", days)
                .withColumn("service_date", F.explode("days")).drop("days"))
    tbl.upsert_table(with_month(incoming), path, ["service_date"], MONTH)
    return tbl.read_stored(spark, path).select(*DAILY_KPI.fieldNames())


@register("sink_insert_select", DAILY + "SELECT *, CAST(year(service_date) AS INT) AS service_year FROM daily")
def q_insert_select(spark, d):
    daily = _daily(T(spark, d)).withColumn("service_year", F.year("service_date"))
    return tbl.materialize(daily, scratch_path(spark, "daily-kpi"), ["service_year"])


@register("evolve_add_columns", with_tables("trip") + """
SELECT *, CAST(NULL AS INT) AS base_version, CAST(NULL AS INT) AS trip_fid, CAST(NULL AS SMALLINT) AS trip_type,
       TRUE AS productive, CAST(NULL AS VARCHAR) AS trip_label, CAST(NULL AS INT) AS start_stop_no,
       CAST(NULL AS INT) AS end_stop_no
FROM trip""")
def q_evolve(spark, d):
    return tbl.add_columns_if_missing(T(spark, d).trip)


@register("default_missing_columns", with_tables("trip") + """
SELECT *, TRUE AS productive, CAST(1 AS SMALLINT) AS trip_type FROM trip""")
def q_default_missing(spark, d):
    return tbl.default_missing_columns(T(spark, d).trip, {"productive": (True, "boolean"),
                                                          "trip_type": (1, "smallint")})


@register("delete_cascade", with_tables("ticket", "trip") + """
SELECT * FROM ticket c WHERE NOT EXISTS (
  SELECT 1 FROM trip p WHERE p.status = 'ausgefallen' AND p.trip_id = c.trip_id)""")
def q_cascade(spark, d):
    t = T(spark, d)
    _, children = tbl.cascade_delete(t.trip, t.ticket, F.col("status") == "ausgefallen", "trip_id")
    return children


@register("load_audit", with_tables("trip", "ticket") + """
SELECT table_name, load_date, rows_loaded,
       CAST(SUM(rows_loaded) OVER (PARTITION BY table_name ORDER BY load_date
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_rows
FROM (SELECT 'trip' AS table_name, service_date AS load_date, COUNT(*) AS rows_loaded FROM trip GROUP BY 2
      UNION ALL SELECT 'ticket', CAST(validated_at AS DATE), COUNT(*) FROM ticket GROUP BY 2)""")
def q_load_audit(spark, d):
    t = T(spark, d)
    return tbl.load_audit({"trip": (t.trip, F.col("service_date")),
                           "ticket": (t.ticket, F.to_date("validated_at"))})


@register("physical_layout", with_tables("trip") + "SELECT *, strftime(service_date, '%Y-%m') AS service_month FROM trip")
def q_layout(spark, d):
    trip = T(spark, d).trip.withColumn("service_month", F.date_format("service_date", "yyyy-MM"))
    path = scratch_path(spark, "trip-layout")
    tbl.write_clustered(trip, path, partition_col="service_month", cluster_col="line")
    return spark.read.schema(trip.schema).parquet(path).select(*trip.columns)


@register("sink_report_tables", with_tables("trip", extra=(("o", _OVERVIEW_SQL),)) + """
SELECT 'overview' AS dataset, COUNT(*) AS row_count FROM o
UNION ALL SELECT 'line_report', COUNT(DISTINCT line) FROM trip
UNION ALL SELECT 'recent_trips', LEAST(COUNT(*), 15) FROM trip""")
def q_report_tables(spark, d):
    trip = T(spark, d).trip
    frames = {"overview": agg.overview_kpi(trip), "line_report": agg.line_report(trip),
              "recent_trips": topk.top_recent_formatted(trip, 15)}
    return tbl.write_report(frames, scratch_path(spark, "reports"), RUN_TS, "weekly").select("dataset", "row_count")


# --------------------------------------------------------------------------
# streaming (drained with an available-now trigger)
# --------------------------------------------------------------------------


@register("stream_daily_revenue", DAILY_REVENUE_SQL)
def q_stream_revenue(spark, d):
    src = scratch_path(spark, "stream-tickets")
    T(spark, d).ticket.select(*TICKET.fieldNames()).write.parquet(src)
    return stream_daily_revenue(spark, src, scratch_path(spark, "daily-revenue"),
                                scratch_path(spark, "ckpt-revenue"), watermark="400 days").table


@register("stream_upsert_kpi", DAILY_KPI_SQL)
def q_stream_kpi(spark, d):
    t = T(spark, d)
    trips, tickets = scratch_path(spark, "stream-trips"), scratch_path(spark, "stream-tickets")
    by_month = with_month(t.trip.select(*TRIP.fieldNames()))
    by_month.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(trips)
    t.ticket.select(*TICKET.fieldNames()).write.parquet(tickets)
    return stream_upsert_kpi(spark, trips, tickets, scratch_path(spark, "daily-kpi-stream"),
                             scratch_path(spark, "ckpt-kpi"))


# --------------------------------------------------------------------------
# the batch import as one flow
# --------------------------------------------------------------------------


@register("pipeline_import", with_tables("trip", "raw_ticket", extra=(
    ("ticket", f"""SELECT {lenient_bigint('trip_id_raw')} AS trip_id, TRY_CAST(amount_raw AS DECIMAL(12,2)) AS amount_eur FROM raw_ticket
      WHERE {lenient_bigint('trip_id_raw')} IN (SELECT trip_id FROM trip)"""),)) + f"""
SELECT d.*, CAST((SELECT COUNT(*) FROM trip) AS BIGINT) AS trips, CAST((SELECT COUNT(*) FROM ticket) AS BIGINT) AS tickets
FROM ({_daily_sql()}) d""")
def q_pipeline_import(spark, d):
    """An import of the first half of the trips, then one of all of them over
    it; the day table read back, with the row counts of the other two."""
    trips, tickets = _trip_csv_frame(T(spark, d).trip), _ticket_csv_frame(T(spark, d).raw_ticket)
    half, rest, paid = (scratch_path(spark, n) for n in ("import-half", "import-rest", "import-tickets"))
    early = F.col("trip_id").cast("bigint") % 2 == 0
    write_csv(trips.where(early), half)
    write_csv(trips.where(~early), rest)
    write_csv(tickets, paid)
    root = scratch_path(spark, "import")
    import_batch(spark, half, None, root)
    tables = import_batch(spark, [half, rest], paid, root)
    daily = tables["daily_kpi"]
    for name in ("trip", "ticket"):
        n = tables[name].agg(F.count(F.lit(1)).alias("n")).first()["n"]
        daily = daily.withColumn(f"{name}s", F.lit(n).cast("bigint"))
    return daily
