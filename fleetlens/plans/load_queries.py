"""Registered queries of loading: layouts, repeated and checked loads, rejected
lines, late and orphaned rows, figures kept by deltas."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from fleetlens.operators import layout, rollup
from fleetlens.operators import report as rpt
from fleetlens.operators import tables as tbl
from fleetlens.operators.key_index import add_load
from fleetlens.operators.manifest import LoadRejected, Manifest
from fleetlens.plans.oracle_sql import avg2, avg_int, lenient_bigint, on_time, with_tables
from fleetlens.plans.queries import DAILY_REVENUE_SQL, _daily_sql, _limit_sql, _ticket_csv_frame
from fleetlens.plans.registry import register
from fleetlens.schemas import TICKET, TRIP, TRIP_LIMITS
from fleetlens.session import scratch_path
from fleetlens.sources.bindings import FleetTables as T
from fleetlens.sources.files import write_csv
from fleetlens.sources.rejects import load_csv, read_rejects, ticket_fields
from fleetlens.streaming.daily_revenue import merge_late, stream_daily_revenue
from fleetlens.streaming.orphans import heartbeat, read_orphans, stream_orphans


@register("layout_multi_dim", with_tables("trip") + "SELECT * FROM trip")
def q_layout_multi_dim(spark, d):
    trip = T(spark, d).trip
    path = scratch_path(spark, "trip-curve")
    layout.write_curve(trip, path, ["service_date", "line", "vehicle_no"], tie=["trip_id"], bloom={"vehicle_no": 10_000, "trip_id": 100_000})
    return spark.read.schema(trip.schema).parquet(path)


@register("sink_append_once", with_tables("trip") + "SELECT * FROM trip")
def q_append_once(spark, d):
    """Two loads, the first made twice, the second stopped before its commit
    and then made again."""
    trip = T(spark, d).trip
    path = scratch_path(spark, "append-once")
    odd = F.col("trip_id") % 2 == 1
    for _ in range(2):
        tbl.append_once(trip.where(odd), path, "odd trips")
    m = Manifest(spark, path)
    m.update(lambda t: setattr(t, "touched", t.append(tbl.TABLE, trip.where(~odd), "even trips") and False))  # written, never committed
    tbl.append_once(trip.where(~odd), path, "even trips")
    return tbl.read_stored(spark, path)


_NOT_NULL = ("trip_id", "service_date", "line", "start_sec", "delay_min", "energy_kwh", "status")


def _rules() -> dict:
    rules = {f"{c} not null": F.col(c).isNull() for c in _NOT_NULL}
    for c, (kind, arg) in TRIP_LIMITS.items():
        if kind == "varchar":
            rules[f"{c} varchar({arg})"] = F.char_length(c) > arg
        else:
            rules[f"{c} numeric({arg[0]},{arg[1]})"] = F.abs(F.col(c)) >= F.lit(10 ** (arg[0] - arg[1]))
    return rules


@register("sink_checked_load", with_tables("trip") + "\nUNION ALL ".join(
    [f"SELECT '{c} not null' AS rule, CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations, COUNT(*) AS committed_rows FROM trip" for c in _NOT_NULL]
    + ["SELECT {0}, CAST(COUNT(*) FILTER (WHERE {1}) AS BIGINT), COUNT(*) FROM trip".format(*_limit_sql(c, k, a)) for c, (k, a) in TRIP_LIMITS.items()]))
def q_checked_load(spark, d):
    """The rules' violations, counted while the trips are written: a load that
    allows none is rejected, one that allows them is committed."""
    trip, path, counts = T(spark, d).trip, scratch_path(spark, "checked"), {}
    try:
        tbl.append_once(trip, path, "strict", _rules())
        raise AssertionError("the strict load was committed")
    except LoadRejected:
        pass
    Manifest(spark, path).update(lambda t: counts.update(t.overwrite(tbl.TABLE, trip, rules=_rules(), limit=1 << 62)))
    rows = [(rule, counts[rule]) for rule in _rules()]
    n = tbl.read_stored(spark, path).count()
    return spark.createDataFrame(rows, "rule string, violations long").withColumn("committed_rows", F.lit(n).cast("long"))


@register("src_csv_rejects", with_tables("raw_ticket") + f"""
, line AS (SELECT *, concat_ws(',', trip_id_raw, validated_at_raw, fare_type, amount_raw, payment_method, stop) AS line FROM raw_ticket)
SELECT line AS raw_line, 'trip_id' AS "column", trip_id_raw AS value, 'not a whole number' AS reason FROM line WHERE {lenient_bigint('trip_id_raw')} IS NULL
UNION ALL SELECT line AS raw_line, 'amount_eur', amount_raw, 'not a amount' FROM line WHERE TRY_CAST(amount_raw AS DECIMAL(12,2)) IS NULL""")
def q_csv_rejects(spark, d):
    path, root = scratch_path(spark, "tickets-csv"), scratch_path(spark, "tickets-loaded")
    write_csv(_ticket_csv_frame(T(spark, d).raw_ticket), path)
    load_csv(spark, path, ticket_fields(), root, "tickets")
    return read_rejects(spark, root).drop("file")


@register("period_cube", with_tables("trip") + "\nUNION ALL ".join(f"""
SELECT '{u}' AS grain, '{scope}' AS scope, CAST(date_trunc('{u}', service_date) AS DATE) AS period_start, {line} AS line, COUNT(*) AS trips,
       CAST(SUM(boardings) AS BIGINT) AS boardings, {avg2('occupancy_pct', 1)} AS avg_occupancy, {avg_int('COALESCE(delay_min, 0)', 1, 'COUNT(*)')} AS avg_delay_min,
       CAST(ROUND(SUM(km), 0) AS DECIMAL(22,0)) AS total_km, {on_time(1)} AS on_time_pct
FROM trip GROUP BY {keys}""" for u in rpt.PERIOD_UNITS for scope, line, keys in (("all", "CAST(NULL AS VARCHAR)", "3"), ("line", "line", "3, 4"))))
def q_period_cube(spark, d):
    return rpt.period_cube(T(spark, d).trip)


_CHANGED = """SELECT * REPLACE (CASE WHEN trip_id % 7 = 0 THEN boardings * 2 ELSE boardings END AS boardings,
    CASE WHEN trip_id % 11 = 0 THEN CAST(service_date + INTERVAL 1 DAY AS DATE) ELSE service_date END AS service_date) FROM trip0 WHERE status != 'ausgefallen'"""


@register("kpi_incremental", with_tables("trip", "ticket").replace("trip AS", "trip0 AS", 1).rstrip() + f", trip AS ({_CHANGED})" + _daily_sql())
def q_kpi_incremental(spark, d):
    """Two inserts, an update of figures, a move to other days and a cascaded
    delete, each as a change of its own rows; one of them comes twice."""
    t = T(spark, d)
    root, trip, ticket = scratch_path(spark, "kpi-state"), t.trip, t.ticket
    first = F.col("trip_id") % 3 != 0
    more = trip.withColumn("boardings", F.when(F.col("trip_id") % 7 == 0, F.col("boardings") * 2).otherwise(F.col("boardings")))
    moved = more.withColumn("service_date", F.when(F.col("trip_id") % 11 == 0, F.date_add("service_date", 1)).otherwise(F.col("service_date")))
    seven, eleven, gone = F.col("trip_id") % 7 == 0, F.col("trip_id") % 11 == 0, F.col("status") == "ausgefallen"
    late = F.col("trip_id") % 5 == 0

    def of(rows):
        return ticket.join(rows.select("trip_id"), "trip_id", "left_semi")

    rollup.apply(spark, root, rollup.Change(trips_in=trip.where(first), tickets_in=ticket.where(first & ~late)), "insert 1")
    rollup.apply(spark, root, rollup.Change(trips_in=trip.where(~first), tickets_in=ticket.where(~first & ~late)), "insert 2")
    for _ in range(2):
        rollup.apply(spark, root, rollup.Change(tickets_in=ticket.where(late), dates=trip), "late tickets")
    rollup.apply(spark, root, rollup.Change(trips_out=trip.where(seven), trips_in=more.where(seven)), "update")
    rollup.apply(spark, root, rollup.Change(more.where(eleven), ticket.where(eleven), moved.where(eleven), ticket.where(eleven)), "move")
    return rollup.apply(spark, root, rollup.Change(moved.where(gone), of(moved.where(gone))), "delete")


@register("dq_pk_incremental", with_tables("trip") + """
SELECT trip_id AS key_value, COUNT(*) AS dup_count FROM (SELECT trip_id FROM trip UNION ALL SELECT trip_id FROM trip WHERE trip_id % 1000 IN (1, 2))
GROUP BY trip_id HAVING COUNT(*) > 1""")
def q_pk_incremental(spark, d):
    """Three loads: the even trips; the odd ones, some twice; some even ones again."""
    trip, root = T(spark, d).trip, scratch_path(spark, "key-index")
    copies = F.when(F.col("trip_id") % 1000 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    loads = [trip.where("trip_id % 2 = 0"), trip.where("trip_id % 2 = 1").select("trip_id", F.explode(copies)), trip.where("trip_id % 1000 = 2")]
    found = [add_load(spark, root, load, "trip_id") for load in loads]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: A file is written by one task, which reads its tickets.
_TICKETS_A_FILE = 2_000_000


def _deal(ticket, files):
    """Tickets in so many partitions, by all columns: those of one trip, or of none, do not meet in one."""
    return ticket.repartition(files, *ticket.columns)


@register("stream_late_rows", DAILY_REVENUE_SQL)
def q_stream_late_rows(spark, d):
    """Tickets in files that each span all days, so most are late from the
    second of three micro-batches on; they are kept beside the table and merged.
    A micro-batch is one file, or as many as its tickets fill."""
    src, out = scratch_path(spark, "late-tickets"), scratch_path(spark, "late-out")
    ticket = T(spark, d).ticket.select(*TICKET.fieldNames())
    files = max(1, -(-ticket.count() // (3 * _TICKETS_A_FILE)))
    _deal(ticket, 3 * files).write.parquet(src)
    stream_daily_revenue(spark, src, out, scratch_path(spark, "late-ckpt"), watermark="30 days", files_per_trigger=files)
    return merge_late(spark, out)


@register("stream_orphans", with_tables("stray_ticket", "trip") + """
SELECT * FROM stray_ticket c WHERE c.trip_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trip p WHERE p.trip_id = c.trip_id)""")
def q_stream_orphans(spark, d):
    """The test tables' ticket times have nothing to do with the day of the
    trip (up to seven years apart either way), so the range is as wide."""
    t = T(spark, d)
    tickets, trips, out = (scratch_path(spark, n) for n in ("orphan-tickets", "orphan-trips", "orphan-out"))
    t.stray_ticket.select(*TICKET.fieldNames()).write.parquet(tickets)
    t.trip.select(*TRIP.fieldNames()).write.parquet(trips)
    heartbeat(spark, tickets, trips, _dt.datetime(2100, 1, 1))
    stream_orphans(spark, tickets, trips, out, scratch_path(spark, "orphan-ckpt"), wait="2600 days", after="2600 days")
    return read_orphans(spark, out)
