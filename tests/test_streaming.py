"""Streaming: late rows beyond the watermark go to a side table; a drained stream
equals the batch result; replayed files change nothing; orphans wait for their trip."""

from __future__ import annotations

import datetime as dt
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.manifest import Manifest
from fleetlens.schemas import TICKET, TRIP
from fleetlens.session import scratch_path
from fleetlens.sources.bindings import INPUT_SCHEMAS
from fleetlens.streaming.daily_revenue import merge_late, stream_daily_revenue
from fleetlens.streaming.orphans import heartbeat, stream_orphans
from fleetlens.streaming.upsert_kpi import MONTH, read_trip_store, recompute_days, stream_upsert_kpi, with_month


def _ticket(day: dt.datetime, amount: str):
    return (1, day, "A", Decimal(amount), "Bar", "H1")


def test_watermark_drops_late_rows(spark):
    src = scratch_path(spark, "wm-src")
    batches = [
        [_ticket(dt.datetime(2024, 3, 1, 8), "1.00"), _ticket(dt.datetime(2024, 3, 1, 9), "2.00")],
        [_ticket(dt.datetime(2024, 3, 20, 8), "4.00")],
        # lateness is judged against the previous batch's watermark: this batch
        # moves the watermark past March 1 and evicts that day's state
        [_ticket(dt.datetime(2024, 3, 21, 8), "0.50")],
        # 20 days late against a 10-day watermark (dropped), and 3 days late (kept)
        [_ticket(dt.datetime(2024, 3, 1, 10), "8.00"), _ticket(dt.datetime(2024, 3, 18, 10), "16.00")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, TICKET).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # distinct file times: the file source reads oldest first
    run = stream_daily_revenue(spark, src, scratch_path(spark, "wm-out"), scratch_path(spark, "wm-ckpt"),
                               watermark="10 days", files_per_trigger=1)
    got = {r.validation_date: r.revenue for r in run.table.collect()}
    assert sum(n for _, n in run.dropped) > 0
    late = stream_daily_revenue(spark, src, scratch_path(spark, "wm-out"), scratch_path(spark, "wm-ckpt"), watermark="90 days")
    assert sum(n for _, n in late.dropped) == 0 and late.table.agg(F.sum("revenue")).first()[0] == Decimal("31.50")
    assert got == {dt.date(2024, 3, 1): Decimal("3.00"), dt.date(2024, 3, 20): Decimal("4.00"),
                   dt.date(2024, 3, 21): Decimal("0.50"), dt.date(2024, 3, 18): Decimal("16.00")}


def test_every_batch_is_counted_however_many(spark):
    src = scratch_path(spark, "ev-src")
    for day in (1, 20, 21, 2, 3, 22):  # the two of March 2 and 3 are late
        spark.createDataFrame([_ticket(dt.datetime(2024, 3, day, 8), "1.00")], TICKET).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # distinct file times: the file source reads oldest first
    key = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(key, "2")
    try:
        run = stream_daily_revenue(spark, src, scratch_path(spark, "ev-out"), scratch_path(spark, "ev-ckpt"),
                                   watermark="10 days", files_per_trigger=1)
    finally:
        spark.conf.unset(key)
    ids = [b for b, _ in run.dropped]
    assert ids == list(range(len(ids))) and len(ids) >= 6
    assert sum(n for _, n in run.dropped) == 2 and run.table.count() == 4


def test_restart_is_idempotent(spark):
    src = scratch_path(spark, "re-src")
    spark.createDataFrame([_ticket(dt.datetime(2024, 1, 5, 1), "1.50")], TICKET).write.parquet(src)
    out_dir, ckpt = scratch_path(spark, "re-out"), scratch_path(spark, "re-ckpt")
    first = stream_daily_revenue(spark, src, out_dir, ckpt, watermark="1 day").table
    again = stream_daily_revenue(spark, src, out_dir, ckpt, watermark="1 day").table
    assert first.collect() == again.collect()
    assert again.agg(F.sum("revenue")).first()[0] == Decimal("1.50")


def test_fresh_checkpoint_adds_to_the_table(spark):
    src, out_dir = scratch_path(spark, "fc-src"), scratch_path(spark, "fc-out")
    for i in range(1, 5):
        spark.createDataFrame([_ticket(dt.datetime(2024, 1, i, 1), "1.00")], TICKET).write.mode("append").parquet(src)
    stream_daily_revenue(spark, src, out_dir, scratch_path(spark, "fc-1"), watermark="99 days", files_per_trigger=1)
    fresh = scratch_path(spark, "fc-src2")
    spark.createDataFrame([_ticket(dt.datetime(2024, 1, 9, 1), "7.00")], TICKET).write.parquet(fresh)
    got = stream_daily_revenue(spark, fresh, out_dir, scratch_path(spark, "fc-2"), watermark="99 days").table
    assert {r.validation_date.day: r.revenue for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 7}


@pytest.mark.parametrize("order", [(1, 20, 21, 2, 3), (21, 3, 20, 2, 1), (3, 2, 1, 20, 21)])
def test_table_and_late_rows_are_all_tickets_in_any_order(spark, order):
    src, out = scratch_path(spark, "lt-src"), scratch_path(spark, "lt-out")
    for day in order:
        rows = [_ticket(dt.datetime(2024, 3, day, 8), f"{day}.25"), _ticket(dt.datetime(2024, 3, day, 9), "1.00")]
        spark.createDataFrame(rows, TICKET).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    run = stream_daily_revenue(spark, src, out, scratch_path(spark, "lt-ck"), watermark="5 days", files_per_trigger=1)
    every = {dt.date(2024, 3, d): Decimal(f"{d}.25") + 1 for d in order}
    late = {}
    for r in run.late.collect():
        late[r.validated_at.date()] = late.get(r.validated_at.date(), 0) + r.amount_eur
        assert order[r.batch_id] == r.validated_at.day
    got = {r.validation_date: r.revenue for r in run.table.collect()}
    assert not set(got) & set(late) and got | late == every
    assert {d.day for d in late} == {(1, 20, 21, 2, 3): {2, 3}, (21, 3, 20, 2, 1): {3, 2, 1}, (3, 2, 1, 20, 21): set()}[order]
    assert {r.validation_date: r.revenue for r in merge_late(spark, out).collect()} == every
    assert {r.validation_date: r.revenue for r in merge_late(spark, out).collect()} == every  # nothing left to merge


def test_a_batch_stopped_before_its_commit_and_files_read_again_count_once(spark, monkeypatch):
    src, out, ck = (scratch_path(spark, n) for n in ("st-src", "st-out", "st-ck"))
    spark.createDataFrame([_ticket(dt.datetime(2024, 3, 1, 8), "2.00")], TICKET).write.parquet(src)
    with monkeypatch.context() as m:
        m.setattr(Manifest, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(Exception, match="stopped"):
            stream_daily_revenue(spark, src, out, ck, watermark="1 day")
    for checkpoint in (ck, ck, scratch_path(spark, "st-fresh")):
        run = stream_daily_revenue(spark, src, out, checkpoint, watermark="1 day")
        assert [r.revenue for r in run.table.collect()] == [Decimal("2.00")] and run.late.count() == 0


def test_a_ticket_without_a_time_fails(spark):
    src = scratch_path(spark, "nt-src")
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in TICKET.fields])
    spark.createDataFrame([_ticket(None, "1.00")], nullable).write.parquet(src)
    with pytest.raises(Exception, match="without a validation time"):
        stream_daily_revenue(spark, src, scratch_path(spark, "nt-out"), scratch_path(spark, "nt-ck"), watermark="1 day")


# --- daily KPI stream


def _trips(spark, rows):
    cols = {"line": "'1'", "direction": "'Hin'", "bus_id": "1L", "vehicle_no": "'v'", "driver_id": "'d'", "start_sec": "1", "delay_min": "0",
            "km": "cast(10 as decimal(12,2))", "boardings": "3", "occupancy_pct": "cast(50 as decimal(5,2))",
            "energy_kwh": "cast(1 as decimal(8,2))", "status": "'planmäßig'"}
    df = spark.createDataFrame(rows, "trip_id long, service_date date")
    return with_month(df.selectExpr("*", *[f"{v} as {c}" for c, v in cols.items()]).select(*TRIP.fieldNames()))


def _kpi_stores(spark):
    return {n: scratch_path(spark, n) for n in ("k-trips", "k-tickets", "k-out", "k-ck")}


def _add(spark, d, trips=(), tickets=()):
    if trips:
        _trips(spark, list(trips)).write.mode("append").partitionBy(MONTH).parquet(d["k-trips"])
    if tickets:
        rows = [(t, dt.datetime(2024, 1, 1), "A", Decimal(a), "Bar", "H") for t, a in tickets]
        spark.createDataFrame(rows, TICKET).write.mode("append").parquet(d["k-tickets"])


def _drain(spark, d, ck="k-ck"):
    got = stream_upsert_kpi(spark, d["k-trips"], d["k-tickets"], d["k-out"], d[ck])
    return {str(r.service_date): (r.total_km, r.total_revenue) for r in got.collect()}


def test_late_trips_and_late_tickets_refresh_their_day(spark):
    d, day = _kpi_stores(spark), dt.date
    _add(spark, d, [(1, day(2024, 1, 5)), (2, day(2024, 6, 5))], [(1, "2.00")])
    assert _drain(spark, d) == {"2024-01-05": (10, 2), "2024-06-05": (10, 0)}
    _add(spark, d, tickets=[(2, "4.00"), (77, "1.00")])                  # a late ticket, and one of an unknown trip
    assert _drain(spark, d) == {"2024-01-05": (10, 2), "2024-06-05": (10, 4)}
    _add(spark, d, trips=[(3, day(2024, 1, 5)), (77, day(2024, 7, 1))])  # a late trip, and the unknown one
    want = {"2024-01-05": (20, 2), "2024-06-05": (10, 4), "2024-07-01": (10, 1)}
    assert _drain(spark, d) == want
    assert _drain(spark, d) == want                                      # nothing new
    d["fresh"] = scratch_path(spark, "k-fresh")
    assert _drain(spark, d, "fresh") == want                             # all files again


def test_a_stop_before_the_commit_loses_no_month(spark, monkeypatch):
    d, day = _kpi_stores(spark), dt.date
    _add(spark, d, [(1, day(2024, 1, 5)), (2, day(2024, 1, 9)), (3, day(2024, 6, 5))], [(1, "2.00")])
    want = {"2024-01-05": (10, 2), "2024-01-09": (10, 0), "2024-06-05": (10, 0)}
    assert _drain(spark, d) == want
    _add(spark, d, trips=[(4, day(2024, 1, 5))])
    with monkeypatch.context() as m:
        m.setattr(Manifest, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(Exception, match="stopped"):
            _drain(spark, d)
    table = Manifest(spark, d["k-out"]).read("table")
    assert {str(r.service_date): (r.total_km, r.total_revenue) for r in table.collect()} == want
    assert _drain(spark, d) == want | {"2024-01-05": (20, 2)}


def test_a_trip_without_a_date_fails(spark):
    d = _kpi_stores(spark)
    _add(spark, d, [(1, dt.date(2024, 1, 5)), (2, None)], [(1, "2.00")])
    with pytest.raises(Exception, match="without a service date"):
        _drain(spark, d)


def test_a_batch_reads_only_the_months_it_touches(spark):
    d, day = _kpi_stores(spark), dt.date
    _add(spark, d, [(m, day(2024, m, 1)) for m in range(1, 13)], [(1, "2.00")])
    trips = read_trip_store(spark, d["k-trips"])
    days = with_month(spark.createDataFrame([(day(2024, 1, 1),), (day(2024, 12, 1),)], "service_date date"))
    got = recompute_days(trips, spark.read.schema(TICKET).parquet(d["k-tickets"]), days)
    assert sorted(str(r.service_date) for r in got.collect()) == ["2024-01-01", "2024-12-01"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [service_month" in plan


def test_late_rows_query_writes_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Three files, whatever the input, left a third of all tickets to one task;
    half of these tickets are of one trip."""
    from fleetlens.plans import load_queries
    rows = [(i if i % 2 else 7, 1, 1, i % 7, 1.0, float(i % 100) / 4, 0.0, 0.0, "N", "O", dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 50)) for i in range(3000)]
    spark.createDataFrame(rows, INPUT_SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, real = [], load_queries.stream_daily_revenue

    def watched(session, src, *args, **how):
        seen.append([r["count"] for r in session.read.parquet(src).groupBy(F.input_file_name()).count().collect()])
        run = real(session, src, *args, **how)
        seen.append([n for _, n in run.dropped])
        return run

    monkeypatch.setattr(load_queries, "_TICKETS_A_FILE", 200, raising=False)
    monkeypatch.setattr(load_queries, "stream_daily_revenue", watched)
    got = {r["validation_date"]: r["revenue"] for r in load_queries.q_stream_late_rows(spark, str(tmp_path)).collect()}
    want = {}
    for r in rows:
        want[r[-1].date()] = want.get(r[-1].date(), 0) + Decimal(r[5])
    assert got == want
    files, late = seen
    assert sum(files) == 3000 and len(files) == 15 and max(files) < 500
    assert len(late) == 3 and late[0] == 0 and min(late[1:]) > 0


# --- orphans


def _put(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _sold(trip, day, amount="1.00"):
    return (trip, dt.datetime(2024, 3, day, 8), "A", Decimal(amount), "Bar", "H1")


def _trip(trip, day):
    return (trip, dt.date(2024, 3, day), "1", *[None] * (len(TRIP.fields) - 3))


def test_tickets_wait_for_their_trip_then_become_orphans(spark):
    d = [scratch_path(spark, n) for n in ("or-tickets", "or-trips", "or-out", "or-ck")]
    tickets, trips = d[:2]

    def drain():
        return sorted(r.trip_id for r in stream_orphans(spark, *d, wait="3 days", after="5 days").table.collect())

    _put(spark, tickets, TICKET, [_sold(1, 2), _sold(2, 2), _sold(3, 2), _sold(None, 2)])
    _put(spark, trips, TRIP, [_trip(1, 1)])
    assert drain() == []                                   # 2 and 3 wait
    _put(spark, trips, TRIP, [_trip(2, 2)])                # a ticket before its trip, after a restart
    _put(spark, tickets, TICKET, [_sold(4, 3)])
    assert drain() == []
    _put(spark, trips, TRIP, [_trip(9, 20)])
    _put(spark, tickets, TICKET, [_sold(9, 20)])
    assert drain() == [3, 4]                               # both streams are past March 17
    assert drain() == [3, 4]
    _put(spark, trips, TRIP, [_trip(3, 2)])                # after the time is over: it stays an orphan
    assert drain() == [3, 4]
    _put(spark, tickets, TICKET, [_sold(9, 21), _sold(8, 21), _sold(9, 28)])  # trip 9 is too long ago for the last one
    heartbeat(spark, tickets, trips, dt.datetime(2024, 6, 1))
    assert drain() == [3, 4, 8, 9]


def test_orphans_of_a_replayed_batch_are_kept_once(spark, monkeypatch):
    d = [scratch_path(spark, n) for n in ("rp-tickets", "rp-trips", "rp-out", "rp-ck")]
    _put(spark, d[0], TICKET, [_sold(1, 2), _sold(2, 2)])
    _put(spark, d[1], TRIP, [_trip(1, 1)])
    heartbeat(spark, d[0], d[1], dt.datetime(2024, 6, 1))
    plain, calls = Manifest.put, []

    def commits_then_stops(self, version):
        plain(self, version)
        calls.append(version.number)
        raise RuntimeError("stopped after the commit")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "put", commits_then_stops)
        with pytest.raises(Exception, match="stopped after the commit"):
            stream_orphans(spark, *d, wait="3 days", after="5 days")
    assert [r.trip_id for r in stream_orphans(spark, *d, wait="3 days", after="5 days").table.collect()] == [2] and len(calls) == 1
