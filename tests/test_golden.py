"""Golden values on two small export files (six trips, five tickets)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates as agg
from fleetlens.operators import classify as cls
from fleetlens.operators import topk, windows
from fleetlens.sources.files import read_tickets_csv, read_trips_csv
from tests.fixtures import TICKET_CSV, TRIP_CSV, write

DAY = dt.date(2025, 11, 3)


@pytest.fixture(scope="module")
def trips(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("golden")
    return read_trips_csv(spark, write(d, "trips.csv", TRIP_CSV)).cache()


@pytest.fixture(scope="module")
def tickets(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("golden_t")
    return read_tickets_csv(spark, write(d, "tickets.csv", TICKET_CSV)).cache()


def test_csv_ingest_types(trips, tickets):
    assert trips.count() == 6
    row = trips.where("trip_id = 11").first()
    assert row.service_date == DAY and row.line == "040"
    assert row.start_sec == 6 * 3600 and row.planned_end_sec == 6 * 3600 + 29 * 60
    assert row.km == Decimal("10.50") and row.productive is True and row.trip_type == 1
    assert trips.where("trip_id = 13").select("productive", "trip_type").first() == (False, 2)
    t = tickets.orderBy("validated_at").first()
    assert t.trip_id == 11 and t.validated_at == dt.datetime(2025, 11, 3, 6, 10)


def test_overview_kpi(trips):
    r = agg.overview_kpi(trips).first()
    assert r.trips == 6 and r.boardings == 117
    assert r.avg_occupancy == 35.2          # 211 / 6
    assert r.avg_delay_min == 4.0           # 24 / 6
    assert r.energy_kwh == Decimal("158")
    assert r.on_time_pct == 66.7            # 4 of 6, five minutes included


def test_report_kpi(trips):
    r = agg.report_kpi(trips).first()
    assert (r.trips, r.boardings, r.avg_occupancy, r.avg_delay_min) == (6, 117, 35.2, 4.0)
    assert r.total_km == Decimal("82") and r.on_time_pct == 66.7   # 81.5 km, half away from zero


def test_daily_kpi(trips, tickets):
    r = agg.daily_kpi(trips, tickets).collect()
    assert len(r) == 1
    r = r[0]
    assert r.service_date == DAY
    assert r.total_km == Decimal("81.50") and r.total_boardings == 117
    assert r.total_revenue == Decimal("14.50")   # without the unknown trip's ticket
    assert (r.avg_occupancy, r.avg_delay_min, r.on_time_pct) == (35.17, 4.0, 66.67)


def test_daily_kpi_active_rules(trips):
    r = agg.daily_kpi_active(trips).first()
    assert r.avg_delay_min == 4.5      # early trips count as 0
    assert r.on_time_pct == 50.0       # strictly below 5 minutes
    assert r.active_trips == 6 and r.total_km == Decimal("81.50")


def test_ticket_kpi(tickets):
    r = agg.ticket_kpi(tickets).first()
    assert (r.validations, r.revenue, r.avg_ticket) == (5, Decimal("17.70"), 3.54)


def test_counts_and_shares(trips, tickets):
    status = {r.status: r.trip_count for r in
              windows.share(agg.counts_by(trips, "status", "trip_count"), "trip_count").collect()}
    assert status == {"planmäßig": 2, "verspätet": 4}
    fares = {r.fare_type: (r.ticket_count, r.revenue) for r in agg.fare_summary(tickets).collect()}
    assert fares == {"Einzel": (3, Decimal("9.60")), "Tages": (1, Decimal("8.10")), "Abo": (1, Decimal("0.00"))}
    pay = {r.payment_method: (r.n, r.share_pct) for r in
           windows.share(agg.counts_by(tickets, "payment_method", "n"), "n").collect()}
    assert pay == {"Bar": (2, 40.0), "Handy": (1, 20.0), "Karte": (1, 20.0), "eTicket": (1, 20.0)}
    stops = [(r.stop, r.boardings) for r in topk.top_counts(tickets, "stop", 10, "boardings").collect()]
    assert stops == [("Hafen", 2), ("Markt", 2), ("Bahnhof", 1)]


def test_line_report(trips):
    got = {r.line: (r.trips, r.avg_delay_min, r.on_time_pct) for r in agg.line_report(trips).collect()}
    assert got == {"040": (2, 4.5, 50.0), "7": (2, 4.5, 100.0), "88": (2, 3.0, 50.0)}


def test_newest_trips(trips):
    top = trips.orderBy(F.col("service_date").desc(), F.col("start_sec").desc()).limit(3)
    assert [r.trip_id for r in top.collect()] == [16, 15, 14]
    shown = topk.top_recent(trips, 3).collect()
    assert [r["Fahrer"] for r in shown] == ["D5", "D4", "D3"]


def test_status_against_the_delay(trips):
    st = {r.trip_id: (r.derived_status, r.status_matches) for r in cls.derive_status(trips).collect()}
    assert st[14] == ("planmäßig", False)   # delay 4 but stored as late
    assert st[13] == ("verspätet", True)    # delay 5 is late by the status rule


def test_revenue_per_trip(trips, tickets):
    from fleetlens.operators.joins import with_revenue
    rev = {r.trip_id: r.revenue for r in with_revenue(trips, tickets).collect()}
    assert rev[11] == Decimal("11.30") and rev[14] == Decimal("0.00") and sum(rev.values()) == Decimal("14.50")
