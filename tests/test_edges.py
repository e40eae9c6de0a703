"""Edge inputs: empty frames, NULL delays, cancelled-only days, single-day
trends, ties, midnight wrap, malformed strings, rounding, partial failures."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetlens.functions.measures import exact_avg, rounded_ratio
from fleetlens.functions.scalars import lenient_cast, lenient_time_seconds, py_strip
from fleetlens.operators import aggregates as agg
from fleetlens.operators import classify as cls
from fleetlens.operators import quality as dq
from fleetlens.operators import report as rpt
from fleetlens.operators import tables as tbl
from fleetlens.operators import text as txt
from fleetlens.operators import topk, windows
from fleetlens.schemas import DAILY_KPI, TICKET, TRIP
from fleetlens.session import scratch_path
from fleetlens.sources.bindings import FleetTables

D1 = dt.date(2024, 3, 4)  # a Monday


def trip_rows(spark, rows):
    """rows: (trip_id, service_date, line, start_sec, delay_min, occupancy, status)."""
    full = [(i, d, ln, "Hin", 1, "B-1", "F1", s, dl, Decimal("10.00"), 5,
             None if o is None else Decimal(str(o)), Decimal("1.00"), st)
            for i, d, ln, s, dl, o, st in rows]
    return spark.createDataFrame(full, TRIP)


def test_empty_input(spark):
    empty = spark.createDataFrame([], TRIP)
    o = agg.overview_kpi(empty).first()
    assert o.trips == 0 and o.avg_occupancy is None and o.on_time_pct is None and o.boardings is None
    r = agg.report_kpi_nullsafe(empty).first()
    assert (r.trips, r.boardings, r.avg_occupancy, r.avg_delay_min, r.total_km, r.on_time_pct) == \
        (0, 0, 0.0, 0.0, Decimal(0), 0.0)
    w = cls.warn_flags(agg.report_kpi_nullsafe(empty)).first()
    assert w.on_time_warn is True and w.delay_warn is False   # NULL punctuality becomes 0 -> warning
    cards = {(c.card_set, c.position): (c.value_text, c.warn)
             for c in rpt.kpi_cards(agg.overview_kpi(empty), agg.report_kpi_nullsafe(empty)).collect()}
    assert cards[("dashboard", 2)] == ("None%", False)
    assert cards[("dashboard", 6)] == ("None%", True)       # no punctuality -> 'kritisch'
    assert cards[("report", 6)] == ("0.0%", True)
    assert agg.total_km(empty).first().total_km == Decimal("0.00")
    text = rpt.problem_lines_text(topk.problem_lines(empty, D1)).first().problem_lines_text
    assert text == "Alle Linien im grünen Bereich."
    assert agg.daily_kpi(empty, spark.createDataFrame([], TICKET)).count() == 0


def test_null_delay_rules(spark):
    t = trip_rows(spark, [(1, D1, "1", 100, None, 50, "planmäßig"),
                          (2, D1, "1", 200, 10, 50, "verspätet"),
                          (3, D1, "1", 300, 3, 50, "planmäßig")])
    o = agg.overview_kpi(t).first()
    assert o.on_time_pct == 66.7 and o.avg_delay_min == 6.5          # NULL on time, NULL skipped
    lp = agg.line_punctuality(t).first()
    assert lp.on_time_pct == 33.3 and lp.avg_delay_min == 6.5        # NULL late
    lr = agg.line_report(t).first()
    assert lr.avg_delay_min == 4.3 and lr.on_time_pct == 66.7        # NULL as 0
    st = {r.trip_id: r.derived_status for r in cls.derive_status(t).collect()}
    assert st[1] is None


def test_cancelled_only_day(spark):
    t = trip_rows(spark, [(1, D1, "1", 100, 3, 50, "ausgefallen"),
                          (2, D1, "1", 200, 7, 50, "ausgefallen"),
                          (3, D1 + dt.timedelta(days=1), "1", 100, -3, 40, "planmäßig")])
    got = {r.service_date: r for r in agg.daily_kpi_active(t).collect()}
    z = got[D1]
    assert (z.total_km, z.total_boardings, z.avg_occupancy, z.avg_delay_min, z.on_time_pct, z.active_trips) == \
        (Decimal("0.00"), 0, 0.0, 0.0, 0.0, 0)
    n = got[D1 + dt.timedelta(days=1)]
    assert n.avg_delay_min == 0.0 and n.on_time_pct == 100.0


def test_half_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("2.25"),), (Decimal("-2.25"),)], "x decimal(5,2)")
    got = sorted(r.v for r in df.select(F.round(F.col("x"), 1).cast("double").alias("v")).collect())
    assert got == [-2.3, 2.3]
    two = spark.createDataFrame([(Decimal("1.00"),), (Decimal("1.05"),)], "x decimal(5,2)")
    assert two.agg(exact_avg("x", 2).alias("a")).first().a == 1.03      # 1.025 -> 1.03
    neg = spark.createDataFrame([(-1,), (-2,)], "x int")
    assert neg.agg(rounded_ratio(F.sum("x"), F.count("x"), 0).alias("a")).first().a == -2.0


def test_single_day_trend_and_lights(spark):
    daily = spark.createDataFrame([(D1, Decimal("1.00"), 10, Decimal("5.00"), 70.0, 1.0, 96.0)], DAILY_KPI)
    tr = windows.trend(daily).first()
    assert tr.on_time_pct_delta == 0.0 and tr.total_revenue_delta == Decimal("0.00")
    lit = cls.traffic_light(windows.trend(daily)).first()
    assert (lit.punctuality_light, lit.occupancy_light, lit.revenue_trend) == ("green", "green", "flat")
    two = spark.createDataFrame([(D1, Decimal("1.00"), 10, Decimal("5.00"), 81.0, 1.0, 94.5),
                                 (D1 + dt.timedelta(days=3), Decimal("1.00"), 8, Decimal("7.50"), 59.9, 1.0, 80.0)],
                                DAILY_KPI)
    latest = cls.traffic_light(windows.trend(two, latest_only=True)).collect()
    assert len(latest) == 1
    r = latest[0]
    assert r.total_revenue_delta == Decimal("2.50") and r.total_boardings_delta == -2
    assert (r.punctuality_light, r.occupancy_light, r.revenue_trend, r.boardings_trend) == \
        ("red", "yellow", "up", "down")
    first = cls.traffic_light(windows.trend(two)).orderBy("service_date").first()
    assert first.punctuality_light == "yellow"     # 94.5 falls in the 85..95 band


def test_ties_and_null_order(spark):
    t = trip_rows(spark, [(1, D1, "1", 500, 1, 10, "planmäßig"),
                          (2, D1, "1", 500, 1, 10, "planmäßig"),
                          (3, D1, "1", None, 1, 10, "planmäßig"),
                          (4, D1 - dt.timedelta(days=1), "1", 900, 1, 10, "planmäßig")])
    top = topk.top_recent(t, 3, (("trip_id", "id"),)).collect()
    assert [r.id for r in top] == [3, 2, 1]          # NULL start first in DESC, then trip_id DESC
    pl = trip_rows(spark, [(1, D1, "A", 1, None, 10, "x"), (2, D1, "B", 1, 9, 10, "x"),
                           (3, D1, "C", 1, 9, 10, "x"), (4, D1, "D", 1, 1, 10, "x")])
    assert [r.line for r in topk.problem_lines(pl, D1, 7, 3).collect()] == ["A", "B", "C"]



def test_strict_date_fails(spark, tmp_path):
    from fleetlens.sources.files import read_trips_csv
    p = tmp_path / "bad.csv"
    p.write_text("trip_id,service_date,start_time\n1,2026-13-45,xx:00:00\n", encoding="utf-8")
    df = read_trips_csv(spark, str(p))
    with pytest.raises(Exception):
        df.collect()


def test_python_strip_parity(spark):
    import fleetlens.functions.scalars as sc
    samples = ["  a b \t", " x　", "\n\n", "x", "  y \u0085"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r.v for r in df.select(py_strip("s").alias("v")).collect()] == [s.strip() for s in samples]
    assert " " in sc.PY_WHITESPACE and " " in sc.PY_WHITESPACE


def test_markdown_rules(spark):
    texts = spark.createDataFrame([(1, "## T\n\n**bold** text\n\n  \n\n**\n\n#x#")], "id int, text string")
    got = [r.paragraph for r in txt.markdown_paragraphs(texts, ["id"]).orderBy("paragraph_no").collect()]
    assert got == [" T", "bold text", "", "x"]
    lines = txt.text_lines_stats(spark.createDataFrame([(1, " a \n\n b")], "id int, text string"), ["id"])
    rows = lines.orderBy("line_no").collect()
    assert [(r.line, r.is_blank, r.raw_chars) for r in rows] == [("a", False, 7), ("", True, 7), ("b", False, 7)]


def test_period_validation(spark):
    df = spark.createDataFrame([("weekly",), ("Weekly",), (None,), ("monthlyx",)], "p string")
    assert [r.is_valid for r in dq.valid_period(df, "p").collect()] == [True, False, False, False]
    with pytest.raises(ValueError):
        dq.check_period("yearly")


def test_week_period_starts_monday(spark):
    t = trip_rows(spark, [(1, D1 + dt.timedelta(days=i), "1", 1, 1, 10, "x") for i in range(8)])
    weeks = {r.period_start: r.trips for r in rpt.period_report(t, "week").collect()}
    assert weeks == {D1: 7, D1 + dt.timedelta(days=7): 1}
    assert rpt.period_report(t, "day", start=D1, end=D1 + dt.timedelta(days=2)).count() == 2


def test_kpi_suite_partial_failure(spark):
    t = trip_rows(spark, [(1, D1, "1", 1, 1, 50, "x")])

    def missing():
        return spark.read.parquet("/nonexistent/fleetlens/bus.parquet")

    maint = spark.createDataFrame([], "maintenance_id bigint, bus_id bigint, service_date date, kind string,"
                                      " status string, next_due date")
    rows = {r.metric: (r.value, r.error) for r in agg.kpi_suite(missing, lambda: maint, lambda: t, D1).collect()}
    assert rows["total_buses"][0] is None and rows["total_buses"][1]
    assert rows["overdue_maintenance"] == (Decimal("0.00"), None)
    assert rows["avg_occupancy"] == (Decimal("50.00"), None)


def test_surrogate_keys_sequential(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"))
    out = topk.with_surrogate_key(df, "sid", ["k", "v"], partitions=5)
    rows = out.orderBy("sid").collect()
    assert [r.sid for r in rows] == list(range(1, 1001))
    assert [(r.k, r.v) for r in rows] == sorted((r.k, r.v) for r in rows)
    more = topk.with_surrogate_key(df.limit(5), "sid", ["k", "v"], partitions=2, after=1000)
    assert sorted(r.sid for r in more.collect()) == list(range(1001, 1006))



def test_upsert_and_swap(spark):
    a = spark.createDataFrame([(D1, 1), (D1 + dt.timedelta(days=1), 2)], "d date, v int")
    b = spark.createDataFrame([(D1 + dt.timedelta(days=1), 20), (D1 + dt.timedelta(days=2), 30)], "d date, v int")
    got = sorted((r.d, r.v) for r in tbl.upsert(a, b, ["d"]).collect())
    assert got == [(D1, 1), (D1 + dt.timedelta(days=1), 20), (D1 + dt.timedelta(days=2), 30)]
    path = scratch_path(spark, "swap-test")
    tbl.overwrite(a, path)
    tbl.overwrite(b, path)
    assert sorted(r.v for r in tbl.read_stored(spark, path).collect()) == [20, 30]


def test_cascade_delete(spark):
    parents = spark.createDataFrame([(1, "ausgefallen"), (2, "ok"), (3, None)], "trip_id bigint, status string")
    kids = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,)], "trip_id bigint")
    keep_p, keep_c = tbl.cascade_delete(parents, kids, F.col("status") == "ausgefallen", "trip_id")
    assert sorted(r.trip_id for r in keep_p.collect()) == [2, 3]
    assert sorted((r.trip_id for r in keep_c.collect()), key=lambda x: (x is None, x)) == [2, 9, None]


def test_add_columns_keeps_existing(spark):
    df = spark.createDataFrame([(1, False)], "trip_id bigint, productive boolean")
    out = tbl.add_columns_if_missing(df)
    r = out.first()
    assert r.productive is False and r.trip_label is None and "end_stop_no" in out.columns


def test_union_depots_missing_columns(spark):
    from fleetlens.sources.depots import union_depots
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    got = sorted((r.x, r.y, r.depot) for r in union_depots({"a": a, "b": b}).collect())
    assert got == [(1, 2, "a"), (3, None, "b")]


def test_schema_has_no_nulls_where_declared():
    assert not TRIP["trip_id"].nullable and not TRIP["service_date"].nullable


def test_missing_table_raises_analysis(spark):
    with pytest.raises(AnalysisException):
        spark.read.parquet("/nonexistent/fleetlens/x.parquet")


def test_lenient_time_field_widths(spark):
    df = spark.createDataFrame([("7:05:00",), ("07:5:9",), ("23:59:59",), ("24:00:00",), ("12:60:00",),
                                ("12:00:60",), (" 07:00:00",), ("070000",)], "t string")
    got = [r.s for r in df.select(lenient_time_seconds("t").alias("s")).collect()]
    assert got == [7 * 3600 + 300, 7 * 3600 + 5 * 60 + 9, 86399, None, None, None, None, None]


def test_plate_lookup_null_and_unmatched(spark):
    from fleetlens.operators.joins import with_plate
    trips = spark.createDataFrame([(1, None), (2, 7), (3, 8), (4, None)], "trip_id bigint, bus_id bigint")
    buses = spark.createDataFrame([(7, "K-7"), (-100, "NEG")], "bus_id bigint, plate string")
    got = {r.trip_id: r.plate for r in with_plate(trips, buses).collect()}
    assert got == {1: "Unbekannt", 2: "K-7", 3: "Unbekannt", 4: "Unbekannt"}



def test_jdbc_partitioned_read_needs_bounds(spark):
    # argument check only: a partitioned read is split on key ranges, so the
    # bounds must be given (no database is started by the tests)
    from fleetlens.sources.jdbc import read_jdbc

    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none", "trip", key="trip_id")


def test_full_refresh_replaces_and_old_readers_keep_theirs(spark):
    from fleetlens.session import scratch_path

    path = scratch_path(spark, "refresh-swap")
    tbl.overwrite(spark.range(5), path)
    old = tbl.read_stored(spark, path)
    tbl.overwrite(spark.range(3), path)
    assert sorted(r.id for r in tbl.read_stored(spark, path).collect()) == [0, 1, 2] and old.count() == 5


def test_one_pass_cards_equal_two_block_cards(spark):
    """Cards from one aggregate row equal cards from the two separate KPI
    blocks, on real trips and on an empty table (NULL-safe report tiles)."""
    t = FleetTables(spark, "/root/testdata/sf0.001").trip
    for trips in (t, spark.createDataFrame([], TRIP)):
        one = rpt.kpi_cards_from_trips(trips)
        two = rpt.kpi_cards(agg.overview_kpi(trips), agg.report_kpi_nullsafe(trips))
        assert one.columns == two.columns
        assert [f.dataType for f in one.schema.fields] == [f.dataType for f in two.schema.fields]
        assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
        assert one.count() == 12


# --- CSV fields by header name


def csv(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_csv_fields_follow_the_header(spark, tmp_path):
    from fleetlens.sources.files import read_tickets_csv
    path = csv(tmp_path, "t.csv", "trip_id,validated_at,payment_method,amount_eur,remark\n1,2024-01-01 08:00:00,Bar,2.90,x\n")
    r = read_tickets_csv(spark, path).first()
    assert (r.amount_eur, r.payment_method, r.fare_type, r.stop) == (Decimal("2.90"), "Bar", None, None)


def test_csv_without_optional_fields_and_with_other_names(spark, tmp_path):
    from fleetlens.sources.files import read_trips_csv
    a = csv(tmp_path, "a.csv", "trip_type,trip_id,service_date\n0,1,2024-01-01\n")
    b = csv(tmp_path, "b.csv", "Tag,Nummer,productive\n2024-01-02,2,false\n")
    got = {r.trip_id: (r.productive, r.trip_type, r.energy_kwh, str(r.service_date))
           for r in read_trips_csv(spark, [a, b], {"Tag": "service_date", "Nummer": "trip_id"}).collect()}
    assert got == {1: (True, 0, None, "2024-01-01"), 2: (False, 1, None, "2024-01-02")}


def test_csv_header_errors(spark, tmp_path):
    from fleetlens.sources.files import read_tickets_csv, read_trips_csv
    with pytest.raises(ValueError, match="service_date"):
        read_trips_csv(spark, csv(tmp_path, "m.csv", "trip_id,line\n1,2\n"))
    folder = tmp_path / "mixed"
    folder.mkdir()
    csv(folder, "1.csv", "trip_id,validated_at,amount_eur\n1,2024-01-01 08:00:00,1.00\n")
    csv(folder, "2.csv", "trip_id,amount_eur,validated_at\n1,1.00,2024-01-01 08:00:00\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_tickets_csv(spark, str(folder)).collect()


def test_lenient_whole_numbers(spark):
    df = spark.createDataFrame([("1.0",), ("7",), ("1.5",), ("x",), (None,), ("1e2",), ("9223372036854775808",)], "v string")
    assert [r.n for r in df.select(lenient_cast(F.col("v"), "bigint").alias("n")).collect()] == [1, 7, None, None, None, 100, None]


# --- upsert, NULL keys, reports, import


def test_upsert_rejects_repeated_incoming_keys(spark):
    old, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1)], [(1, 2), (1, 3)]))
    with pytest.raises(ValueError, match="repeat"):
        tbl.upsert(old, new, ["k"])


def test_upsert_and_cascade_keep_null_keys(spark):
    old = spark.createDataFrame([(1, 1), (None, 5), (None, 6)], "k int, v int")
    got = tbl.upsert(old, spark.createDataFrame([(1, 9), (2, 9)], "k int, v int"), ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 9), (2, 9), (None, 5), (None, 6)], key=str)
    parents = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    _, kids = tbl.cascade_delete(parents, old, F.col("s") == "x", "k")
    assert sorted(r.v for r in kids.collect()) == [5, 6]


def test_upsert_table_replaces_touched_partitions_only(spark):
    from fleetlens.session import scratch_path
    path = scratch_path(spark, "upsert-table")
    schema = "day int, v int, part string"
    tbl.upsert_table(spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "b")], schema), path, ["day"], "part")

    def files(part):
        return {r.f for r in tbl.read_stored(spark, path).where(F.col("part") == part).select(F.input_file_name().alias("f")).collect()}

    before = files("b")
    change = spark.createDataFrame([(2, 20, "a"), (9, 90, "c")], schema)
    for _ in range(2):  # a repeated call changes nothing
        tbl.upsert_table(change, path, ["day"], "part")
        assert sorted((r.day, r.v, r.part) for r in tbl.read_stored(spark, path).collect()) == [
            (1, 1, "a"), (2, 20, "a"), (3, 3, "b"), (9, 90, "c")]
    assert files("b") == before
    with pytest.raises(ValueError):
        tbl.upsert_table(spark.createDataFrame([(5, 1, "a"), (5, 2, "a")], schema), path, ["day"], "part")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_report_formats_and_local_stamp(spark, fmt):
    from fleetlens.session import scratch_path
    frames = {"one": spark.createDataFrame([(1, "a,b"), (2, "c")], "n int, t string"), "none": spark.createDataFrame([], "n int")}
    got = {r.dataset: (r.row_count, r.path) for r in
           tbl.write_report(frames, scratch_path(spark, "rep"), dt.datetime(2026, 4, 7, 6, 0), "weekly", fmt=fmt).collect()}
    assert got["one"][0] == 2 and got["none"][0] == 0
    assert "/weekly_2026-04-07_08-00/" in got["one"][1]


def test_failed_import_leaves_the_old_tables(spark, tmp_path):
    from fleetlens.operators.batch_import import import_batch, read_import
    from tests.fixtures import TICKET_CSV, TRIP_CSV
    trips, tickets = csv(tmp_path, "trips.csv", TRIP_CSV), csv(tmp_path, "tickets.csv", TICKET_CSV)
    root = str(tmp_path / "tables")
    assert import_batch(spark, trips, tickets, root)["ticket"].count() == 4
    twice = csv(tmp_path, "twice.csv", TRIP_CSV + TRIP_CSV.split("\n")[1] + "\n")
    bad_time = csv(tmp_path, "bad.csv", TICKET_CSV.replace("06:58:00", "soon"))
    for args in ((twice, tickets), (trips, bad_time)):
        with pytest.raises(Exception):
            import_batch(spark, *args, root)
        kept = read_import(spark, root)
        assert (kept["trip"].count(), kept["ticket"].count(), kept["daily_kpi"].count()) == (6, 4, 1)
    assert import_batch(spark, trips, None, root)["daily_kpi"].first().total_revenue == Decimal("0.00")


def test_scratch_needs_a_shared_folder_off_local_mode():
    from types import SimpleNamespace

    from fleetlens.session import checkpoint_root
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda *a: None),
                         master="spark://host:7077", applicationId="a")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(sparkContext=sc))


def test_ad_hoc_sql_leaves_the_session_views_as_they_were(spark):
    from fleetlens.sources.sql import run_sql
    spark.range(3).createOrReplaceTempView("kept_view")
    got = run_sql(spark, "SELECT count(*) AS n FROM kept_view JOIN fresh_view USING (id)", {"kept_view": spark.range(5), "fresh_view": spark.range(4)})
    assert got.first().n == 4 and spark.table("kept_view").count() == 3
    assert [t.name for t in spark.catalog.listTables(pattern="fresh_view")] == []
    spark.catalog.dropTempView("kept_view")
