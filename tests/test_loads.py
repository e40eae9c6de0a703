"""Loads in one step: manifests, append once, checked loads, upserts that move
keys, rejected lines, deltas, key index, the multi-dimensional layout."""

from __future__ import annotations

import datetime as dt
import glob
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import layout, rollup
from fleetlens.operators import report as rpt
from fleetlens.operators import tables as tbl
from fleetlens.operators.aggregates import daily_kpi
from fleetlens.operators.key_index import add_load
from fleetlens.operators.manifest import LoadRejected, LostRace, Manifest, Transaction
from fleetlens.session import scratch_path
from fleetlens.sources.bindings import FleetTables
from fleetlens.sources.rejects import load_csv, read_accepted, read_rejects, ticket_fields, trip_fields

SF = "/root/testdata/sf0.001"


class Stopped(Exception):
    pass


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v int, p string")


# --- one version at a time


@pytest.mark.parametrize("step", ["_write", "_folders", "put", "rename"])
def test_a_stop_at_any_step_leaves_the_old_tables(spark, monkeypatch, step):
    path = scratch_path(spark, "stop")
    tbl.upsert_table(table(spark, [(1, 1, "a"), (2, 2, "b")]), path, ["k"], "p")
    old = values(tbl.read_stored(spark, path))
    seen = tbl.read_stored(spark, path)  # resolved before the load
    with monkeypatch.context() as m:
        def stop(*a, **k):
            raise Stopped
        if step == "rename":
            m.setattr(Manifest, "_file", lambda self, n: stop() if n > 1 else f"{self.root}/versions/{n:012d}.json")
        else:
            m.setattr(Manifest if step == "put" else Transaction, step, stop)
        with pytest.raises(Stopped):
            tbl.upsert_table(table(spark, [(1, 9, "b"), (3, 3, "a")]), path, ["k"], "p")
    assert values(tbl.read_stored(spark, path)) == old == values(seen)
    tbl.upsert_table(table(spark, [(1, 9, "b"), (3, 3, "a")]), path, ["k"], "p")
    assert values(tbl.read_stored(spark, path)) == [(1, 9, "b"), (2, 2, "b"), (3, 3, "a")]
    assert values(seen) == old  # a reader keeps its version
    m = Manifest(spark, path)
    before = {f["path"].split("/")[1] for f in m.version().tables["table"]["folders"]}
    m.vacuum(keep=1)
    assert values(tbl.read_stored(spark, path)) == [(1, 9, "b"), (2, 2, "b"), (3, 3, "a")]
    assert {f["path"].split("/")[1] for f in m.version().tables["table"]["folders"]} == before


def test_of_two_writers_one_wins_and_the_other_builds_on_it(spark):
    path = scratch_path(spark, "race")
    m = Manifest(spark, path)
    m.update(lambda t: t.append("t", table(spark, [(0, 0, "z")])))
    tries = []

    def slow(t):
        tries.append(t.base.number)
        if len(tries) == 1:  # another writer commits first
            m.update(lambda other: other.append("t", table(spark, [(1, 1, "a")])))
        t.append("t", table(spark, [(2, 2, "b")]))

    m.update(slow)
    assert tries == [1, 2] and values(m.read("t")) == [(0, 0, "z"), (1, 1, "a"), (2, 2, "b")]
    late = Transaction(m, m.version(2))
    late.append("t", table(spark, [(3, 3, "c")]))
    with pytest.raises(LostRace):
        late.commit()
    assert values(m.read("t", 1)) == [(0, 0, "z")]


def test_an_import_is_seen_whole_or_not_at_all(spark, monkeypatch, tmp_path):
    from fleetlens.operators.batch_import import import_batch, read_import
    from tests.fixtures import TICKET_CSV, TRIP_CSV

    def csv(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    trips, tickets, root = csv("trips.csv", TRIP_CSV), csv("tickets.csv", TICKET_CSV), str(tmp_path / "tables")
    import_batch(spark, trips, None, root)
    old = {t: values(df) for t, df in read_import(spark, root).items()}
    plain, calls = Transaction.overwrite, []
    for stop_at in (1, 2, 3):
        def overwrite(self, name, *a, stop=stop_at, **k):
            calls.append(name)
            if len(calls) == stop:
                raise Stopped
            return plain(self, name, *a, **k)
        calls.clear()
        with monkeypatch.context() as m:
            m.setattr(Transaction, "overwrite", overwrite)
            with pytest.raises(Stopped):
                import_batch(spark, trips, tickets, root)
        assert {t: values(df) for t, df in read_import(spark, root).items()} == old
    import_batch(spark, trips, tickets, root)
    assert read_import(spark, root)["ticket"].count() == 4


# --- upsert: the three probed cases


def test_null_partitions_survive_an_upsert_that_brings_one(spark):
    path = scratch_path(spark, "nullpart")
    tbl.upsert_table(table(spark, [(1, 1, None), (2, 2, "a"), (3, 3, ""), (4, 4, "x=/y z")]), path, ["k"], "p")
    tbl.upsert_table(table(spark, [(5, 5, None), (3, 9, "")]), path, ["k"], "p")
    assert values(tbl.read_stored(spark, path)) == values(table(spark, [(1, 1, None), (5, 5, None), (2, 2, "a"), (3, 9, ""), (4, 4, "x=/y z")]))


def test_a_key_that_moves_leaves_its_old_partition(spark):
    path = scratch_path(spark, "moves")
    tbl.upsert_table(table(spark, [(1, 1, "a"), (2, 2, "a"), (3, 3, "b"), (None, 7, "a")]), path, ["k"], "p")
    tbl.upsert_table(table(spark, [(1, 5, "b"), (3, 6, None), (None, 8, "c")]), path, ["k"], "p")
    assert values(tbl.read_stored(spark, path)) == values(table(spark, [(1, 5, "b"), (2, 2, "a"), (3, 6, None), (None, 7, "a"), (None, 8, "c")]))


def test_a_derived_partition_is_checked(spark):
    path = scratch_path(spark, "derived")
    part = F.when(F.col("k") < 5, F.lit("low")).otherwise(F.lit("high"))
    tbl.upsert_table(table(spark, [(1, 1, "low"), (9, 9, "high")]), path, ["k"], "p", part)
    tbl.upsert_table(table(spark, [(1, 2, "low")]), path, ["k"], "p", part)
    assert values(tbl.read_stored(spark, path)) == [(1, 2, "low"), (9, 9, "high")]
    with pytest.raises(ValueError, match="is not what the key"):
        tbl.upsert_table(table(spark, [(1, 2, "high")]), path, ["k"], "p", part)


# --- append once and checked loads


def test_a_load_is_appended_once(spark):
    path = scratch_path(spark, "once")
    load = table(spark, [(1, 1, "a"), (2, None, "b"), (2, None, "b")])
    assert tbl.append_once(load, path, "monday") is True
    assert tbl.append_once(load.orderBy(F.desc("k")).repartition(3), path, "monday") is False  # same rows in another order
    with pytest.raises(ValueError, match="other content"):
        tbl.append_once(table(spark, [(1, None, "a"), (2, 1, "b"), (2, None, "b")]), path, "monday")
    assert tbl.append_once(load.select("p", "v", "k"), path, "tuesday") is True  # by name
    assert values(tbl.read_stored(spark, path)) == values(load.unionByName(load))


def test_a_half_finished_load_is_repeated(spark, monkeypatch):
    path, load = scratch_path(spark, "half"), table(spark, [(1, 1, "a")])
    with monkeypatch.context() as m:
        m.setattr(Manifest, "put", lambda *a: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            tbl.append_once(load, path, "x")
    assert not tbl.exists(spark, path)
    assert tbl.append_once(load, path, "x") is True and tbl.read_stored(spark, path).count() == 1


def test_a_load_over_the_limit_does_not_commit_and_is_read_once(spark):
    path = scratch_path(spark, "checked")
    reads = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    load = table(spark, [(1, None, "aaaa"), (None, 2, "b"), (3, 3, None)]).mapInArrow(note, "k int, v int, p string")
    rules = {"v not null": F.col("v").isNull(), "p varchar(3)": F.char_length("p") > 3, "k not null": F.col("k").isNull()}
    with pytest.raises(LoadRejected) as e:
        tbl.append_once(load, path, "a", rules)
    assert e.value.counts == {"v not null": 1, "p varchar(3)": 1, "k not null": 1} and reads.value == 3
    assert not tbl.exists(spark, path)
    assert tbl.append_once(load, path, "a", rules, limit=1) and tbl.read_stored(spark, path).count() == 3


# --- rejected lines


def test_every_line_is_accepted_or_rejected(spark):
    path, root = scratch_path(spark, "rejects"), scratch_path(spark, "rejects-out")
    lines = ["trip_id,validated_at,fare_type,amount_eur,payment_method,stop",
             "1,2024-01-05 08:00:00,A,2.50,Bar,H1", "x,2024-01-05 08:00:00,A,n/a,Bar,H1", ",2024-01-05 08:00:00,A,,Bar,\"H, 2\"",
             "3,yesterday,A,1.00,Bar,H1", "4,,A,1.00,Bar,H1", "5,2024-01-05 08:00:00,A", "6,2024-01-05 08:00:00,A,1.00,Bar,H1,extra", "", "7.0,2024-02-30 08:00:00,A,1,Bar,H"]
    spark.createDataFrame([(l,) for l in lines], "value string").coalesce(1).write.text(path)
    assert load_csv(spark, path, ticket_fields(), root, "jan") and not load_csv(spark, path, ticket_fields(), root, "jan")
    ok, bad = read_accepted(spark, root), read_rejects(spark, root)
    assert values(ok.select("trip_id", "amount_eur", "stop")) == values(spark.createDataFrame([(1, Decimal("2.50"), "H1"), (None, None, "H, 2")], "a long, b decimal(12,2), c string"))
    got = sorted((lines.index(r["raw_line"]), r["column"], r["reason"]) for r in bad.select("raw_line", F.coalesce("column", F.lit("-")).alias("column"), "reason").collect())
    assert got == [(2, "amount_eur", "not a amount"), (2, "trip_id", "not a whole number"), (4, "validated_at", "not a time"), (5, "validated_at", "missing"),
                   (6, "-", "wrong number of fields"), (7, "-", "wrong number of fields"), (9, "validated_at", "not a time")]
    assert ok.count() + bad.select("raw_line").distinct().count() == 8
    assert bad.first()["file"].startswith("file:")


def test_rejected_trips_by_header_name(spark):
    path, root = scratch_path(spark, "trips"), scratch_path(spark, "trips-out")
    lines = ["Tag,id,km,start_time", "2024-01-05,1,3.5,08:00:00", "5.1.2024,2,3.5,08:00:00", "2024-01-05,3,many,25:61:00", "2024-01-05,,1,"]
    spark.createDataFrame([(l,) for l in lines], "value string").coalesce(1).write.text(path)
    load_csv(spark, path, trip_fields(), root, "t", {"Tag": "service_date", "id": "trip_id"})
    assert [tuple(r) for r in read_accepted(spark, root).select("trip_id", "service_date", "km", "start_sec", "line").collect()] == [(1, dt.date(2024, 1, 5), Decimal("3.50"), 28800, None)]
    assert sorted((r["column"], r["reason"]) for r in read_rejects(spark, root).collect()) == [
        ("km", "not a number"), ("service_date", "not a date"), ("start_time", "not a time of day"), ("trip_id", "missing")]


# --- figures kept by deltas


def test_deltas_equal_the_whole_rollup(spark):
    t = FleetTables(spark, SF)
    trip, ticket, root = t.trip, t.ticket, scratch_path(spark, "delta")
    got = rollup.apply(spark, root, rollup.Change(trips_in=trip, tickets_in=ticket), "all")
    assert values(got) == values(daily_kpi(trip, ticket))
    some = trip.where("trip_id % 4 = 0")
    kept = trip.where("trip_id % 4 != 0")
    own = ticket.where("trip_id % 4 = 0")
    got = rollup.apply(spark, root, rollup.Change(some, own), "gone")
    assert values(got) == values(daily_kpi(kept, ticket))
    assert values(rollup.apply(spark, root, rollup.Change(some, own), "gone")) == values(got)
    with pytest.raises(ValueError, match="other content"):
        rollup.apply(spark, root, rollup.Change(kept), "gone")
    rest = kept.drop("service_date").withColumn("service_date", F.lit(dt.date(2030, 1, 1)))
    got = rollup.apply(spark, root, rollup.Change(kept, ticket, rest, ticket), "one day")
    assert values(got) == values(daily_kpi(rest.select(*trip.columns), ticket))


def test_a_delta_reads_the_change_only(spark):
    t = FleetTables(spark, SF)
    change = t.trip.where("trip_id = 4")
    plan = rollup.delta(rollup.Change(change, t.ticket.where("trip_id = 4")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "EqualTo(o_orderkey,4)" in plan and "EqualTo(l_orderkey,4)" in plan


# --- keys across loads


def test_key_index_equals_the_full_check(spark):
    root, seen = scratch_path(spark, "keys"), []
    big = 1 << 40
    for load in ([1, 2, 3, 32768, 32769, None, None], [4, 4, 5, 70000, big], [-1, 0, -32768, 3, 4, big, big + 1], [0, 0, 99], []):
        seen += load
        got = {r["key_value"]: r["dup_count"] for r in add_load(spark, root, spark.createDataFrame([(k,) for k in load], "k long"), "k").collect()}
        assert got == {k: seen.count(k) for k in set(load) - {None} if seen.count(k) > 1}


def test_new_key_ranges_read_no_stored_keys(spark, monkeypatch):
    root, asked = scratch_path(spark, "ranges"), []
    plain = Manifest.frame
    monkeypatch.setattr(Manifest, "frame", lambda self, v, name, values=None: (asked.append((name, values)), plain(self, v, name, values))[1])
    for start in (0, 1 << 24, 5 << 24):
        add_load(spark, root, spark.range(start + 1, start + 500).toDF("k"), "k")
    assert [v for n, v in asked if n == "keys" and v is not None and v != []] == []
    add_load(spark, root, spark.range((1 << 24) + 3, (1 << 24) + 5).toDF("k"), "k")
    assert [v for n, v in asked if n == "keys" and v] == [["v1"]]


# --- layout


def _files(path):
    return glob.glob(path.removeprefix("file:") + "/**/*.parquet", recursive=True)


def _groups_with(path, column, value):
    """Row groups whose minimum and maximum let the value be, and all row groups."""
    hit = total = 0
    for f in _files(path):
        meta = pq.ParquetFile(f).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            total += 1
            hit += s is None or not s.has_min_max or s.min <= value <= s.max
    return hit, total


def test_curve_layout_reads_a_quarter_of_the_row_groups(spark):
    trip = FleetTables(spark, "/root/testdata/sf0.1").trip.select("trip_id", "service_date", "line", "vehicle_no", "km")
    month, curve = scratch_path(spark, "by-month"), scratch_path(spark, "by-curve")
    tbl.write_clustered(trip.withColumn("m", F.date_format("service_date", "yyyy-MM")), month, "m", "line")
    layout.write_curve(trip, curve, ["service_date", "line", "vehicle_no"], ["trip_id"], files=80, bloom={"vehicle_no": 3000, "trip_id": 3000})
    row = trip.where("trip_id % 1000 = 7").first()
    for column in ("vehicle_no", "line"):
        before, n = _groups_with(month, column, row[column])
        now, _ = _groups_with(curve, column, row[column])
        assert before > n / 2 and 4 * now <= before, column
    days, n = _groups_with(curve, "service_date", row["service_date"])
    assert 4 * days <= n
    back = spark.read.schema(trip.schema).parquet(curve)
    assert back.count() == trip.count() and back.where(F.col("vehicle_no") == row["vehicle_no"]).count() == trip.where(F.col("vehicle_no") == row["vehicle_no"]).count()
    meta = pq.ParquetFile(_files(curve)[0]).metadata
    assert meta.num_columns == 5


def test_curve_of_hot_values_nulls_and_nothing(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as a", "if(id % 5 = 0, null, id) as b")
    path = scratch_path(spark, "curve")
    layout.write_curve(rows, path, ["a", "b"], ["id"], files=8)
    assert values(spark.read.parquet(path)) == values(rows)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in _files(path)]
    assert len(sizes) >= 6 and max(sizes) < 1000  # a third of the rows holds one value
    empty = scratch_path(spark, "curve-empty")
    layout.write_curve(rows.limit(0), empty, ["a", "b"], ["id"], files=2)
    assert spark.read.schema(rows.schema).parquet(empty).count() == 0


# --- all periods at once


def test_period_cube_scans_and_equals_each_report(spark):
    trip = FleetTables(spark, SF).trip
    cube = rpt.period_cube(trip)
    assert cube._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    for unit in rpt.PERIOD_UNITS:
        one = rpt.period_report(trip, unit)
        assert values(cube.where(f"grain = '{unit}' and scope = 'all'").select(*one.columns)) == values(one)
        lines = rpt.period_line_report(trip, unit)
        assert values(cube.where(f"grain = '{unit}' and scope = 'line'").select(*lines.columns)) == values(lines)
