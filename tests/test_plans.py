"""Physical-plan checks: the shapes that matter at scale.

Filters and column pruning reach the Parquet scan, top-k never sorts
globally, aggregates combine map-side, hot-key windows are limited before
the shuffle, and no registered query contains a cartesian product.
"""

from __future__ import annotations

import pytest

from fleetlens.operators import aggregates as agg
from fleetlens.operators import filters as flt
from fleetlens.operators import topk
from fleetlens.plans.registry import registry
from fleetlens.sources.bindings import TRIP_AS_OF, FleetTables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_pushed_to_scan(spark):
    t = FleetTables(spark, SF)
    p = plan(flt.since(t.trip, "service_date", TRIP_AS_OF, 7))
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(o_orderdate,2001-07-25" in pushed


def test_column_pruning(spark):
    t = FleetTables(spark, SF)
    p = plan(agg.counts_by(t.trip, "status", "n"))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<o_orderstatus:string>"


def test_top_k_without_global_sort(spark):
    p = plan(topk.top_recent(FleetTables(spark, SF).trip, 50))
    assert "TakeOrderedAndProject" in p


def test_partial_aggregation_before_shuffle(spark):
    t = FleetTables(spark, SF)
    p = plan(agg.daily_kpi(t.trip, t.ticket))
    assert p.count("HashAggregate") >= 4      # partial + final for tickets->trip and trip->day
    assert "partial_sum" in p


@pytest.mark.parametrize("key", sorted(k for k in registry() if not k.startswith(("stream_", "sink_", "src_csv",
                                                                                 "physical", "surrogate"))))
def test_no_cartesian_product(spark, key):
    df = registry()[key].build(spark, SF)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in p and "CartesianProduct" not in p


def test_bucketed_tables_join_without_shuffle(spark):
    from fleetlens.operators.aggregates import revenue_cents_per_trip
    from fleetlens.operators.tables import write_bucketed
    from fleetlens.session import scratch_path
    t = FleetTables(spark, SF)
    write_bucketed(t.trip, "fl_trip_b", scratch_path(spark, "trip-b"), "trip_id", 8)
    write_bucketed(revenue_cents_per_trip(t.ticket), "fl_rev_b", scratch_path(spark, "rev-b"), "trip_id", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # large-table case: no broadcast
    try:
        joined = spark.table("fl_trip_b").join(spark.table("fl_rev_b"), "trip_id", "left")
        p = plan(joined)
        assert "SortMergeJoin" in p and "Exchange" not in p   # co-located buckets, no shuffle
        assert joined.count() == t.trip.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def scans(df, column):
    """Scans of the table that has ``column`` in the plan."""
    return sum("FileScan" in line and column in line for line in plan(df).splitlines())


def test_one_scan_per_table_in_the_snapshot_and_none_in_the_manifest(spark):
    snapshot, manifest = (registry()[k].build(spark, SF) for k in ("fleet_snapshot", "report_manifest"))
    assert [scans(snapshot, c) for c in ("o_totalprice", "c_mktsegment", "event_type")] == [1, 1, 1]
    assert scans(manifest, "o_custkey") == 0


def test_upsert_reads_its_source_twice_at_most(spark):
    """One rollup to create the table and one for the incoming rows."""
    from fleetlens.operators import tables
    read = []
    plain = tables.upsert_table
    try:
        tables.upsert_table = lambda df, *a: (read.append(scans(df, "o_orderdate")), plain(df, *a))[1]
        registry()["sink_upsert_daily"].build(spark, SF).count()
    finally:
        tables.upsert_table = plain
    assert read == [1, 1]
