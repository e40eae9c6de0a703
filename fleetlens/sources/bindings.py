"""Bindings of the driver's test tables to the canonical fleet tables.

The driver ships TPC-H-like tables; the fleet operators work on trips,
tickets, buses and maintenance records.  Every column is derived from the
test tables row by row (pure projections, so they fuse into the scan stage
and Catalyst prunes what a query does not use).  NULLs, unmatched keys, ties
and malformed strings are created on purpose because the test tables have
none.  This module is the only one that knows the test tables.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import (BUS_STATUS_ACTIVE, BUS_STATUS_IN_MAINTENANCE, MAINTENANCE_STATUS_OVERDUE,
                               MAINTENANCE_STATUS_PLANNED, TRIP_STATUS_CANCELLED, TRIP_STATUS_LATE,
                               TRIP_STATUS_ON_SCHEDULE)
from fleetlens.sources.files import load

# Reference dates of the bound data (the "today" of the reports).
TRIP_AS_OF = _dt.date(2001, 8, 1)
MAINTENANCE_AS_OF = _dt.date(2024, 1, 20)
# Day whose trips are all forced to cancelled (A9 cancelled-only day).
CANCELLED_DAY = _dt.date(1995, 1, 1)
# Upsert fixture: incoming days start here.
UPSERT_FROM = _dt.date(2001, 1, 1)


# Column layout of the driver's test tables that the bindings read.  Declared
# so that planning never infers it from file footers.
INPUT_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
              "props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def _lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _null_unless(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN NULL ELSE {value} END"


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One projection written as SQL expressions ``{name: expression}``.

    The whole select is sent to the JVM as text and parsed once, instead of
    one gateway call per column operator; Catalyst sees the same plan.
    """
    return df.selectExpr(*[f"{expr} AS `{name}`" for name, expr in columns.items()])


def trip_from_orders(orders: DataFrame) -> DataFrame:
    status = (f"CASE o_orderstatus WHEN 'F' THEN {_lit(TRIP_STATUS_ON_SCHEDULE)} "
              f"WHEN 'O' THEN {_lit(TRIP_STATUS_LATE)} ELSE {_lit(TRIP_STATUS_CANCELLED)} END")
    return _project(orders, {
        "trip_id": "CAST(o_orderkey AS BIGINT)",
        "service_date": "to_date(o_orderdate)",
        "line": "CAST(100 + o_custkey % 40 AS STRING)",
        "direction": "CASE WHEN o_orderkey % 2 = 0 THEN 'Hin' ELSE 'Rück' END",
        # every 20th trip has a bus that no table knows
        "bus_id": "CAST(CASE WHEN o_orderkey % 20 = 0 THEN -o_custkey ELSE o_custkey END AS BIGINT)",
        "vehicle_no": "concat('B-', CAST(o_custkey AS STRING))",
        "driver_id": "concat('F', CAST(o_orderkey % 97 AS STRING))",
        "start_sec": _null_unless("o_orderkey % 31 = 0", "CAST((o_orderkey * 37) % 86400 AS INT)"),
        "delay_min": _null_unless("o_orderkey % 50 = 0", "CAST((o_orderkey * 7) % 18 - 2 AS INT)"),
        "km": "CAST(o_totalprice AS DECIMAL(12,2))",
        "boardings": "CAST(o_orderkey % 90 AS INT)",
        "occupancy_pct": "CAST(CAST((o_orderkey * 13) % 10001 AS DECIMAL(10,2))"
                         " * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2))",
        "energy_kwh": _null_unless("o_orderkey % 11 = 0", "CAST((o_orderkey * 17) % 900 AS DECIMAL(8,2))"),
        "status": status,
    })


# payment method of a ticket line, by line number
_PAYMENT = ("CASE l_linenumber % 4 WHEN 0 THEN 'Bar' WHEN 1 THEN 'eTicket' "
            "WHEN 2 THEN 'Handy' ELSE 'Karte' END")


def ticket_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return _project(lineitem, {
        "trip_id": "CAST(l_orderkey AS BIGINT)",
        "validated_at": "l_shipdate",
        "fare_type": "concat(l_returnflag, l_linestatus)",
        "amount_eur": "CAST(l_extendedprice AS DECIMAL(12,2))",
        "payment_method": _PAYMENT,
        "stop": "concat('H', CAST(l_suppkey AS STRING))",
    })


def bus_from_customer(customer: DataFrame) -> DataFrame:
    status = (f"CASE c_mktsegment WHEN 'BUILDING' THEN {_lit(BUS_STATUS_IN_MAINTENANCE)} "
              f"WHEN 'MACHINERY' THEN 'inaktiv' ELSE {_lit(BUS_STATUS_ACTIVE)} END")
    return _project(customer, {
        "bus_id": "CAST(c_custkey AS BIGINT)",
        "plate": "c_name",
        "model": "c_mktsegment",
        "odometer_km": "CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 100 AS BIGINT)",
        "status": status,
    })


def maintenance_from_events(events: DataFrame) -> DataFrame:
    status = (f"CASE event_type WHEN 'error' THEN {_lit(MAINTENANCE_STATUS_OVERDUE)} "
              f"WHEN 'purchase' THEN 'erledigt' ELSE {_lit(MAINTENANCE_STATUS_PLANNED)} END")
    return _project(events, {
        "maintenance_id": "CAST(event_id AS BIGINT)",
        "bus_id": "CAST(user_id AS BIGINT)",
        "service_date": "to_date(ts)",
        "kind": "event_type",
        "status": status,
        "next_due": _null_unless("event_id % 13 = 0", "date_add(to_date(ts), 10)"),
    })


def raw_ticket_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """All-string tickets with malformed ids, amounts and times (lenient parsing input),
    plus the untouched text fields of a ticket export line."""
    good_time = ("concat(lpad(CAST(l_partkey % 24 AS STRING), 2, '0'), ':', "
                 "lpad(CAST(l_suppkey % 60 AS STRING), 2, '0'), ':00')")
    return _project(lineitem, {
        "trip_id_raw": "CASE WHEN l_orderkey % 19 = 0 THEN 'x' WHEN l_orderkey % 7 = 0 THEN concat(CAST(l_orderkey AS STRING), '.0') "
                       "WHEN l_orderkey % 17 = 0 THEN concat(CAST(l_orderkey AS STRING), '.5') ELSE CAST(l_orderkey AS STRING) END",
        "amount_raw": "CASE WHEN l_partkey % 23 = 0 THEN 'n/a' "
                      "ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END",
        "time_raw": f"CASE WHEN l_partkey % 29 = 0 THEN '25:61:00' ELSE {good_time} END",
        "validated_at_raw": "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')",
        "fare_type": "concat(l_returnflag, l_linestatus)",
        "payment_method": _PAYMENT,
        "stop": "concat('H', CAST(l_suppkey AS STRING))",
    })


class FleetTables:
    """Canonical tables bound to one test-data directory (lazy DataFrames)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name, INPUT_SCHEMAS.get(name))

    @cached_property
    def trip(self) -> DataFrame:
        return trip_from_orders(self.raw("orders"))

    @cached_property
    def ticket(self) -> DataFrame:
        return ticket_from_lineitem(self.raw("lineitem"))

    @cached_property
    def bus(self) -> DataFrame:
        return bus_from_customer(self.raw("customer"))

    @cached_property
    def maintenance(self) -> DataFrame:
        return maintenance_from_events(self.raw("events"))

    @cached_property
    def raw_ticket(self) -> DataFrame:
        return raw_ticket_from_lineitem(self.raw("lineitem"))

    @property
    def legacy_trip(self) -> DataFrame:
        # The legacy trip table carries bus_id like the canonical one.
        return self.trip

    @cached_property
    def stray_ticket(self) -> DataFrame:
        """Tickets of which every 20th trip's belong to no trip: the test
        tables have an order for every lineitem, so their ids are shifted."""
        return self.ticket.withColumn("trip_id", F.expr("CASE WHEN trip_id % 20 = 0 THEN -trip_id ELSE trip_id END"))
