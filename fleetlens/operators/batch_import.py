"""The batch import as one flow: read the exports, validate, refresh trips,
tickets and the daily KPIs together, and roll up.

All tables of one import are committed as one version of a manifest: a reader
sees those of the import before or those of this one, wherever it stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.aggregates import daily_kpi
from fleetlens.operators.joins import keep_known
from fleetlens.operators.manifest import Manifest, Transaction
from fleetlens.operators.tables import add_columns_if_missing, check_unique
from fleetlens.sources.files import read_tickets_csv, read_trips_csv

TABLES = ("trip", "ticket", "daily_kpi")


def import_batch(spark: SparkSession, trip_paths, ticket_paths, root: str, trip_names=None, ticket_names=None) -> dict[str, DataFrame]:
    """Replace the tables below ``root`` by the contents of the CSV exports.

    Trips get the evolved columns, and must have an id, unique, and a date.
    Tickets of unknown trips are left out; without ticket files the ticket table is empty.
    Returns the new tables."""
    def refresh(t: Transaction) -> None:
        t.overwrite("trip", add_columns_if_missing(read_trips_csv(spark, trip_paths, trip_names)))
        _validate(t.read("trip"))
        tickets = read_tickets_csv(spark, ticket_paths, ticket_names) if ticket_paths else _no_tickets(spark)
        t.overwrite("ticket", keep_known(tickets, t.read("trip").select("trip_id"), "trip_id"))
        t.overwrite("daily_kpi", daily_kpi(t.read("trip"), t.read("ticket")))

    Manifest(spark, root).update(refresh)
    return read_import(spark, root)


def read_import(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the newest import."""
    m = Manifest(spark, root)
    version = m.version()
    return {t: m.frame(version, t) for t in TABLES}


def _no_tickets(spark: SparkSession) -> DataFrame:
    from fleetlens.schemas import TICKET
    return spark.createDataFrame([], TICKET)


def _validate(trips: DataFrame) -> None:
    bad = trips.where(F.col("trip_id").isNull() | F.col("service_date").isNull())
    if not bad.isEmpty():
        raise ValueError("trips without an id or a date")
    check_unique(trips, ["trip_id"])
