"""Streaming daily-KPI maintenance: each micro-batch of new trip or ticket files
recomputes the service dates it touches from the stored base tables and
upserts those days by date.

Averages are never merged from partial results: a touched day is recomputed
from all of its trips and their tickets, so late or replayed files, and a fresh
checkpoint, give the same table.  The trip store is partitioned by service
month, so a batch reads the months it touches (partition pruning), not the
range between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.aggregates import daily_kpi_from_revenue, revenue_cents_per_trip
from fleetlens.operators.joins import keep_known
from fleetlens.operators.tables import exists, read_stored, upsert_table
from fleetlens.schemas import DAILY_KPI, TICKET, TRIP

MONTH = "service_month"


def _month() -> Column:
    return F.date_format("service_date", "yyyy-MM")


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, _month())


def read_trip_store(spark: SparkSession, trip_dir: str) -> DataFrame:
    """Trips stored below ``trip_dir`` by ``partitionBy(service_month)``."""
    return spark.read.schema(T.StructType([*TRIP.fields, T.StructField(MONTH, T.StringType())])).parquet(trip_dir)


def recompute_days(trips: DataFrame, tickets: DataFrame, days: DataFrame) -> DataFrame:
    """Daily KPIs of the given days (service_date, service_month) only.

    The touched months, at most one per calendar month, prune the trip store's
    directories as literals; the day semi join leaves the touched days' trips;
    tickets are reduced to those trips before they are summed."""
    months = [r[0] for r in days.select(MONTH).distinct().collect()]
    touched = keep_known(trips.where(F.col(MONTH).isin(months)).drop(MONTH), days.select("service_date"), "service_date")
    return daily_kpi_from_revenue(touched, revenue_cents_per_trip(keep_known(tickets, touched.select("trip_id"), "trip_id")))


def touched_days(batch: DataFrame, trips: DataFrame) -> DataFrame:
    """(service_date, service_month) that a batch of trips (with a date) and
    tickets (with a trip id) touches."""
    own = batch.where("service_date is not null").select("service_date")
    of_tickets = keep_known(trips.select("trip_id", "service_date"),
                            batch.where("service_date is null and trip_id is not null").select("trip_id"), "trip_id")
    return with_month(own.unionByName(of_tickets.select("service_date")).distinct())


def stream_upsert_kpi(spark: SparkSession, trip_dir: str, ticket_dir: str, out_dir: str, checkpoint: str,
                      files_per_trigger: int | None = None) -> DataFrame:
    """Drain new files of the trip store (Parquet, partitioned by
    service_month) and of the ticket store and return the maintained daily KPI
    table, itself partitioned by month.  ``files_per_trigger`` splits the input
    over micro-batches (no limit by default).  A trip without a date fails the
    job: it belongs to no day that could be kept current."""
    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        trips = read_trip_store(spark, trip_dir)
        tickets = spark.read.schema(TICKET).parquet(ticket_dir)
        days = touched_days(batch, trips).checkpoint(eager=True)  # a row per touched day
        if not days.isEmpty():
            upsert_table(with_month(recompute_days(trips, tickets, days)), out_dir, ["service_date"], MONTH, _month())

    def stream(schema, path):
        src = spark.readStream.schema(schema)
        if files_per_trigger is not None:
            src = src.option("maxFilesPerTrigger", files_per_trigger)
        return src.parquet(path)

    dated = F.when(F.col("service_date").isNull(), F.raise_error(F.lit("trip without a service date")).cast("date")
                   ).otherwise(F.col("service_date"))
    new_trips = stream(TRIP, trip_dir).select(F.lit(None).cast("bigint").alias("trip_id"), dated.alias("service_date"))
    new_tickets = stream(TICKET, ticket_dir).select("trip_id", F.lit(None).cast("date").alias("service_date"))
    q = (new_trips.unionByName(new_tickets).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(upsert_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    if not exists(spark, out_dir):
        return spark.createDataFrame([], DAILY_KPI)
    return read_stored(spark, out_dir).select(*DAILY_KPI.fieldNames())
