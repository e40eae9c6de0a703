"""Foreign keys on streams: tickets wait for their trip, and those whose trip
does not come go to an orphan table.

Tickets and trips are two file streams, joined by the trip id within a range of
event time: a trip's day lies at most ``after`` before a ticket of it, and at most
``wait`` behind it.  The stream-stream outer join keeps a ticket in state until the
watermark of both streams (newest event time less ``wait``) rules its trip out, and
then gives it out without one.  Trips leave the state when no ticket can come.

A micro-batch's orphans are appended under the id of the query and the batch, so a
batch that is replayed after a stop adds nothing twice.  Tickets without a trip id
are no orphans.  A ticket behind the watermark is not joined; how many there were
is returned.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.scalars import event_time
from fleetlens.operators.manifest import Manifest
from fleetlens.schemas import TICKET, TRIP

ORPHANS = "orphans"


@dataclass
class OrphanRun:
    """The orphan table after a drained run and the rows behind the watermark."""

    table: DataFrame
    late: int


def unmatched(tickets: DataFrame, trips: DataFrame, wait: str, after: str) -> DataFrame:
    """The streaming join: tickets with a trip id that no trip has."""
    t = tickets.withColumn("_at", event_time("validated_at")).withWatermark("_at", wait).alias("t")
    p = (trips.select(F.col("trip_id").alias("_trip"), event_time(F.col("service_date").cast("timestamp_ntz")).alias("_day"))
         .withWatermark("_day", wait).alias("p"))
    on = F.expr(f"t.trip_id = p._trip and t._at >= p._day - interval {wait} and t._at <= p._day + interval {after}")
    # The test names the event time so that it is not pushed below the watermark, which counts heartbeats too.
    return t.join(p, on, "left_outer").where("_trip is null and (t.trip_id is not null or t._at is null)").select(*[F.col(f"t.{c}") for c in TICKET.fieldNames()])


def stream_orphans(spark: SparkSession, ticket_dir: str, trip_dir: str, out_dir: str, checkpoint: str, wait: str, after: str,
                   files_per_trigger: int | None = None) -> OrphanRun:
    """Drain both directories (Parquet files) with an available-now trigger."""
    manifest = Manifest(spark, out_dir)

    def keep(batch: DataFrame, batch_id: int) -> None:
        load_id = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId') or checkpoint}:{batch_id}"
        if not batch.isEmpty():
            manifest.update(lambda t: t.append(ORPHANS, batch, load_id))

    def stream(schema, path):
        src = spark.readStream.schema(schema)
        if files_per_trigger is not None:
            src = src.option("maxFilesPerTrigger", files_per_trigger)
        return src.parquet(path)

    joined = unmatched(stream(TICKET, ticket_dir), stream(TRIP, trip_dir), wait, after)
    query = joined.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return OrphanRun(read_orphans(spark, out_dir), late)


def read_orphans(spark: SparkSession, out_dir: str) -> DataFrame:
    m = Manifest(spark, out_dir)
    v = m.version()
    return m.frame(v, ORPHANS) if ORPHANS in v.tables else spark.createDataFrame([], TICKET)


def heartbeat(spark: SparkSession, ticket_dir: str, trip_dir: str, at: _dt.datetime) -> None:
    """Tell both streams that event time has come to ``at``: a ticket without a
    trip id and a trip that nobody takes.  Tickets that wait longer are decided."""
    spark.createDataFrame([(None, at, None, None, None, None)], TICKET).coalesce(1).write.mode("append").parquet(ticket_dir)
    trip = (-1, at.date(), "", *[None] * (len(TRIP.fields) - 3))
    spark.createDataFrame([trip], TRIP).coalesce(1).write.mode("append").parquet(trip_dir)
