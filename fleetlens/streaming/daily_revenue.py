"""Streaming daily revenue: one-day windows over ticket validations, with the
late rows kept.

Every micro-batch is one transaction on three tables of a manifest:

- ``days``: revenue per validation day, partitioned by month, to which the batch's
  sums are added;
- ``late``: the tickets whose day had ended before the watermark, with the batch
  that brought them; ``merge_late`` adds them to their days later;
- ``files``: the input files that have been counted.

The watermark is the newest validation time of the batches before, less the
allowed delay, and is committed with the tables.  A file belongs to one batch
as a whole, so a file that is there already adds nothing: a replayed batch, a
fresh checkpoint and a stop before the commit all leave every ticket counted
once, in ``days`` or in ``late``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.measures import from_unscaled, unscaled
from fleetlens.functions.scalars import event_time
from fleetlens.operators.manifest import Manifest, Transaction
from fleetlens.schemas import TICKET

DAYS = "validation_date date, revenue_cents long, month string"
_FILE, _DAY = "_file", "validation_date"


@dataclass
class RevenueRun:
    """The tables after a drained run: (validation_date, revenue), the late
    tickets with their batch id, and (batch id, late rows) of this run."""

    table: DataFrame
    late: DataFrame
    dropped: list[tuple[int, int]]


def _month() -> Column:
    return F.date_format(_DAY, "yyyy-MM")


def _seconds(interval: str) -> int:
    return SparkSession.active().sql(f"SELECT cast(unix_seconds(timestamp_seconds(0) + INTERVAL {interval}) as long)").first()[0]


def day_sums(tickets: DataFrame) -> DataFrame:
    """(validation_date, revenue_cents, month): one row a day."""
    sums = tickets.groupBy(F.to_date("validated_at").alias(_DAY)).agg(F.sum(unscaled("amount_eur")).alias("revenue_cents"))
    return sums.withColumn("month", _month())


def _add_to_days(t: Transaction, sums: DataFrame) -> None:
    """Adds per-day sums to the days of the same date; only their months are written."""
    if t.has("days"):
        old = t.read("days").select(_DAY, F.col("revenue_cents").alias("before"))
        sums = (sums.join(old, _DAY, "left")
                .withColumn("revenue_cents", F.coalesce(F.col("revenue_cents") + F.coalesce("before", F.lit(0)), "before")).drop("before"))
    t.upsert("days", sums, [_DAY], "month", _month())


def stream_daily_revenue(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, watermark: str,
                         files_per_trigger: int | None = None) -> RevenueRun:
    """Drain ``src_dir`` (ticket Parquet files) with an available-now trigger.

    ``files_per_trigger`` splits the input over micro-batches (no limit by
    default).  A ticket without a validation time fails the job: it belongs to
    no day."""
    manifest, delay, noted = Manifest(spark, out_dir), _seconds(watermark), {}

    def add_batch(batch: DataFrame, batch_id: int) -> None:
        def change(t: Transaction) -> None:
            new = batch
            if t.has("files"):
                new = new.join(t.read("files").select(F.col("file").alias(_FILE)), _FILE, "left_anti")
            new = new.persist()  # read four times; an executor that is lost reads its files again
            try:
                add(t, new)
            finally:
                new.unpersist()

        def add(t: Transaction, new: DataFrame) -> None:
            newest = new.agg(F.max("_seconds")).first()[0]
            if newest is None:
                return
            mark = int(t.next.info.get("watermark", -1 << 62))
            late = (F.unix_date(F.to_date("validated_at")).cast("long") + 1) * 86400 <= mark
            behind = new.where(late).select(*TICKET.fieldNames(), F.lit(batch_id).cast("long").alias("batch_id"))
            noted[batch_id] = behind.count()
            _add_to_days(t, day_sums(new.where(~late)))
            if noted[batch_id] or not t.has("late"):
                t.append("late", behind)
            t.append("files", new.select(F.col(_FILE).alias("file")).distinct())
            t.next.info["watermark"] = str(max(mark, newest - delay))

        manifest.update(change)

    src = spark.readStream.schema(TICKET)
    if files_per_trigger is not None:
        src = src.option("maxFilesPerTrigger", files_per_trigger)
    time = F.when(F.col("validated_at").isNull(), F.raise_error(F.lit("ticket without a validation time")).cast("timestamp")
                  ).otherwise(event_time("validated_at"))
    rows = src.parquet(src_dir).select(*TICKET.fieldNames(), F.col("_metadata.file_path").alias(_FILE), F.unix_seconds(time).alias("_seconds"))
    query = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add_batch).trigger(availableNow=True).start()
    query.awaitTermination()
    return RevenueRun(read_days(spark, out_dir), read_late(spark, out_dir), sorted(noted.items()))


def read_days(spark: SparkSession, out_dir: str) -> DataFrame:
    """(validation_date, revenue) without the late tickets."""
    m = Manifest(spark, out_dir)
    v = m.version()
    days = m.frame(v, "days") if "days" in v.tables else spark.createDataFrame([], DAYS)
    return days.select(_DAY, from_unscaled(F.col("revenue_cents")).alias("revenue"))


def read_late(spark: SparkSession, out_dir: str) -> DataFrame:
    """The late tickets that wait to be merged, with the batch that brought them."""
    m = Manifest(spark, out_dir)
    v = m.version()
    if "late" in v.tables:
        return m.frame(v, "late")
    return spark.createDataFrame([], TICKET).withColumn("batch_id", F.lit(None).cast("long"))


def merge_late(spark: SparkSession, out_dir: str) -> DataFrame:
    """Add the late tickets to their days and empty the side table, in one step."""
    def change(t: Transaction) -> None:
        if t.has("late") and not t.read("late").isEmpty():
            _add_to_days(t, day_sums(t.read("late")))
            t.overwrite("late", t.read("late").limit(0))

    Manifest(spark, out_dir).update(change)
    return read_days(spark, out_dir)
