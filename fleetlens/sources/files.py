"""File sources: table scans and typed CSV ingest (strict and lenient parsing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.scalars import lenient_cast, lenient_time_seconds, strict_date
from fleetlens.operators.tables import default_missing_columns

# Fields of the operator's trip and ticket export files.
TRIP_CSV_COLUMNS = ("trip_id", "service_date", "line", "direction", "vehicle_no", "driver_id",
                    "start_time", "end_time", "planned_start", "planned_end", "delay_min", "km",
                    "boardings", "occupancy_pct", "energy_kwh", "status", "productive", "trip_type")
TICKET_CSV_COLUMNS = ("trip_id", "validated_at", "fare_type", "amount_eur", "payment_method", "stop")
TRIP_CSV_REQUIRED = ("trip_id", "service_date")
TICKET_CSV_REQUIRED = ("trip_id", "validated_at", "amount_eur")
TRIP_CSV_DEFAULTS = {"productive": ("true", "string"), "trip_type": ("1", "string")}


def load(spark: SparkSession, directory: str, name: str, schema: str | None = None) -> DataFrame:
    """Full table scan of ``<directory>/<name>.parquet`` (columns pruned lazily).

    With a declared ``schema`` the reader skips schema inference (no footer
    reads while planning); without one the schema is inferred from the files.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def _csv_by_name(spark: SparkSession, paths, columns, required, names) -> DataFrame:
    """CSV fields as text, taken by the names in the header.

    Each path may have its own header (the files below one path share it: a
    file with another one fails the job, it is never read shifted).  ``names``
    maps header names to canonical ones; other fields are ignored, missing
    ones NULL, and a missing required one is an error.
    """
    names = names or {}
    parts = None
    for path in [paths] if isinstance(paths, str) else paths:
        header = spark.read.option("header", True).csv(path).columns
        canonical = [names.get(h, h) for h in header]
        twice = sorted({c for c in canonical if c in columns and canonical.count(c) > 1})
        missing = [c for c in required if c not in canonical]
        if twice or missing:
            raise ValueError(f"{path}: missing fields {missing}, repeated fields {twice}, header {header}")
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
        wanted = {c: i for i, c in enumerate(canonical) if c in columns}
        one = raw.select(*[F.col(f"`{header[i]}`").alias(c) for c, i in wanted.items()])
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    return parts


def _with_all(raw: DataFrame, columns, defaults=None) -> DataFrame:
    """The missing columns with their default text, or NULL."""
    values = {c: (None, "string") for c in columns} | (defaults or {})
    return default_missing_columns(raw, values)


def read_trips_csv(spark: SparkSession, paths, names: dict[str, str] | None = None) -> DataFrame:
    """Trips from CSV files with a header; ``names`` maps header names to ours.

    Never infers a schema: every field is read as text and typed here.  The
    service date is parsed strictly (a bad date fails the job), times of day
    leniently (a bad time becomes NULL), line numbers stay text so leading
    zeros survive.  Files without the productive / trip-type fields get true /
    1; other optional fields they lack are NULL.
    """
    raw = _with_all(_csv_by_name(spark, paths, TRIP_CSV_COLUMNS, TRIP_CSV_REQUIRED, names),
                    TRIP_CSV_COLUMNS, TRIP_CSV_DEFAULTS)
    return raw.select(
        F.col("trip_id").cast("bigint").alias("trip_id"),
        strict_date("service_date").alias("service_date"),
        F.col("line"),
        F.col("direction"),
        F.col("vehicle_no"),
        F.col("driver_id"),
        lenient_time_seconds("start_time").alias("start_sec"),
        lenient_time_seconds("end_time").alias("end_sec"),
        lenient_time_seconds("planned_start").alias("planned_start_sec"),
        lenient_time_seconds("planned_end").alias("planned_end_sec"),
        F.col("delay_min").cast("int").alias("delay_min"),
        F.col("km").cast("decimal(12,2)").alias("km"),
        F.col("boardings").cast("int").alias("boardings"),
        F.col("occupancy_pct").cast("decimal(5,2)").alias("occupancy_pct"),
        F.col("energy_kwh").cast("decimal(8,2)").alias("energy_kwh"),
        F.col("status"),
        F.coalesce(F.col("productive").cast("boolean"), F.lit(True)).alias("productive"),
        F.coalesce(F.col("trip_type").cast("smallint"), F.lit(1).cast("smallint")).alias("trip_type"),
    )


def read_tickets_csv(spark: SparkSession, paths, names: dict[str, str] | None = None) -> DataFrame:
    """Tickets from CSV files with a header: trip ids and amounts parsed
    leniently (bad value -> NULL), the validation time strictly (a bad
    timestamp fails the job)."""
    raw = _with_all(_csv_by_name(spark, paths, TICKET_CSV_COLUMNS, TICKET_CSV_REQUIRED, names), TICKET_CSV_COLUMNS)
    return raw.select(
        lenient_cast(F.col("trip_id"), "bigint").alias("trip_id"),
        F.to_timestamp_ntz(F.col("validated_at"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("validated_at"),
        F.col("fare_type"),
        lenient_cast(F.col("amount_eur"), "decimal(12,2)").alias("amount_eur"),
        F.col("payment_method"),
        F.col("stop"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
