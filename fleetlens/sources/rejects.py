"""CSV ingest that keeps what it rejects: every line goes either to the typed
rows or to a dead-letter table with its file, the raw line and the reasons, in one
pass over the file and one write.

Lines are read as text, so the raw line is at hand, and split by the CSV functions;
a quoted field cannot hold a line break here.  Header lines and blank lines are no
rows.  Where the plain readers fail the job (a bad date) or leave a NULL (a bad
number), the line is rejected instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.scalars import lenient_cast, lenient_time_seconds
from fleetlens.operators.manifest import Manifest

LINES, ACCEPTED, REJECTED = "lines", "accepted", "rejected"


@dataclass(frozen=True)
class Field:
    """A field of an export: its name there and in the table, how it is typed
    (NULL for a value that is none), and whether it must be there."""

    name: str
    column: str
    typed: Column | None = None   # text as it is by default
    expected: str = "text"
    required: bool = False


def _date(c: str) -> Column:
    return F.expr(f"try_to_date({c}, 'yyyy-MM-dd')")


def ticket_fields() -> list[Field]:
    time = F.expr("try_to_timestamp(validated_at, 'yyyy-MM-dd HH:mm:ss')").cast("timestamp_ntz")
    return [Field("trip_id", "trip_id", lenient_cast(F.col("trip_id"), "bigint"), "whole number"),
            Field("validated_at", "validated_at", time, "time", required=True), Field("fare_type", "fare_type"),
            Field("amount_eur", "amount_eur", lenient_cast(F.col("amount_eur"), "decimal(12,2)"), "amount"),
            Field("payment_method", "payment_method"), Field("stop", "stop")]


def trip_fields() -> list[Field]:
    numbers = {"delay_min": "int", "km": "decimal(12,2)", "boardings": "int", "occupancy_pct": "decimal(5,2)", "energy_kwh": "decimal(8,2)"}
    times = {"start_time": "start_sec", "end_time": "end_sec", "planned_start": "planned_start_sec", "planned_end": "planned_end_sec"}
    return [Field("trip_id", "trip_id", lenient_cast(F.col("trip_id"), "bigint"), "whole number", required=True),
            Field("service_date", "service_date", _date("service_date"), "date", required=True),
            *[Field(c, c) for c in ("line", "direction", "vehicle_no", "driver_id")],
            *[Field(c, to, lenient_time_seconds(c), "time of day") for c, to in times.items()],
            *[Field(c, c, lenient_cast(F.col(c), kind), "number") for c, kind in numbers.items()], Field("status", "status")]


def _lines(spark: SparkSession, path: str, names: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """(file, raw_line, fields) of the lines below ``path``, and the canonical field names."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw_line"))
    first = spark.read.text(path).where("trim(value) != ''").first()
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([*(T.StructField(f"f{i}", T.StringType()) for i in range(len(header))), T.StructField("broken", T.StringType())])
    rows = text.where((F.col("raw_line") != F.lit(first["value"] if first else "")) & (F.trim("raw_line") != ""))
    parsed = F.from_csv("raw_line", schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return rows.withColumn("f", parsed), [names.get(h, h) for h in header]


def classified(spark: SparkSession, paths, fields: list[Field], names: dict[str, str] | None = None) -> DataFrame:
    """The typed columns, file, raw_line, reasons (column, value, reason) and outcome of every line."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        rows, header = _lines(spark, path, names or {})
        missing = [f.name for f in fields if f.required and f.name not in header]
        if missing:
            raise ValueError(f"{path}: missing fields {missing}, header {header}")
        raw = rows.select("file", "raw_line", F.col("f.broken").isNotNull().alias("_broken"),
                          *[(F.col(f"f.f{header.index(f.name)}") if f.name in header else F.lit(None).cast("string")).alias(f.name) for f in fields])
        raw = raw.select("file", "raw_line", "_broken", *[f.name for f in fields],
                         *[(F.col(f.name) if f.typed is None else f.typed).alias(f"_t_{f.column}") for f in fields])

        def reason(f: Field) -> Column:
            bad = F.col(f"_t_{f.column}").isNull() & F.col(f.name).isNotNull()
            none = F.when(F.col(f.name).isNull() & F.lit(f.required), F.lit("missing"))
            text = F.when(bad, F.lit(f"not a {f.expected}")).otherwise(none)
            return F.when(text.isNotNull(), F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("value"), text.alias("reason")))

        shape = F.struct(F.lit(None).cast("string").alias("column"), F.col("raw_line").alias("value"), F.lit("wrong number of fields").alias("reason"))
        reasons = F.when(F.col("_broken"), F.array(shape)).otherwise(F.array_compact(F.array(*[reason(f) for f in fields])))
        one = raw.withColumn("reasons", reasons).select(
            *[F.col(f"_t_{f.column}").alias(f.column) for f in fields], "file", "raw_line", "reasons",
            F.when(F.size("reasons") == 0, F.lit(ACCEPTED)).otherwise(F.lit(REJECTED)).alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out


def load_csv(spark: SparkSession, paths, fields: list[Field], root: str, load_id: str, names: dict[str, str] | None = None) -> bool:
    """Append the lines of an export to the table at ``root``: one read, one
    write, one commit.  A repeated load id adds nothing (False)."""
    done = []

    def step(t) -> None:
        rows = classified(spark, paths, fields, names)
        if not t.has(LINES):
            t.overwrite(LINES, rows.limit(0), "outcome")  # fixes the partition column
        done.append(t.append(LINES, rows, load_id))
        t.touched = done[-1]

    Manifest(spark, root).update(step)
    return done[-1]


def read_accepted(spark: SparkSession, root: str) -> DataFrame:
    """The typed rows; only their folders are read."""
    m = Manifest(spark, root)
    return m.frame(m.version(), LINES, [f"v{ACCEPTED}"]).drop("file", "raw_line", "reasons", "outcome")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """(file, raw_line, column, value, reason): one row for each reason of a rejected line."""
    m = Manifest(spark, root)
    rows = m.frame(m.version(), LINES, [f"v{REJECTED}"])
    return rows.select("file", "raw_line", F.explode("reasons").alias("r")).select("file", "raw_line", "r.*")
