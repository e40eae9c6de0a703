"""Canonical table schemas and the domain values the reports depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These strings must equal the operator application's own
# values (trip/bus/maintenance states, labels, report texts) for results to
# match. Kept here together, in their natural order.
# ---------------------------------------------------------------------------
TRIP_STATUS_ON_SCHEDULE = "planmäßig"
TRIP_STATUS_LATE = "verspätet"
TRIP_STATUS_CANCELLED = "ausgefallen"
DIRECTIONS = ("Hin", "Rück")
BUS_STATUS_ACTIVE = "aktiv"
BUS_STATUS_IN_MAINTENANCE = "in_wartung"
MAINTENANCE_STATUS_PLANNED = "geplant"
MAINTENANCE_STATUS_OVERDUE = "überfällig"
UNKNOWN_PLATE = "Unbekannt"
REPORT_PERIODS = ("daily", "weekly", "monthly")
TARGET_OK = "gut"
TARGET_CRITICAL = "kritisch"
NO_PROBLEM_LINES = "Alle Linien im grünen Bereich."
PROBLEM_LINE_TEMPLATE = "- Linie {line}: {avg} Min Ø Verspätung ({n} Fahrten)"
REPORT_KIND_LABELS = {"weekly": "Wöchentlicher", "monthly": "Monatlicher"}
RECENT_TRIP_DISPLAY = (
    ("service_date", "Datum"),
    ("line", "Linie"),
    ("direction", "Richtung"),
    ("vehicle_no", "Fahrzeug"),
    ("driver_id", "Fahrer"),
    ("delay_min", "Verspätung (min)"),
    ("occupancy_pct", "Auslastung %"),
    ("boardings", "Passagiere"),
    ("status", "Status"),
)
KPI_SERIES_DISPLAY = ("Datum", "Gesamt-km", "Passagiere", "Umsatz (€)",
                      "Ø Auslastung %", "Ø Verspätung min", "Pünktlichkeit %")
DASHBOARD_TILES = ("Fahrten gesamt", "Ø Auslastung", "Ø Verspätung",
                   "Passagiere", "Energie", "Pünktlichkeit")
REPORT_TILES = ("Fahrten gesamt", "Passagiere", "Ø Auslastung",
                "Ø Verspätung min", "Gesamt-km", "Pünktlichkeit")
# Thresholds of the reports: on time means delay <= 5 minutes, the
# punctuality target is 80 %, the delay warning limit 5 minutes.
ON_TIME_THRESHOLD_MIN = 5
PUNCTUALITY_TARGET_PCT = 80
DELAY_LIMIT_MIN = 5
# ---------------------------------------------------------------------------

DECIMAL_SUM = "decimal(22,2)"

TRIP = T.StructType([
    T.StructField("trip_id", T.LongType(), False),
    T.StructField("service_date", T.DateType(), False),
    T.StructField("line", T.StringType(), False),
    T.StructField("direction", T.StringType()),
    T.StructField("bus_id", T.LongType()),
    T.StructField("vehicle_no", T.StringType()),
    T.StructField("driver_id", T.StringType()),
    T.StructField("start_sec", T.IntegerType()),
    T.StructField("delay_min", T.IntegerType()),
    T.StructField("km", T.DecimalType(12, 2)),
    T.StructField("boardings", T.IntegerType()),
    T.StructField("occupancy_pct", T.DecimalType(5, 2)),
    T.StructField("energy_kwh", T.DecimalType(8, 2)),
    T.StructField("status", T.StringType()),
])

TICKET = T.StructType([
    T.StructField("trip_id", T.LongType()),
    T.StructField("validated_at", T.TimestampNTZType(), False),
    T.StructField("fare_type", T.StringType()),
    T.StructField("amount_eur", T.DecimalType(12, 2)),
    T.StructField("payment_method", T.StringType()),
    T.StructField("stop", T.StringType()),
])

# Total order over all ticket columns (tickets have no natural key).
TICKET_ORDER = ("trip_id", "validated_at", "fare_type", "amount_eur",
                "payment_method", "stop")

DAILY_KPI = T.StructType([
    T.StructField("service_date", T.DateType(), False),
    T.StructField("total_km", T.DecimalType(22, 2)),
    T.StructField("total_boardings", T.LongType()),
    T.StructField("total_revenue", T.DecimalType(22, 2)),
    T.StructField("avg_occupancy", T.DoubleType()),
    T.StructField("avg_delay_min", T.DoubleType()),
    T.StructField("on_time_pct", T.DoubleType()),
])

BUS = T.StructType([
    T.StructField("bus_id", T.LongType(), False),
    T.StructField("plate", T.StringType(), False),
    T.StructField("model", T.StringType()),
    T.StructField("odometer_km", T.LongType()),
    T.StructField("status", T.StringType()),
])

MAINTENANCE = T.StructType([
    T.StructField("maintenance_id", T.LongType(), False),
    T.StructField("bus_id", T.LongType()),
    T.StructField("service_date", T.DateType(), False),
    T.StructField("kind", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("next_due", T.DateType()),
])

# Columns added to trips by schema evolution: (name, type, default).
TRIP_EVOLUTION = (
    ("base_version", "int", None),
    ("trip_fid", "int", None),
    ("trip_type", "smallint", None),
    ("productive", "boolean", True),
    ("trip_label", "string", None),
    ("start_stop_no", "int", None),
    ("end_stop_no", "int", None),
)

# Length and precision limits of the trip table (VARCHAR(n), NUMERIC(p,s)).
TRIP_LIMITS = {
    "line": ("varchar", 20),
    "direction": ("varchar", 10),
    "vehicle_no": ("varchar", 20),
    "driver_id": ("varchar", 20),
    "status": ("varchar", 20),
    "km": ("numeric", (8, 2)),
    "occupancy_pct": ("numeric", (5, 2)),
    "energy_kwh": ("numeric", (8, 2)),
}
