"""Property checks: the exact rounding of Spark measures and of the oracle's
integer formula against Python Decimal, and hot-key inputs (one key with a
third of all rows) through the skew-sensitive operators."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
from pyspark.sql import functions as F

from fleetlens.functions.measures import rounded_ratio
from fleetlens.operators import aggregates as agg
from fleetlens.plans.oracle_sql import rnd


def _cases(n=3000, seed=7):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        den = rng.choice([1, 2, 3, 4, 6, 7, 8, 40, 99, 400, 10 ** 6 + 3])
        num = rng.randint(-10 ** 9, 10 ** 9)
        if rng.random() < 0.3:          # force exact half-way cases
            num = (2 * rng.randint(-10 ** 6, 10 ** 6) + 1) * den // 2 if den % 2 == 0 else num
        out.append((num, den))
    return out


def _expected(num, den, digits, scale):
    q = Decimal(num) / (Decimal(den) * (Decimal(10) ** scale))
    return float(q.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def test_spark_rounding_is_half_away_from_zero(spark):
    cases = _cases()
    df = spark.createDataFrame(cases, "num bigint, den bigint")
    got = df.select("num", "den", rounded_ratio(F.col("num").cast("decimal(20,0)") / 100, F.col("den"), 2)
                    .alias("r")).collect()
    bad = [(r.num, r.den, r.r) for r in got if r.r != _expected(r.num, r.den, 2, 2)]
    assert bad == []


def test_oracle_integer_rounding_matches(spark):
    cases = _cases()
    con = duckdb.connect()
    con.execute("CREATE TABLE c (num BIGINT, den BIGINT)")
    con.executemany("INSERT INTO c VALUES (?, ?)", cases)
    rows = con.execute(f"SELECT num, den, {rnd('num', 'den', 2, 2)} FROM c").fetchall()
    bad = [(n, d, r) for n, d, r in rows if r != _expected(n, d, 2, 2)]
    assert bad == []


def test_hot_trip_key(spark):
    """One trip holds a third of all tickets; results stay exact and whole."""
    n = 30000
    tickets = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).cast("bigint").alias("trip_id"),
        F.lit(None).cast("timestamp_ntz").alias("validated_at"),
        F.lit("A").alias("fare_type"),
        (F.lit(1.25).cast("decimal(12,2)")).alias("amount_eur"),
        F.lit("Bar").alias("payment_method"),
        F.lit("H").alias("stop"))
    trips = spark.range(0, n).select(
        F.col("id").cast("bigint").alias("trip_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("service_date"),
        F.lit("1").alias("line"), F.lit("Hin").alias("direction"), F.lit(1).cast("bigint").alias("bus_id"),
        F.lit("B").alias("vehicle_no"), F.lit("F").alias("driver_id"), F.lit(100).alias("start_sec"),
        F.lit(2).alias("delay_min"), F.lit(1).cast("decimal(12,2)").alias("km"), F.lit(3).alias("boardings"),
        F.lit(50).cast("decimal(5,2)").alias("occupancy_pct"), F.lit(1).cast("decimal(8,2)").alias("energy_kwh"),
        F.lit("planmäßig").alias("status"))
    daily = agg.daily_kpi(trips, tickets)
    total = daily.agg(F.sum("total_revenue")).first()[0]
    assert total == Decimal("1.25") * n
    hot_day = daily.where(F.col("service_date") == F.lit("2024-01-02").cast("date")).first()
    # day 2 = trip 1 (10,001 tickets) + 9,999 other trips with one ticket each
    assert hot_day.total_revenue == Decimal("1.25") * (10001 + 9999)
    from fleetlens.operators.joins import with_revenue
    hot = with_revenue(trips, tickets).where(F.col("trip_id") == 1).first()
    assert hot.revenue == Decimal("1.25") * 10001
