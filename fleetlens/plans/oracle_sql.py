"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL binds the driver's test tables to the canonical fleet tables with
CTEs (same derivation rules as ``fleetlens.sources.bindings``) and computes
each result with plain SQL.  Rounded averages are computed in integers here
(DuckDB divides DECIMALs in DOUBLE and misrounds half-way cases): for a
value ``N / D`` rounded half away from zero, ``sign(N) * ((2|N| + D) // 2D)``.
"""

from __future__ import annotations

BINDINGS = {
    "trip": """
SELECT CAST(o_orderkey AS BIGINT) AS trip_id,
       CAST(o_orderdate AS DATE) AS service_date,
       CAST(100 + o_custkey % 40 AS VARCHAR) AS line,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Hin' ELSE 'Rück' END AS direction,
       CAST(CASE WHEN o_orderkey % 20 = 0 THEN -o_custkey ELSE o_custkey END AS BIGINT) AS bus_id,
       concat('B-', CAST(o_custkey AS VARCHAR)) AS vehicle_no,
       concat('F', CAST(o_orderkey % 97 AS VARCHAR)) AS driver_id,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 86400 AS INT) END AS start_sec,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 18 - 2 AS INT) END AS delay_min,
       CAST(o_totalprice AS DECIMAL(12,2)) AS km,
       CAST(o_orderkey % 90 AS INT) AS boardings,
       CAST(CAST((o_orderkey * 13) % 10001 AS DECIMAL(10,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)) AS occupancy_pct,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 900 AS DECIMAL(8,2)) END AS energy_kwh,
       CASE o_orderstatus WHEN 'F' THEN 'planmäßig' WHEN 'O' THEN 'verspätet' ELSE 'ausgefallen' END AS status
FROM orders""",
    "ticket": """
SELECT CAST(l_orderkey AS BIGINT) AS trip_id,
       l_shipdate AS validated_at,
       concat(l_returnflag, l_linestatus) AS fare_type,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS amount_eur,
       CASE l_linenumber % 4 WHEN 0 THEN 'Bar' WHEN 1 THEN 'eTicket' WHEN 2 THEN 'Handy' ELSE 'Karte' END AS payment_method,
       concat('H', CAST(l_suppkey AS VARCHAR)) AS stop
FROM lineitem""",
    "bus": """
SELECT CAST(c_custkey AS BIGINT) AS bus_id, c_name AS plate, c_mktsegment AS model,
       CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 100 AS BIGINT) AS odometer_km,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'in_wartung' WHEN 'MACHINERY' THEN 'inaktiv' ELSE 'aktiv' END AS status
FROM customer""",
    "maintenance": """
SELECT CAST(event_id AS BIGINT) AS maintenance_id, CAST(user_id AS BIGINT) AS bus_id,
       CAST(ts AS DATE) AS service_date, event_type AS kind,
       CASE event_type WHEN 'error' THEN 'überfällig' WHEN 'purchase' THEN 'erledigt' ELSE 'geplant' END AS status,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) + INTERVAL 10 DAY AS DATE) END AS next_due
FROM events""",
    "raw_ticket": """
SELECT CASE WHEN l_orderkey % 19 = 0 THEN 'x' WHEN l_orderkey % 7 = 0 THEN concat(CAST(l_orderkey AS VARCHAR), '.0')
            WHEN l_orderkey % 17 = 0 THEN concat(CAST(l_orderkey AS VARCHAR), '.5') ELSE CAST(l_orderkey AS VARCHAR) END AS trip_id_raw,
       CASE WHEN l_partkey % 23 = 0 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS amount_raw,
       CASE WHEN l_partkey % 29 = 0 THEN '25:61:00'
            ELSE concat(lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0'), ':00') END AS time_raw,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS validated_at_raw,
       concat(l_returnflag, l_linestatus) AS fare_type,
       CASE l_linenumber % 4 WHEN 0 THEN 'Bar' WHEN 1 THEN 'eTicket' WHEN 2 THEN 'Handy' ELSE 'Karte' END AS payment_method,
       concat('H', CAST(l_suppkey AS VARCHAR)) AS stop
FROM lineitem""",
    "stray_ticket": "SELECT * REPLACE (CASE WHEN trip_id % 20 = 0 THEN -trip_id ELSE trip_id END AS trip_id) FROM ticket",
}

# Bindings that other bindings depend on.
_DEPENDS = {"stray_ticket": ("ticket",)}

TRIP_AS_OF = "DATE '2001-08-01'"
MAINTENANCE_AS_OF = "DATE '2024-01-20'"


def with_tables(*names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """WITH clause binding the named canonical tables, then ``extra`` CTEs."""
    order: list[str] = []
    for n in names:
        for dep in _DEPENDS.get(n, ()):
            if dep not in order:
                order.append(dep)
        if n not in order:
            order.append(n)
    ctes = [f"{n} AS ({BINDINGS[n]}\n)" for n in order] + [f"{n} AS ({sql}\n)" for n, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n"


def lenient_bigint(col: str) -> str:
    """Text as a whole number, '1.0' included; NULL if it is none."""
    d = f"TRY_CAST({col} AS DECIMAL(38,10))"
    return f"CASE WHEN {d} = floor({d}) THEN TRY_CAST({d} AS BIGINT) END"


def rnd(num: str, den: str, digits: int, scale: int = 0) -> str:
    """SQL for round(num / (den * 10^scale), digits) half away from zero, as DOUBLE.

    ``num`` and ``den`` must be integer expressions.
    """
    n = f"(CAST({num} AS HUGEINT) * {10 ** digits})"
    d = f"(CAST({den} AS HUGEINT) * {10 ** scale})"
    return (f"(CAST(CASE WHEN {d} = 0 THEN NULL ELSE sign({n}) * ((abs({n}) * 2 + {d}) // (2 * {d})) END"
            f" AS DOUBLE) / {10 ** digits})")


def avg2(col: str, digits: int, scale: int = 2) -> str:
    """Exact AVG of a DECIMAL(p,scale) column skipping NULLs."""
    return rnd(f"(SUM({col}) * {10 ** scale})", f"COUNT({col})", digits, scale)


def avg_int(expr: str, digits: int, den: str | None = None) -> str:
    """Exact average of an integer expression (divisor COUNT(expr) unless given)."""
    return rnd(f"SUM({expr})", den or f"COUNT({expr})", digits)


def on_time(digits: int, null_on_time: bool = True, cmp: str = "<= 5", den: str = "COUNT(*)") -> str:
    if null_on_time:
        flag = f"CASE WHEN delay_min IS NULL OR delay_min {cmp} THEN 1 ELSE 0 END"
    else:
        flag = f"CASE WHEN delay_min {cmp} THEN 1 ELSE 0 END"
    return rnd(f"(SUM({flag}) * 100)", den, digits)
