"""Run registered queries against their DuckDB oracle SQL and compare.

Comparison is order-insensitive: columns sorted by name, rows normalised
(floats to 9 significant decimals, decimals by value) and sorted.  Types are
compared by family (Spark DecimalType(p,s) against DuckDB DECIMAL(p,s) ...).
Used by the tests and by ``check.py`` at the repository root.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import time

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return f"f:{float(f'{v:.9g}')!r}"
    if isinstance(v, decimal.Decimal):
        return f"d:{v.normalize()}" if v != 0 else "d:0"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, (_dt.datetime, _dt.date)):
        return f"t:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return f"s:{v}"


def _spark_family(dt) -> str:
    name = dt.simpleString()
    return {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE",
            "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
            "float": "FLOAT"}.get(name, name.upper())


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, key, build, sql, sf_dir):
    t0 = time.time()
    df = build(spark, sf_dir)
    s_cols = df.columns
    s_types = [_spark_family(f.dataType) for f in df.schema.fields]
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    out = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 3)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_types = [str(d[1]) for d in rel.description]
    d_rows = rel.fetchall()
    out["duck_sec"] = round(time.time() - t1, 3)
    out["duck_rows"] = len(d_rows)
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    else:
        st = dict(zip(s_cols, s_types))
        dt = dict(zip(d_cols, d_types))
        tm = [f"{c}: {st[c]} vs {dt[c]}" for c in s_cols if st[c].replace(" ", "") != dt[c].replace(" ", "")]
        if tm:
            out["type_mismatch"] = tm
        if canonical_rows(s_cols, s_rows) != canonical_rows(d_cols, d_rows):
            a = set(canonical_rows(s_cols, s_rows))
            b = set(canonical_rows(d_cols, d_rows))
            problems.append(f"values differ: spark-only {sorted(a - b)[:3]} duck-only {sorted(b - a)[:3]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    out["status"] = "ok" if not problems and "type_mismatch" not in out else "FAIL"
    if problems:
        out["problems"] = problems
    return out
