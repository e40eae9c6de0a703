"""Benchmark: every registered query on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no result is
collected to the driver), after one warm-up run of the flagship query.  The
same oracle SQL is timed on DuckDB over the same Parquet files as a
single-node reference.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fleetlens.plans.check import duck_connect
from fleetlens.plans.registry import registry
from fleetlens.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    reg = registry()
    keys = [k for k in reg if not only or k in only]

    t0 = time.time()
    reg["daily_kpi"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    warmup = time.time() - t0

    spark_times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for k in keys:
        t = time.time()
        try:
            reg[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spark_times[k] = round(time.time() - t, 3)
        except Exception as e:  # keep measuring the rest; report the failure
            errors[k] = f"{type(e).__name__}: {str(e)[:200]}"

    duck_times: dict[str, float] = {}
    con = duck_connect(sf_dir)
    for k in keys:
        sql = reg[k].oracle
        if sql is None:
            continue
        t = time.time()
        con.execute(sql).to_arrow_table()  # full materialisation, like the noop sink
        duck_times[k] = round(time.time() - t, 3)
    spark.stop()

    flagship = "daily_kpi"
    out = {
        "metric": "total_sec_all_registered_queries",
        "value": round(sum(spark_times.values()), 3),
        "unit": "sec",
        "queries": spark_times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "n_queries": len(spark_times),
        "flagship": {"key": flagship, "sec": spark_times.get(flagship)},
        "warmup_sec": round(warmup, 3),
        "duckdb_total_sec": round(sum(duck_times.values()), 3),
        "duckdb_queries": duck_times,
        "errors": errors,
    }
    print(json.dumps(out, ensure_ascii=False))


if __name__ == "__main__":
    main()
