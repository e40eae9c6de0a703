"""Compare every registered query with its DuckDB oracle.

usage: python check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import json
import sys

from fleetlens.plans.check import compare, duck_connect
from fleetlens.plans.registry import registry
from fleetlens.session import build_session


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = build_session()
    con = duck_connect(sf_dir)
    reg = registry()
    bad = 0
    for key, q in reg.items():
        if keys and key not in keys:
            continue
        try:
            res = compare(spark, con, key, q.build, q.oracle, sf_dir)
        except Exception as e:  # report and continue with the next key
            res = {"key": key, "status": "ERROR", "error": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += res["status"] in ("FAIL", "ERROR")
        print(json.dumps(res, ensure_ascii=False), flush=True)
    print(json.dumps({"total": len(keys) or len(reg), "bad": bad}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
