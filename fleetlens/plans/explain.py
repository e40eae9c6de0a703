"""Formatted physical plans of registered queries (for review).

usage: python -m fleetlens.plans.explain [sf_dir] [key ...]  -> markdown on stdout
"""

from __future__ import annotations

import contextlib
import io
import sys

from fleetlens.plans.registry import registry

KEEP_DETAIL = ("ReadSchema", "PushedFilters", "PartitionFilters", "Arguments", "Keys", "Join type",
               "Functions")


def formatted_plan(df) -> str:
    """The operator tree plus the scan/exchange/aggregate details that matter."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    keep = []
    for block in details.split("\n\n"):
        lines = block.strip().splitlines()
        if not lines:
            continue
        head = lines[0]
        picked = [ln for ln in lines[1:] if ln.startswith(KEEP_DETAIL)]
        if picked and any(w in head for w in ("Scan", "Exchange", "HashAggregate", "Join", "Window",
                                              "TakeOrdered", "WindowGroupLimit", "Sort ")):
            keep.append("\n".join([head] + [ln[:220] for ln in picked]))
    return tree.strip() + "\n\n" + "\n\n".join(keep)


def main(argv):
    from fleetlens.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    keys = argv[2:] or list(registry())
    spark = build_session()
    reg = registry()
    for k in keys:
        print(f"### `{k}`\n\n```\n{formatted_plan(reg[k].build(spark, sf_dir))}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
