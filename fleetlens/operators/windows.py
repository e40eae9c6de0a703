"""Shares and day-over-day trends.

The only unpartitioned window is the trend over the daily result, whose size
is bounded by the calendar (one row per day); raw trips and tickets never go
through one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.measures import rounded_ratio


def share(counts: DataFrame, value_col: str, digits: int = 2, name: str = "share_pct") -> DataFrame:
    """Percent of the total per row of an already grouped result.

    The total is a scalar subquery (a partial + one-row final aggregate,
    computed once), so the division runs in every partition in parallel with
    no global window and no join, whatever the number of groups.
    """
    total = counts.select(F.sum(value_col)).scalar()
    return counts.withColumn(name, rounded_ratio(F.col(value_col) * 100, total, digits))


TREND_COLUMNS = ("on_time_pct", "total_revenue", "total_boardings")


def trend(daily_kpi: DataFrame, cols=TREND_COLUMNS, latest_only: bool = False) -> DataFrame:
    """Each day against the previous existing day: ``<col>_delta`` columns.

    The first day is compared with itself (delta 0).  With ``latest_only``
    only the two newest days are taken (top-2, no global sort) and the newest
    row is returned.
    """
    src = daily_kpi
    if latest_only:
        src = daily_kpi.orderBy(F.desc("service_date")).limit(2)
    w = Window.orderBy("service_date")
    out = src
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    for c in cols:
        prev = F.lag(c).over(w)
        delta = (F.col(c) - F.coalesce(prev, F.col(c))).cast(types[c])
        out = out.withColumn(f"{c}_delta", delta)
    if latest_only:
        out = out.orderBy(F.desc("service_date")).limit(1)
    return out
