"""Aggregate column expressions shared by every KPI block.

All measures are built from SUM/COUNT partial aggregates, so Spark runs them
as partial + final HashAggregate (map-side combine) and one ``agg`` call
computes a whole KPI block in a single pass.

Averages and rates are divided in DECIMAL and rounded half away from zero,
then cast to DOUBLE.  ``avg`` on a DECIMAL would round twice (first to its
result scale, then to the requested digits).  The operand types are chosen so
the quotient keeps 18 decimals without precision loss:
decimal(24,4) / decimal(13,0) -> decimal(38,18).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.schemas import ON_TIME_THRESHOLD_MIN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rounded_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """round(numerator / denominator, digits) exactly; NULL when the divisor is 0."""
    quotient = numerator.cast("decimal(24,4)") / F.nullif(denominator, F.lit(0)).cast("decimal(13,0)")
    return F.round(quotient, digits).cast("double")


def exact_avg(col, digits: int) -> Column:
    """AVG skipping NULLs, exact, rounded to ``digits``."""
    c = _c(col)
    return rounded_ratio(F.sum(c), F.count(c), digits)


def on_time_flag(col, threshold: int = ON_TIME_THRESHOLD_MIN, inclusive: bool = True,
                 null_is_on_time: bool = True) -> Column:
    """Boolean: the trip counts as on time (NULL delay handled by the flag)."""
    c = _c(col)
    within = c <= threshold if inclusive else c < threshold
    return F.when(c.isNull(), F.lit(null_is_on_time)).otherwise(within)


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def on_time_rate(col, threshold: int = ON_TIME_THRESHOLD_MIN, inclusive: bool = True,
                 null_is_on_time: bool = True, digits: int = 1) -> Column:
    """Percent of trips on time out of all trips (COUNT(*))."""
    hits = count_if(on_time_flag(col, threshold, inclusive, null_is_on_time))
    return rounded_ratio(hits * 100, F.count(F.lit(1)), digits)


def avg_delay(col, mode: str = "skip_null", digits: int = 1) -> Column:
    """Average delay.

    ``skip_null``: NULL delays are left out.  ``null_as_zero``: NULL counts
    as 0 and every trip is in the divisor.  ``clamp_early``: early trips
    count as 0, NULL stays out of the sum, divisor is the trip count.
    """
    c = _c(col)
    if mode == "skip_null":
        return exact_avg(c, digits)
    if mode == "null_as_zero":
        return rounded_ratio(F.sum(F.coalesce(c, F.lit(0))), F.count(F.lit(1)), digits)
    if mode == "clamp_early":
        clamped = F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(0)))
        return rounded_ratio(F.sum(clamped), F.count(F.lit(1)), digits)
    raise ValueError(f"unknown delay mode {mode!r}")


def unscaled(col, scale: int = 2) -> Column:
    """A DECIMAL(p, scale) value as its unscaled BIGINT (cents for money)."""
    return (_c(col) * F.lit(10 ** scale)).cast("bigint")


def from_unscaled(total: Column, scale: int = 2, dtype: str = "decimal(22,2)") -> Column:
    """Back from an unscaled BIGINT total to DECIMAL (exact)."""
    if scale == 0:
        return total.cast(dtype)
    step = F.lit("1e-%d" % scale).cast(f"decimal({scale},{scale})")
    return (total.cast("decimal(20,0)") * step).cast(dtype)


def scaled_sum(col, scale: int = 2, dtype: str = "decimal(22,2)") -> Column:
    """Exact SUM of a DECIMAL(p, scale) column computed on unscaled BIGINTs.

    Spark sums DECIMAL(p>8) in BigDecimal objects (one allocation per row);
    summing cents as longs is exact, several times cheaper per row, and raises
    on overflow under ANSI mode (beyond 9.2e16 units) instead of wrapping.
    """
    return from_unscaled(F.sum(unscaled(col, scale)), scale, dtype)


def decimal_sum(col, digits: int = 2, dtype: str = "decimal(22,2)", scale: int = 2) -> Column:
    """ROUND(SUM(x), digits) of a DECIMAL(p, scale) column, as a fixed type."""
    return F.round(scaled_sum(col, scale, "decimal(22,%d)" % scale), digits).cast(dtype)


def long_sum(col) -> Column:
    return F.sum(_c(col)).cast("bigint")
