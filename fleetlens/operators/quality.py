"""Data-quality operators: the constraints a relational store would enforce.

Spark does not enforce keys, so each constraint becomes a query that returns
the violations (or their counts); none of them stops the job.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.measures import count_if
from fleetlens.operators.joins import orphans as _orphans
from fleetlens.schemas import REPORT_PERIODS


def _stack(df_one_row: DataFrame, pairs, name_col: str, value_col: str) -> DataFrame:
    """One wide row -> one row per (name, value) via ``stack`` (no union)."""
    args = ", ".join(f"'{n}', `{c}`" for n, c in pairs)
    return df_one_row.selectExpr(f"stack({len(pairs)}, {args}) AS (`{name_col}`, `{value_col}`)")


def duplicates(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count"))
            .where(F.col("dup_count") > 1))


def key_violations(checks) -> DataFrame:
    """Repeated values of each key as (key_name, key_value text, dup_count);
    ``checks`` = (name, frame, column).  NULL keys are not compared."""
    out = None
    for name, df, col in checks:
        one = (duplicates(df.where(F.col(col).isNotNull()), [col])
               .select(F.lit(name).alias("key_name"), F.col(col).cast("string").alias("key_value"), "dup_count"))
        out = one if out is None else out.unionByName(one)
    return out


def null_counts(df: DataFrame, cols) -> DataFrame:
    """NULL count per column (one aggregate pass), one row per column."""
    wide = df.agg(*[count_if(F.col(c).isNull()).cast("bigint").alias(f"_n{i}") for i, c in enumerate(cols)])
    return _stack(wide, [(c, f"_n{i}") for i, c in enumerate(cols)], "column_name", "null_count")


def orphan_counts(checks) -> DataFrame:
    """Orphan count per foreign key; ``checks`` = (name, child, parent, key).

    Each check is an anti join reduced to one count; the counts are stacked
    from a single row (the counts come back through one tiny union).
    """
    parts = [_orphans(child, parent, key).agg(F.count(F.lit(1)).alias("orphan_count"))
             .select(F.lit(name).alias("fk_name"), "orphan_count")
             for name, child, parent, key in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def domain_violations(df: DataFrame, limits) -> DataFrame:
    """Length and precision violations: VARCHAR(n) longer than n characters,
    NUMERIC(p,s) whose absolute value needs more than p-s integer digits.
    ``limits`` maps column -> ("varchar", n) or ("numeric", (p, s))."""
    aggs, pairs = [], []
    for i, (col, (kind, arg)) in enumerate(limits.items()):
        if kind == "varchar":
            cond = F.char_length(F.col(col)) > arg
            rule = f"varchar({arg})"
        else:
            p, s = arg
            cond = F.abs(F.col(col)) >= F.lit(10 ** (p - s))
            rule = f"numeric({p},{s})"
        aggs.append(count_if(cond).cast("bigint").alias(f"_v{i}"))
        pairs.append((f"{col} {rule}", f"_v{i}"))
    return _stack(df.agg(*aggs), pairs, "rule", "violation_count")


def fill_defaults(df: DataFrame, defaults) -> DataFrame:
    """DEFAULT values: NULL -> default; a column the frame lacks is added."""
    out = df
    for col, value in defaults.items():
        if col in df.columns:
            out = out.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
        else:
            out = out.withColumn(col, F.lit(value))
    return out


def coercion_losses(raw: DataFrame, conversions) -> DataFrame:
    """Values lenient parsing turned into NULL, per column.

    ``conversions`` maps output name -> (raw column, typed expression).
    """
    aggs, pairs = [], []
    for i, (name, (raw_col, typed)) in enumerate(conversions.items()):
        aggs.append(count_if(F.col(raw_col).isNotNull() & typed.isNull()).cast("bigint").alias(f"_l{i}"))
        pairs.append((name, f"_l{i}"))
    return _stack(raw.agg(*aggs), pairs, "column_name", "lost_count")


PERIOD_PATTERN = "^(" + "|".join(re.escape(p) for p in REPORT_PERIODS) + ")$"


def valid_period(df: DataFrame, col: str, name: str = "is_valid") -> DataFrame:
    """Flag report-period values that are not daily/weekly/monthly."""
    return df.withColumn(name, F.coalesce(F.col(col).rlike(PERIOD_PATTERN), F.lit(False)))


def check_period(period: str) -> str:
    """Driver-side validation of a single report-type parameter."""
    if period not in REPORT_PERIODS:
        raise ValueError(f"report type must be one of {REPORT_PERIODS}, got {period!r}")
    return period
