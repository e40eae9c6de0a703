"""Projections and filters (all pushed into the scan stage by Catalyst)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.schemas import MAINTENANCE_STATUS_OVERDUE, TRIP_STATUS_CANCELLED


def select_as(df: DataFrame, mapping) -> DataFrame:
    """Select and rename: ``mapping`` is a sequence of (column, display name)."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping])


def rename_positional(df: DataFrame, names) -> DataFrame:
    """Rename all columns by position (the number of names must match)."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def overdue(maintenance: DataFrame, as_of: _dt.date) -> DataFrame:
    """Overdue maintenance: status says so OR the due date lies before ``as_of``.

    SQL three-valued OR: a NULL due date with another status is not overdue.
    """
    cond = (F.col("status") == MAINTENANCE_STATUS_OVERDUE) | (F.col("next_due") < F.lit(as_of))
    return maintenance.where(cond)


def since(df: DataFrame, col: str, as_of: _dt.date, days: int) -> DataFrame:
    """Rows with ``col >= as_of - days`` (inclusive, no upper bound).

    A literal bound on a date column: pushed to Parquet and used for
    partition pruning when the table is partitioned by that date.
    """
    return df.where(F.col(col) >= F.lit(as_of - _dt.timedelta(days=days)))


def active_only(trip: DataFrame, cancelled: str = TRIP_STATUS_CANCELLED) -> DataFrame:
    """Drop cancelled trips; a NULL status is kept."""
    return trip.where(~F.col("status").eqNullSafe(cancelled))
