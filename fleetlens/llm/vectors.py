"""Vector columns as numpy matrices, and merging of small per-task states."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_arrow, materialise, release

#: States merged by one task of a merge level.
FAN_IN = 32


def vector_rows(table: DataFrame) -> DataFrame:
    """vec_id and embedding alone, typed, so that extra columns cannot clash."""
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))


def lengths(column: pa.Array) -> np.ndarray:
    """Entries of each vector, -1 for NULL."""
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)


def dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dim`` finite entries, and those as doubles (rows, dim)."""
    n = lengths(column)
    ok = n == dim
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # NULL entries become NaN
    if ok.all():
        full = values.reshape(-1, dim)
    else:
        start = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
        full = values[start[ok][:, None] + np.arange(dim)]
    finite = np.isfinite(full).all(axis=1)
    if not finite.all():
        ok[ok] = finite
        full = full[finite]
    return ok, full


def state_rows(table: DataFrame, step: Callable, width: str = "embedding") -> DataFrame:
    """One row (part, state) for each task with rows: ``step(state, column)``
    folds a batch of the vector column into an array of doubles, None at first."""
    def run(batches):
        from pyspark import TaskContext
        state = None
        for b in batches:
            state = step(state, b.column(0))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.tolist()], pa.list_(pa.float64()))],
                                             names=["part", "state"])

    return map_arrow(table.select(width), run, "part long, state array<double>")


def merged(rows: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """All states as one, by levels of ``FAN_IN``: no task and not the driver
    meets more than that many.  None when there is no row."""
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("part")
        state = merge([np.array(s) for s in t.column("state").to_pylist()])
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN_IN], pa.int64()), "state": pa.array([state.tolist()], pa.list_(pa.float64()))})

    rows = materialise(rows, "states")
    while rows.count() > 1:
        last = rows
        rows = materialise(last.groupBy((F.col("part") / FAN_IN).cast("long").alias("g")).applyInArrow(run, "part long, state array<double>"), "states")
        release(last)
    found = rows.collect()
    release(rows)
    return np.array(found[0]["state"]) if found else None
