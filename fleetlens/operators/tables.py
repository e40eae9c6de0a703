"""Sinks and table maintenance: append, append once, full refresh, upsert,
materialisation, schema evolution, cascading delete, load audit, physical
layout and report outputs.

Tables that are replaced or changed live under a manifest (``manifest``): a
refresh, an upsert or a checked load becomes visible in one step, and readers
(``read_stored``) see the old or the new table, never a mixture.
"""

from __future__ import annotations

import datetime as _dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.manifest import Manifest
from fleetlens.schemas import TRIP_EVOLUTION
from fleetlens.session import checkpoint_root


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows by column name (new files next to the existing ones)."""
    df.write.mode("append").format(fmt).save(path)


#: The table of a root that holds one only.
TABLE = "table"


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table that the writers below keep at ``path``."""
    return Manifest(spark, path).read(TABLE)


def exists(spark: SparkSession, path: str) -> bool:
    return TABLE in Manifest(spark, path).version().tables


def overwrite(df: DataFrame, path: str) -> None:
    """Full refresh in one step: readers see the old contents until the new
    ones are complete.  A failed or stopped write changes nothing, and two
    writers never use one folder."""
    Manifest(df.sparkSession, path).update(lambda t: t.overwrite(TABLE, df))


def append_once(df: DataFrame, path: str, load_id: str, rules: dict[str, Column] | None = None, limit: int = 0) -> bool:
    """Append a load under an id: a repeated or restarted load adds nothing a
    second time (False), and other content under a used id is an error.  Rows
    that break one of ``rules`` (name -> violating condition) more than
    ``limit`` times reject the load; they are counted while it is written."""
    added = []
    Manifest(df.sparkSession, path).update(lambda t: added.append(t.append(TABLE, df, load_id, rules, limit)))
    return added[-1]


def split_null_keys(df: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(rows with all keys, rows with a NULL key).  A NULL key matches nothing,
    so those rows need no shuffle, and however many there are they cannot meet
    in one task of a join."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.where(known), df.where(~known)


def check_unique(df: DataFrame, keys) -> None:
    """Fail if two rows have the same key (as ON CONFLICT does)."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"incoming rows repeat the key {list(keys)}: {[tuple(r)[:-1] for r in twice]}")


def upsert(existing: DataFrame, incoming: DataFrame, keys, check: bool = True) -> DataFrame:
    """Insert new keys, replace every non-key column of existing keys.

    ``existing`` rows whose key arrives again are removed by an anti join on
    the keys (shuffle by key on both sides), then the incoming rows are
    appended by name.  Incoming rows that repeat a key are an error; ``check``
    = False leaves that test to the caller.
    """
    if check:
        check_unique(incoming, keys)
    with_key, without = split_null_keys(existing, keys)
    keep = with_key.join(incoming.select(*keys), list(keys), "left_anti")
    return keep.unionByName(without).unionByName(incoming.select(*existing.columns))


def upsert_table(incoming: DataFrame, path: str, keys, partition_col: str, derived: Column | None = None) -> None:
    """On-disk upsert of a table partitioned by ``partition_col``; a missing
    table is created.

    Only partitions that change are read and written anew, and all of them
    change in one step.  With ``derived`` (the partition as a function of the
    keys) those are the incoming rows' partitions; without it the stored keys
    are looked up first, so that a key which moves to another partition leaves
    its old one.  A repeated call gives the same table.
    """
    Manifest(incoming.sparkSession, path).update(lambda t: t.upsert(TABLE, incoming, list(keys), partition_col, derived))


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Persist a query result as a table (optionally partitioned) and return
    a DataFrame reading it back with the original schema."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def add_columns_if_missing(df: DataFrame, spec=TRIP_EVOLUTION) -> DataFrame:
    """Schema evolution: add each missing (name, type, default) column; rows
    get the default (NULL when none).  Existing columns are left alone."""
    out = df
    for name, dtype, default in spec:
        if name not in df.columns:
            out = out.withColumn(name, F.lit(default).cast(dtype))
    return out


def default_missing_columns(df: DataFrame, values) -> DataFrame:
    """Set a constant for each column the input lacks: ``values`` maps
    name -> (value, type)."""
    out = df
    for name, (value, dtype) in values.items():
        if name not in df.columns:
            out = out.withColumn(name, F.lit(value).cast(dtype))
    return out


def cascade_delete(parent: DataFrame, child: DataFrame, pred, key: str):
    """Delete parents matching ``pred`` and, with them, their children.
    Returns (remaining parents, remaining children)."""
    doomed = parent.where(pred).select(key)
    with_key, without = split_null_keys(child, [key])
    rest = with_key.join(doomed, key, "left_anti").select(*child.columns).unionByName(without)
    return parent.where(~F.coalesce(pred, F.lit(False))), rest


def load_audit(tables: dict) -> DataFrame:
    """Rows loaded per table and day with the running total per table.

    ``tables`` maps name -> (DataFrame, day column expression).  Each table is
    reduced to one row per day first; the running sum is a window over those
    per-day rows, partitioned by table.
    """
    parts = None
    for name, (df, day) in tables.items():
        one = df.groupBy(day.alias("load_date")).agg(F.count(F.lit(1)).alias("rows_loaded"))
        one = one.select(F.lit(name).alias("table_name"), "load_date", "rows_loaded")
        parts = one if parts is None else parts.unionByName(one)
    w = Window.partitionBy("table_name").orderBy("load_date").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("cumulative_rows", F.sum("rows_loaded").over(w))


def write_clustered(df: DataFrame, path: str, partition_col: str = "service_date",
                    cluster_col: str = "line") -> None:
    """Physical layout of the trip table: one directory per ``partition_col``
    value (date filters prune directories) and rows sorted by ``cluster_col``
    inside each file (min/max statistics let line filters skip row groups).
    Rows are rebalanced by the partition value: each value goes to few
    writers, and AQE splits a hot value (one day with a third of all trips)
    over several tasks instead of one."""
    (df.hint("rebalance", partition_col).sortWithinPartitions(partition_col, cluster_col)
     .write.mode("errorifexists").partitionBy(partition_col).parquet(path))


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "trip_id",
                   buckets: int | None = None) -> None:
    """Bucketed table by ``key`` at an explicit shared path: later joins of
    two tables bucketed the same way on ``key`` need no shuffle.  The bucket
    count defaults to the session's shuffle width, which is sized to the data
    on a cluster; tables that are joined must use the same count."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.write.mode("errorifexists").format("parquet").bucketBy(n, key).sortBy(key)
     .option("path", path).saveAsTable(table))


def write_report(frames: dict, out: str, run_ts: _dt.datetime, kind: str, fmt: str = "parquet",
                 tz: str = "Europe/Berlin") -> DataFrame:
    """Persist each report dataset under ``<out>/<kind>_<YYYY-MM-DD_HH-MM>/<name>``
    as Parquet, CSV (with header) or JSON, and return (dataset, path,
    row_count) counted from what was written.  ``run_ts`` is UTC; the stamp is
    the wall clock of ``tz``."""
    stamp = run_ts.replace(tzinfo=_dt.timezone.utc).astimezone(ZoneInfo(tz)).strftime("%Y-%m-%d_%H-%M")
    base = f"{out.rstrip('/')}/{kind}_{stamp}"
    parts = None
    for name, df in frames.items():
        path = f"{base}/{name}"
        df.write.mode("errorifexists").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
        reader = df.sparkSession.read.schema(df.schema).format(fmt).options(**({"header": True} if fmt == "csv" else {}))
        one = (reader.load(path).agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("dataset"), F.lit(path).alias("path"), "row_count"))
        parts = one if parts is None else parts.unionByName(one)
    return parts
