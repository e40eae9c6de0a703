"""Ad-hoc SQL over the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a SQL text (planned by Catalyst like the DataFrame API, with the same
    pushdown and pruning).  ``tables`` are views of that names while the text is
    analysed; the session's views are the same afterwards as before."""
    tables = tables or {}
    hidden = {name: spark.table(name) for name in tables if _is_view(spark, name)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in hidden.items():
            df.createOrReplaceTempView(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(t.name == name and t.isTemporary for t in spark.catalog.listTables(pattern=name))
