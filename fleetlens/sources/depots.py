"""Several depot tables combined into one, tagged by depot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_depots(parts: dict, tag: str = "depot") -> DataFrame:
    """UNION ALL by column name; columns missing in a depot become NULL."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no depot given")
    return out
