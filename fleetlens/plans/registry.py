"""Registry of named queries: a Spark builder plus (optionally) its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RegisteredQuery:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    note: str = ""


_REGISTRY: dict[str, RegisteredQuery] = {}


def register(key: str, oracle: str | None, note: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def wrap(fn):
        if key in _REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        _REGISTRY[key] = RegisteredQuery(key, fn, oracle, note)
        return fn
    return wrap


def registry() -> dict[str, RegisteredQuery]:
    # Importing the query modules fills the registry.
    from fleetlens.plans import load_queries, queries  # noqa: F401
    return dict(_REGISTRY)
