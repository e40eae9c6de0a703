"""Spark-native fleet analytics: typed ingest, integrity checks, KPI rollups and report datasets."""

__version__ = "0.1.0"
