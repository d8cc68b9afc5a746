"""All registered queries and the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans.base import ORACLES, QUERIES

for _name in ("series", "aggregates", "joins", "composites", "portfolio", "strategies", "evidence", "ingest", "streams", "models"):
    import_module(f"tapewright.plans.{_name}")

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return metrics of every symbol's monthly series (books need more names a month than the smallest tables have)."""
    return QUERIES["agg_metrics"](spark, sf_dir)
