"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import round_to
from ..sources.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, without negative zero."""
    doubles = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*((round_to(F.col(c), digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns))


def query(key: str, views: str = "", sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a function of the tables as a query; `sql` runs over the named views."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[key] = with_views(views, sql, doubles, digits)
        return f

    return register
