"""As-of and interval joins as windows over tagged unions: sorted once per key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], forward: bool = False, strict: bool = False, max_days: int | None = None, parts: int | None = None) -> DataFrame:
    """Every left row with the last right row at or before it (forward: the first at or after it).

    strict leaves out equal times; max_days makes older matches null. Left rows
    without a match get nulls. Right rows of equal key and time: the greatest values win.
    `parts`: how many parts the keys are dealt into; without it Spark merges parts by their compressed size.
    """
    l = left.select("*", F.col(left_on).alias("_t"), F.lit(1).alias("_left"))
    r = right.select(*by, F.col(right_on).alias("_t"), F.struct(F.col(right_on).alias("_rt"), *values).alias("_m"), F.lit(0).alias("_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    both = both if parts is None else both.repartition(parts, *by)
    # on equal times the right side comes first, unless equal times don't count
    side = F.col("_left").desc() if strict else F.col("_left").asc()
    w = Window.partitionBy(*by).orderBy(F.col("_t").desc() if forward else F.col("_t").asc(), side, "_m").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_left = 1")
    ok = F.lit(True) if max_days is None else F.abs(F.datediff(F.col("_t"), F.col("_m._rt"))) <= max_days
    return out.select(*left.columns, F.when(ok, F.col("_m._rt")).alias("matched_on"), *(F.when(ok, F.col(f"_m.{v}")).alias(v) for v in values))


def align_ffill(series: DataFrame, calendar: DataFrame, value: str, date: str = "date", by: list[str] | None = None) -> DataFrame:
    """The series carried forward onto the dates of a calendar."""
    by = by or []
    keys = series.select(*by).distinct() if by else None
    grid = calendar.select(date) if keys is None else calendar.select(date).join(F.broadcast(keys), how="cross")  # keys: a bounded set of series
    return asof(grid, series, by or [], date, date, [value]) if by else _align_one(series, grid, value, date)


def _align_one(series: DataFrame, grid: DataFrame, value: str, date: str) -> DataFrame:
    one = F.lit(0).alias("_k")
    return asof(grid.select("*", one), series.select(date, value, one), ["_k"], date, date, [value]).drop("_k")
