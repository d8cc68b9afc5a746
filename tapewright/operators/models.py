"""Small linear and boosted models. Moments are aggregated by Spark; only aggregated rows reach a solver."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def moments(y: str, xs: list[str], over=None) -> dict:
    """Sums of the normal equations (with an intercept), as aggregates or over a window."""
    cols = [F.lit(1.0), *(F.col(x) for x in xs)]
    agg = lambda c: F.sum(c) if over is None else F.sum(c).over(over)
    k = len(cols)
    out = {f"a{i}_{j}": agg(cols[i] * cols[j]) for i in range(k) for j in range(i, k)}
    out |= {f"b{i}": agg(cols[i] * F.col(y)) for i in range(k)}
    return out | {"yy": agg(F.col(y) * F.col(y))}


def solved(rows: DataFrame, keys: list[str], xs: list[str], ridge: float = 0.0) -> DataFrame:
    """Coefficients and t-statistics of each row of moments."""
    k = len(xs) + 1
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), *(f"beta_{x} double, t_{x} double" for x in xs), "alpha double"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = pdf[f"a{i}_{j}"]
            b = pdf[[f"b{i}" for i in range(k)]].to_numpy()
            n, penalty = a[:, 0, 0], np.diag([0.0] + [ridge] * (k - 1))
            inverse = np.linalg.pinv(a + penalty)
            w = np.einsum("nij,nj->ni", inverse, b)
            rss = pdf["yy"].to_numpy() - np.einsum("ni,ni->n", w, b)
            se = np.sqrt(np.maximum(rss / np.maximum(n - k, 1), 0)[:, None] * np.diagonal(inverse, axis1=1, axis2=2))
            out = pdf[[f.name for f in fields]].copy()
            for i, x in enumerate(xs, 1):
                out[f"beta_{x}"], out[f"t_{x}"] = w[:, i], np.divide(w[:, i], se[:, i], out=np.full(len(w), np.nan), where=se[:, i] > 0)
            out["alpha"] = w[:, 0]
            yield out

    return rows.mapInPandas(solve, schema)


def rolling_ols(series: DataFrame, key: str, y: str, xs: list[str], n: int = 252, least: int = 150, date: str = "date") -> DataFrame:
    """Regression over the last n rows of each key, at the last row of each month; at least `least` complete rows."""
    whole = series.dropna(subset=[y, *xs])
    w = Window.partitionBy(key).orderBy(date).rowsBetween(-(n - 1), 0)
    m = whole.withColumns(moments(y, xs, w))
    last = F.row_number().over(Window.partitionBy(key, F.trunc(date, "MM")).orderBy(F.desc(date)))
    return solved(m.withColumn("_k", last).where((F.col("_k") == 1) & (F.col("a0_0") >= least)), [key, date], xs)


def cpcv_ridge(panel: DataFrame, roles: DataFrame, xs: list[str], y: str, ridge: float = 10.0, date: str = "rebal_date") -> DataFrame:
    """Per path: ridge on the standardised train rows, then mean label of the top decile of scores over the test rows."""
    rows = panel.dropna(subset=[y, *xs]).join(F.broadcast(roles), date)
    train = rows.where("role = 'train'")
    scale = train.groupBy("g1", "g2").agg(*(F.avg(x).alias(f"m_{x}") for x in xs), *(F.stddev_samp(x).alias(f"s_{x}") for x in xs))
    z = rows.join(F.broadcast(scale), ["g1", "g2"]).withColumns({x: F.coalesce(F.try_divide(F.col(x) - F.col(f"m_{x}"), F.col(f"s_{x}")), F.lit(0.0)) for x in xs})
    fit = solved(z.where("role = 'train'").groupBy("g1", "g2").agg(*(c.alias(n) for n, c in moments(y, xs).items())), ["g1", "g2"], xs, ridge)
    test = z.where("role = 'test'").join(F.broadcast(fit), ["g1", "g2"])  # a row per path
    score = sum((F.col(x) * F.col(f"beta_{x}") for x in xs), F.col("alpha"))
    test = test.withColumn("score", score).withColumn("_q", F.percent_rank().over(Window.partitionBy("g1", "g2", date).orderBy("score")))
    top = test.where("_q >= 0.9").groupBy("g1", "g2", date).agg(F.avg(y).alias("ret"))
    return top.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("months"), (F.avg("ret") / F.stddev_samp("ret") * 12**0.5).alias("sharpe"))


#: Dates of a walk-forward: a calendar of months or days.
MOST_DATES = 100_000
#: Folds that are fitted at the same time: a fit is a long row of short jobs, which leave cores free.
FOLDS_AT_ONCE = 4
#: The ranker's boosting: so many trees of at most 32 leaves, each learnt from four fifths of the rows and added by little.
BOOSTING = {"maxIter": 250, "stepSize": 0.03, "maxDepth": 5, "subsamplingRate": 0.8, "minInstancesPerNode": 50}


def walkforward_gbt(panel: DataFrame, xs: list[str], y: str, first: int = 36, step: int = 12, embargo: int = 1, date: str = "rebal_date") -> DataFrame:
    """Expanding-window boosted trees: each fold learns from all earlier dates but the embargo and scores the next `step`.

    `learned_until` is the last date that a score's model has seen.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    # every fold and every pass of its fit reads the rows: they are made once
    rows = Scratch(panel.sparkSession).written(panel.dropna(subset=[y, *xs]).select(date, "symbol", *xs, y), "labelled")
    dates = rows.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)) - 1)
    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(rows)
    n, out = dates.count(), None
    at = {i: d for i, d in dates.select("_i", date).collect()} if n <= MOST_DATES else {}  # a row per date
    if n > MOST_DATES:
        raise ValueError(f"{n} dates: fold borders are kept for at most {MOST_DATES}")
    parts = panel.sparkSession.sparkContext.defaultParallelism

    def fold(start: int) -> DataFrame:
        until = start - embargo - 1
        # in one order, however the table's files lie: sums and the sample that finds the splits depend on it
        seen = rows.where(F.col(date) <= F.lit(at[until])).repartition(parts, "symbol").sortWithinPartitions("symbol", date)
        model = GBTRegressor(labelCol=y, seed=1, **BOOSTING).fit(seen)
        got = model.transform(rows.where(F.col(date).between(F.lit(at[start]), F.lit(at[min(start + step, n) - 1]))))
        return got.select(date, "symbol", F.col("prediction").alias("score"), y, F.lit(at[until]).alias("learned_until"))

    starts = range(first, n, step)  # a bounded number of folds
    if starts:
        with ThreadPool(min(FOLDS_AT_ONCE, len(starts))) as pool:
            for got in pool.map(inheritable_thread_target(panel.sparkSession)(fold), starts, 1):
                out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.where("false").select(date, "symbol", F.lit(0.0).alias("score"), y, F.col(date).alias("learned_until"))
