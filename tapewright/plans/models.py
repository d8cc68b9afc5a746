"""Queries over linear and boosted models."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import rank_pct
from ..operators import books as B
from ..operators import models as M
from ..sources.scratch import Scratch
from .aggregates import G
from .series import PV, SEC, panel, sector_returns


def with_index(t):
    w = Window.orderBy("date")  # a row per market date
    ix = t.index_series.withColumn("mkt", F.col("close") / F.lag("close").over(w) - 1).select("date", "mkt", F.lag("mkt").over(w).alias("lag_mkt"))
    return sector_returns(t).select(F.col("symbol").alias("sector"), "date", "ret").join(F.broadcast(ix), "date")


COV = lambda a, b: f"(sum({a} * {b}) OVER w - sum({a}) OVER w * sum({b}) OVER w / count(*) OVER w)"
G("win_rolling_ols", "bars sector_map index_series", f"""WITH {SEC}, ix AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS x FROM index_series), iy AS (SELECT date, x, lag(x) OVER (ORDER BY date) AS z FROM ix), j AS (SELECT symbol AS sector, date, ret AS y, x, z FROM sr JOIN iy USING (date) WHERE x IS NOT NULL AND z IS NOT NULL),
  c AS (SELECT sector, date, count(*) OVER w AS n, {COV('x', 'x')} AS xx, {COV('z', 'z')} AS zz, {COV('x', 'z')} AS xz, {COV('x', 'y')} AS xy, {COV('z', 'y')} AS zy FROM j WINDOW w AS (PARTITION BY sector ORDER BY date ROWS 251 PRECEDING))
  SELECT sector, date, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS beta_mkt, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS beta_lag_mkt FROM c WHERE n >= 150 QUALIFY row_number() OVER (PARTITION BY sector, date_trunc('month', date) ORDER BY date DESC) = 1""", "beta_mkt beta_lag_mkt",
  lambda t: M.rolling_ols(with_index(t), "sector", "ret", ["mkt", "lag_mkt"]).select("sector", "date", "beta_mkt", "beta_lag_mkt"), 4)
G("cpcv_ridge", PV, None, "", lambda t: M.cpcv_ridge(panel(t), B.cpcv_paths(t.month_ends), ["mom", "prox", "turnover"], "fwd"))
FEATURES = ["mom", "prox", "turnover"]
G("ml_walkforward_gbt", PV, None, "", lambda t: M.walkforward_gbt(panel(t), FEATURES, "fwd"))


def ensemble(t):
    """The out-of-sample scores of the trees, kept as a table, with the mean rank of the signals that are good when high."""
    names = Scratch(t.spark).written(panel(t).select("rebal_date", "symbol", *FEATURES, "fwd"), "panel")  # for the trees and the signals
    scores = Scratch(t.spark).written(M.walkforward_gbt(names, FEATURES, "fwd").select("rebal_date", "symbol", "score"), "tree_scores")
    linear = names.select("rebal_date", "symbol", ((rank_pct("mom", "rebal_date") + rank_pct("prox", "rebal_date")) / 2).alias("score"))
    return B.ensemble_rank(scores, linear)


G("ml_ensemble_rank", PV, None, "", ensemble)
