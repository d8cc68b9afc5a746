"""The monthly feature store and the eight registered strategies over it.

A strategy is a function from the feature panel, one row per rebalance date and
symbol, to (rebal_date, symbol, weight). Weights are 1 / max(vol_3m, 0.05) but for
the reversal's, which are 1; `operators.books.normalized` scales them per date.
Names without the ranked feature or without volatility take no part, and a date
with fewer than ten names gives no signal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import avg_rank, qcut_decile, rank_pct, round_to
from . import series as S
from .rolling import rolled

#: The feature store's columns, in the order of the store.
FEATURES = [
    "ret_1m", "ret_3m", "ret_6m", "ret_12m", "mom_12_1", "mom_6_1", "vol_3m", "vol_6m", "dist_sma50", "dist_sma200", "above_200",
    "prox_52w_high", "amihud", "deliv_1m", "deliv_3m", "deliv_trend", "fwd_ret_1m", "fwd_ret_3m",
]
#: Ranked features of the flagship composite and the sign of each.
COMPOSITE = {"mom_12_1": 1, "prox_52w_high": 1, "deliv_1m": 1, "vol_3m": -1}


def daily_features(bars: DataFrame, delivery: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """All rolling features of every bar, or of those of some dates (date) only; one pass per symbol for shifts and one for rolling columns serves them all."""
    bars = bars.select("symbol", "date", "close", (F.col("close") * F.col("volume")).alias("turnover"))
    shifted = S.forward_labels(S.returns(bars), {"fwd_ret_1m": 21, "fwd_ret_3m": 63})
    shifted = shifted.withColumn("_ill", F.abs("ret_1d") / F.nullif("turnover", F.lit(0.0)))
    means = {"_a50": ("avg", "close", 50, 50), "_a200": ("avg", "close", 200, 200), "_ill21": ("avg", "_ill", 21, 21)}
    spreads = {"_s63": ("stddev", "ret_1d", 63, 63), "_s126": ("stddev", "ret_1d", 126, 126)}
    priced = rolled(shifted, {**means, **spreads, "_high": ("max", "close", 252, 252)}).withColumns({
        "vol_3m": F.col("_s63") * 252**0.5, "vol_6m": F.col("_s126") * 252**0.5, "amihud": F.col("_ill21") * 1e7, "prox_52w_high": F.col("close") / F.col("_high"),
        "dist_sma50": F.col("close") / F.col("_a50") - 1, "dist_sma200": F.col("close") / F.col("_a200") - 1,
        "above_200": F.coalesce(F.col("close") > F.col("_a200"), F.lit(False)).cast("int")})
    delivered = rolled(delivery.select("symbol", "date", "delivery_percent"), {"deliv_1m": ("avg", "delivery_percent", 21, 21), "deliv_3m": ("avg", "delivery_percent", 63, 63)})
    delivered = delivered.select("symbol", "date", "deliv_1m", "deliv_3m", (F.col("deliv_1m") - F.col("deliv_3m")).alias("deliv_trend"))
    if dates is not None:  # a row per month
        priced, delivered = (d.join(F.broadcast(dates), "date", "left_semi") for d in (priced, delivered))
    return priced.join(delivered, ["symbol", "date"], "left").select("symbol", "date", "close", "turnover", *FEATURES)


def monthly_features(daily: DataFrame, universe: DataFrame) -> DataFrame:
    """Daily features sampled at the universe's (rebal_date, symbol); its other columns are kept."""
    return daily.withColumnRenamed("date", "rebal_date").join(universe, ["rebal_date", "symbol"])


def mean_rank(panel: DataFrame, signs: dict[str, int], out: str = "composite") -> DataFrame:
    """Mean of the percentile ranks that a name has; null if it has none."""
    signed = panel.withColumns({f"_s{i}": F.col(c) * s for i, (c, s) in enumerate(signs.items())})
    ranked = signed.withColumns({f"_r{i}": rank_pct(f"_s{i}", "rebal_date") for i in range(len(signs))})
    ranks = [F.col(f"_r{i}") for i in range(len(signs))]
    total, held = F.lit(0.0), F.lit(0)
    for r in ranks:
        total, held = total + F.coalesce(r, F.lit(0.0)), held + r.isNotNull().cast("int")
    made = ranked.withColumn(out, round_to(F.try_divide(total, held), 9))
    return made.drop(*(f"_{k}{i}" for k in "sr" for i in range(len(signs))))


def inverse_vol() -> Column:
    return 1 / F.greatest("vol_3m", F.lit(0.05))


def _decile(panel: DataFrame, by: str, which: int) -> DataFrame:
    return panel.withColumn("decile", qcut_decile(by, "rebal_date")).where(F.col("decile") == which)


def _weighted(chosen: DataFrame, weight: Column) -> DataFrame:
    return chosen.select("rebal_date", "symbol", weight.alias("weight")).where("weight IS NOT NULL")


def momentum_delivery_lowvol(panel: DataFrame) -> DataFrame:
    """Top decile of the mean rank of momentum, nearness to the high, delivery and low volatility."""
    return _weighted(_decile(mean_rank(panel, COMPOSITE), "composite", 10), inverse_vol())


def low_volatility(panel: DataFrame) -> DataFrame:
    """Lowest decile of realised volatility."""
    return _weighted(_decile(panel, "vol_3m", 1), inverse_vol())


def short_term_reversal(panel: DataFrame) -> DataFrame:
    """Lowest decile of the one-month return, equally weighted."""
    return _weighted(_decile(panel, "ret_1m", 1), F.lit(1.0))


def high52_breakout(panel: DataFrame) -> DataFrame:
    """Top decile of nearness to the 52-week high among names above their 200-day average."""
    return _weighted(_decile(panel.where("above_200 = 1"), "prox_52w_high", 10), inverse_vol())


def value_earnings_yield(panel: DataFrame) -> DataFrame:
    """Top decile of the earnings yield among positive earners."""
    return _weighted(_decile(panel.where("earnings_yield > 0"), "earnings_yield", 10), inverse_vol())


def quality_roe(panel: DataFrame) -> DataFrame:
    """Top decile of the return on equity."""
    return _weighted(_decile(panel.where("roe IS NOT NULL"), "roe", 10), inverse_vol())


def dividend_yield(panel: DataFrame) -> DataFrame:
    """Top decile of the trailing dividend yield among payers."""
    return _weighted(_decile(panel.where("dividend_yield > 0"), "dividend_yield", 10), inverse_vol())


def sector_rotation(panel: DataFrame, top: int = 3) -> DataFrame:
    """All names of the sectors with the best mean 12-1 momentum (ties share their mean rank)."""
    p = panel.where("sector IS NOT NULL AND mom_12_1 IS NOT NULL")
    p = p.withColumn("_m", round_to(-F.avg("mom_12_1").over(Window.partitionBy("rebal_date", "sector")), 10))
    sectors = p.select("rebal_date", "sector", "_m").distinct().withColumn("_k", avg_rank("_m", "rebal_date")).where(F.col("_k") <= top)
    return _weighted(p.join(sectors.select("rebal_date", "sector"), ["rebal_date", "sector"]), inverse_vol())


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (
        momentum_delivery_lowvol, low_volatility, short_term_reversal, high52_breakout, value_earnings_yield, quality_roe, dividend_yield,
        sector_rotation,
    )
}
