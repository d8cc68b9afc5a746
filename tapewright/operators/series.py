"""Rolling, expanding and shifted columns of daily series, and cross-section ranks.

All rolling columns of a symbol share one window specification, so Catalyst
sorts each symbol once however many of them are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import by_symbol, clip, median, rank_pct, ret, roll
from .asof import asof
from .rolling import STATISTICS, order_statistics, rolled

W = by_symbol


def returns(bars: DataFrame) -> DataFrame:
    """Returns over 1, 21, 63, 126 and 252 rows and momentum skipping the last month."""
    w = W()
    c = lambda n: F.lag("close", n).over(w)
    return bars.withColumns(
        {"ret_1d": ret("close", 1), "ret_1m": ret("close", 21), "ret_3m": ret("close", 63), "ret_6m": ret("close", 126), "ret_12m": ret("close", 252),
         "mom_12_1": F.try_divide(c(21), c(252)) - 1, "mom_6_1": F.try_divide(c(21), c(126)) - 1}
    )


def forward_labels(bars: DataFrame, horizons: dict[str, int]) -> DataFrame:
    return bars.withColumns({k: F.try_divide(F.lead("close", n).over(W()), F.col("close")) - 1 for k, n in horizons.items()})


def realized_vol(bars: DataFrame) -> DataFrame:
    b = bars.withColumn("ret_1d", ret("close", 1))
    return b.withColumns({"vol_3m": roll(F.stddev_samp, "ret_1d", 63) * 252**0.5, "vol_6m": roll(F.stddev_samp, "ret_1d", 126) * 252**0.5})


def sma_distance(bars: DataFrame) -> DataFrame:
    b = bars.withColumns({"sma50": roll(F.avg, "close", 50), "sma200": roll(F.avg, "close", 200)})
    return b.withColumns(
        {"dist_sma50": F.col("close") / F.col("sma50") - 1, "dist_sma200": F.col("close") / F.col("sma200") - 1,
         "above_200": F.coalesce(F.col("close") > F.col("sma200"), F.lit(False)).cast("int")}
    )


def prox_high(bars: DataFrame, n: int = 252) -> DataFrame:
    return bars.withColumn("prox_52w_high", F.col("close") / roll(F.max, "close", n))


def amihud(bars: DataFrame, n: int = 21) -> DataFrame:
    b = bars.withColumn("_ill", F.abs(ret("close", 1)) / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)))
    return b.withColumn("amihud", roll(F.avg, "_ill", n) * 1e7).drop("_ill")


def delivery_trend(delivery: DataFrame) -> DataFrame:
    d = delivery.withColumns({"deliv_1m": roll(F.avg, "delivery_percent", 21), "deliv_3m": roll(F.avg, "delivery_percent", 63)})
    return d.withColumn("deliv_trend", F.col("deliv_1m") - F.col("deliv_3m"))


def trailing_percentile(series: DataFrame, n: int = 252) -> DataFrame:
    """Share of the last n values at or below the current one."""
    ranked = order_statistics(series, "close", n)
    return ranked.withColumn("pctile", F.when(F.col("_held") >= n, F.col("_upto") / n)).drop(*STATISTICS)


def regime_label(bars: DataFrame) -> DataFrame:
    b = rolled(bars, {"_a": ("avg", "close", 50, 50), "_b": ("avg", "close", 200, 200)})
    label = F.when((F.col("close") > F.col("_a")) & (F.col("_a") > F.col("_b")), "bull").when(
        (F.col("close") < F.col("_a")) & (F.col("_a") < F.col("_b")), "bear").otherwise("sideways")
    return b.withColumn("regime", label).drop("_a", "_b")


def compounded(series: DataFrame, ret_col: str = "ret", key: str = "symbol") -> DataFrame:
    """Index level: cumulative product of 1 + return, null returns as 0."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("level", F.product(1 + F.coalesce(F.col(ret_col), F.lit(0.0))).over(w))


def drawdown(series: DataFrame, key: str = "symbol") -> DataFrame:
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("peak", F.max("level").over(w))
    return s.withColumn("drawdown", F.col("level") / F.col("peak") - 1)


def vol_target(series: DataFrame, target: float = 0.12, n: int = 12, cap: float = 1.5, per_year: int = 12) -> DataFrame:
    s = series.withColumn("_v", roll(F.stddev_samp, "ret", n) * per_year**0.5)
    raw = clip(F.try_divide(F.lit(target), F.col("_v")), 0, cap)
    return s.withColumn("exposure", F.lag(F.when(F.col("_v").isNotNull(), raw)).over(W())).drop("_v")


def median_vote(bars: DataFrame, n: int = 252) -> DataFrame:
    """Bars with vote: 1 where the close is below the median of the last n, if there are as many."""
    ranked = order_statistics(bars, "close", n)
    below = F.when(F.col("_held") >= n, F.col("close") < F.col("_middle"))
    return ranked.withColumn("vote", F.coalesce(below, F.lit(False)).cast("int")).drop(*STATISTICS)


def iv_rank(series: DataFrame, col: str = "close", n: int = 252, least: int = 20) -> DataFrame:
    """Place of the current value between the lowest and the highest of the last n, and the share of them below it, in per cent."""
    ok = F.col("_held") >= least
    return order_statistics(series, col, n).withColumns(
        {"iv_rank": F.when(ok, F.try_divide(F.col(col) - F.col("_low"), F.col("_high") - F.col("_low")) * 100),
         "iv_percentile": F.when(ok, F.col("_below") * 100.0 / F.col("_held"))}
    ).drop(*STATISTICS)


def yearly_growth(statements: DataFrame, col: str = "revenue", days: int = 350, least: float = 1e5) -> DataFrame:
    """(symbol, quarter, growth) against the last quarter at least `days` earlier, where that had at least `least`: one as-of pass."""
    before = statements.select("symbol", "quarter", F.col(col).alias("_base"))
    own = statements.select("symbol", "quarter", F.col(col).alias("_now"), F.date_sub("quarter", days).alias("_at"))
    at = asof(own, before, ["symbol"], "_at", "quarter", ["_base"])
    return at.where(F.col("_base") >= least).select("symbol", "quarter", (F.col("_now") / F.col("_base") - 1).alias("growth"))


def z_by_group(df: DataFrame, col: str, *groups: str, cap: float = 3.0) -> DataFrame:
    """Deviation from the group's median in standard deviations (0 or null: 1), clipped, and percentile rank x 100."""
    stats = df.groupBy(*groups).agg(median(F.col(col)).alias("_m"), F.stddev_samp(col).alias("_s"))
    sd = F.when((F.col("_s").isNull()) | (F.col("_s") == 0), 1.0).otherwise(F.col("_s"))
    return df.join(stats, list(groups)).withColumns({"z": clip((F.col(col) - F.col("_m")) / sd, -cap, cap), "pct": rank_pct(col, *groups) * 100}).drop("_m", "_s")


def macd(bars: DataFrame, last: int = 756, fast: int = 12, slow: int = 26, smooth: int = 9) -> DataFrame:
    """(symbol, macd, signal, histogram) at the last bar, from at most `last` bars; symbols with fewer than slow + smooth have none.

    Each average starts as the mean of its first values. All three are carried
    through one fold over the closes, whose state is a few numbers.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    recent = bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    closes = recent.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("a")).where(F.size("a") >= slow + smooth)
    step = lambda old, new, n: f"{old} + ({new} - {old}) * (2D / {n + 1})"
    average = lambda e, n, i: f"CASE WHEN {i} < {n} THEN x.{e} + v.close WHEN {i} = {n} THEN (x.{e} + v.close) / {n} ELSE {step(f'x.{e}', 'v.close', n)} END"
    zero = "named_struct('i', 0, 'f', 0D, 's', 0D, 'm', 0D, 'g', 0D)"
    averaged = f"named_struct('i', x.i + 1, 'f', {average('f', fast, '(x.i + 1)')}, 's', {average('s', slow, '(x.i + 1)')}, 'g', x.g)"
    k = f"(y.i - {slow - 1})"  # how many values the line has
    signal = f"CASE WHEN {k} < 1 THEN 0D WHEN {k} < {smooth} THEN y.g + y.f - y.s WHEN {k} = {smooth} THEN (y.g + y.f - y.s) / {smooth} ELSE {step('y.g', '(y.f - y.s)', smooth)} END"
    fold = f"aggregate(a, {zero}, (x, v) -> transform(array({averaged}), y -> named_struct('i', y.i, 'f', y.f, 's', y.s, 'm', y.f - y.s, 'g', {signal}))[0])"
    s = closes.select("symbol", F.expr(fold).alias("z"))
    return s.select("symbol", F.col("z.m").alias("macd"), F.col("z.g").alias("signal"), (F.col("z.m") - F.col("z.g")).alias("histogram"))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    d = bars.withColumn("_d", F.col("close") - F.lag("close").over(W()))
    up, down = roll(F.avg, F.greatest("_d", F.lit(0.0)), n), roll(F.avg, F.greatest(-F.col("_d"), F.lit(0.0)), n)
    d = d.withColumns({"_u": F.when(F.count("_d").over(W().rowsBetween(-(n - 1), 0)) >= n, up), "_l": down})
    return d.withColumn("rsi", F.when(F.col("_u").isNotNull(), F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_u") / F.col("_l"))))).drop("_d", "_u", "_l")


def true_range(bars: DataFrame) -> DataFrame:
    pc = F.lag("close").over(W())
    return bars.withColumn("tr", F.when(pc.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))))


def technical(bars: DataFrame, n: int = 14) -> DataFrame:
    """Bars with atr, atr_pct and adx: the one-step directional index from mean directional moves and true range; one pass for the shifts and one for the means."""
    up, down = F.col("high") - F.lag("high").over(W()), F.lag("low").over(W()) - F.col("low")
    b = true_range(bars.withColumns({"_up": up, "_dn": down}))
    b = b.withColumns(
        {"_p": F.when(F.col("_up").isNotNull(), F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)),
         "_m": F.when(F.col("_up").isNotNull(), F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0))}).drop("_up", "_dn")
    b = rolled(b, {"atr": ("avg", "tr", n, n), "_pa": ("avg", "_p", n, n), "_ma": ("avg", "_m", n, n)})
    b = b.withColumns({"atr_pct": F.col("atr") / F.col("close") * 100, "_pdi": F.col("_pa") / F.col("atr") * 100, "_mdi": F.col("_ma") / F.col("atr") * 100})
    index = F.try_divide(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi")) * 100
    return b.withColumn("adx", index).drop("_p", "_m", "_pa", "_ma", "_pdi", "_mdi")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return technical(bars, n).drop("adx")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    return technical(bars, n).drop("atr", "atr_pct")


def bollinger(bars: DataFrame, n: int = 20) -> DataFrame:
    b = bars.withColumns({"_m": roll(F.avg, "close", n), "_s": roll(F.stddev_samp, "close", n)})
    low = F.col("_m") - 2 * F.col("_s")
    return b.withColumns({"bb_pos": F.try_divide(F.col("close") - low, 4 * F.col("_s")), "bb_width": 4 * F.col("_s") / F.col("_m") * 100}).drop("_m", "_s")


def volume_surge(bars: DataFrame) -> DataFrame:
    """Volume against its year, distance from the ends of the year, and crossings of the 50- and 200-row means; the means of the row before are those of the closes before."""
    b = rolled(bars.withColumn("_before", F.lag("close").over(W())), {
        "_v20": ("avg", "volume", 20, 20), "_v252": ("avg", "volume", 252, 252), "_high": ("max", "high", 252, 252), "_low": ("min", "low", 252, 252),
        "_a": ("avg", "close", 50, 50), "_b": ("avg", "close", 200, 200), "_c": ("avg", "_before", 50, 50), "_d": ("avg", "_before", 200, 200)})
    now, before = F.col("_a") - F.col("_b"), F.col("_c") - F.col("_d")
    made = b.withColumns({
        "vol_surge": F.col("_v20") / F.col("_v252"), "from_high": F.col("close") / F.col("_high") - 1, "from_low": F.col("close") / F.col("_low") - 1,
        "cross": F.when((before <= 0) & (now > 0), "golden").when((before >= 0) & (now < 0), "death")})
    return made.drop("_before", "_v20", "_v252", "_high", "_low", "_a", "_b", "_c", "_d")


def composite(df: DataFrame, ranks: dict[str, int], group: str = "rebal_date", out: str = "composite") -> DataFrame:
    """Mean of percentile ranks; a sign of -1 ranks the negated column. Null if any is null."""
    with_signs = df.withColumns({f"_s{i}": F.col(c) * s for i, (c, s) in enumerate(ranks.items())})
    total = reduce(lambda a, b: a + b, (rank_pct(f"_s{i}", group) for i in range(len(ranks))))
    return with_signs.withColumn(out, total / len(ranks)).drop(*(f"_s{i}" for i in range(len(ranks))))


def sector_neutral(df: DataFrame, col: str, group: str = "rebal_date", sector: str = "sector") -> DataFrame:
    """Percentile rank minus the mean of its sector on the date."""
    r = df.withColumn("_r", rank_pct(col, group))
    return r.withColumn("neutral", F.col("_r") - F.avg("_r").over(Window.partitionBy(group, sector))).drop("_r")


def universe_tiers(df: DataFrame, group: str = "rebal_date", by: str = "med_turnover", liquid_from: float = 1e7) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), "symbol"))
    d = df.withColumn("adv_rank", rank)
    return d.withColumns({**{f"top{n}": (F.col("adv_rank") <= n).cast("int") for n in (100, 250, 500)}, "liquid": (F.col(by) >= liquid_from).cast("int")})


def top_k(df: DataFrame, k: int, *groups: str, by: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*by))).where(F.col("rank") <= k)

