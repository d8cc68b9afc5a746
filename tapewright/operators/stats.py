"""Aggregations: breadth, option ratios, information coefficients, return metrics and window statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import avg_rank, by_symbol, median, ret, round_to
from .rolling import order_statistics, rolled


def breadth(bars: DataFrame) -> DataFrame:
    """Daily advances, declines, new highs and lows and shares above moving averages."""
    b = rolled(bars.select("symbol", "date", "high", "low", "close", ret("close", 1).alias("_r")), {
        "_h": ("max", "high", 252, 60), "_l": ("min", "low", 252, 60), "_a50": ("avg", "close", 50, 20), "_a200": ("avg", "close", 200, 50)})
    share = lambda a: F.avg(F.when(F.col(a).isNotNull(), (F.col("close") > F.col(a)).cast("double"))) * 100
    total = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    d = b.groupBy("date").agg(
        total(F.col("_r") > 0).alias("advances"), total(F.col("_r") < 0).alias("declines"), total(F.col("_r") == 0).alias("unchanged"),
        total(F.col("high") >= F.col("_h")).alias("new_highs_52w"), total(F.col("low") <= F.col("_l")).alias("new_lows_52w"),
        share("_a50").alias("pct_above_50dma"), share("_a200").alias("pct_above_200dma"), F.count(F.lit(1)).alias("total_traded"))
    return d.withColumn("ad_ratio", F.col("advances") / F.greatest("declines", F.lit(1)))


def share_above(bars: DataFrame, n: int = 200, least: int = 50) -> DataFrame:
    """(date, score): per cent of the shares that close above their n-row mean, as in `breadth`, which makes eight more columns."""
    b = rolled(bars.select("symbol", "date", "close"), {"_a": ("avg", "close", n, least)})
    return b.groupBy("date").agg((F.avg(F.when(F.col("_a").isNotNull(), (F.col("close") > F.col("_a")).cast("double"))) * 100).alias("score"))


def pcr(chain: DataFrame) -> DataFrame:
    side = lambda t, c: F.sum(F.when(F.col("option_typ") == t, F.col(c)).otherwise(0))
    g = chain.groupBy("date", "symbol").agg(
        side("CE", "open_int").alias("call_oi"), side("PE", "open_int").alias("put_oi"), side("CE", "contracts").alias("call_vol"), side("PE", "contracts").alias("put_vol"))
    return g.withColumns({"pcr_oi": F.try_divide("put_oi", F.nullif("call_oi", F.lit(0))), "pcr_vol": F.try_divide("put_vol", F.nullif("call_vol", F.lit(0)))})


def rank_ic(panel: DataFrame, feature: str, label: str, date: str = "rebal_date", least: int = 20) -> DataFrame:
    """Spearman correlation per date, over rows with both values."""
    p = panel.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    p = p.select(date, avg_rank(feature, date).alias("_f"), avg_rank(label, date).alias("_l"))
    return p.groupBy(date).agg(F.corr("_f", "_l").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def spread_rank(df: DataFrame, col: str, group: str, out: str, parts: int = 64) -> DataFrame:
    """Add `out`: the rank of a value in its group, ties sharing their mean rank, for groups of any size.

    Equal values are counted first. The distinct ones are dealt to `parts` ranges per
    group between approximate quantiles, so that no window holds a whole group, and
    the ranges' counts are added up. Null values have null ranks.
    """
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.percentile_approx("_v", F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(parts * 20))
    bounds = values.groupBy("_g").agg(cuts.alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    dealt = values.join(bounds, "_g").select("_g", "_v", "_n", part.alias("_part"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows a group
    sizes = dealt.groupBy("_g", "_part").agg(F.sum("_n").alias("_m")).select("_g", "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_upto", F.sum("_n").over(upto)).join(sizes, ["_g", "_part"])
    ranked = ranked.select("_g", "_v", (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranked, (F.col(group) == F.col("_g")) & (F.col(col) == F.col("_v")), "left").drop("_g", "_v")


def pooled_rank_ic(long: DataFrame, feature: str, label: str, group: str, least: int = 5) -> DataFrame:
    """(group, ic, n): Spearman correlation over all rows of a few large groups."""
    known = long.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).select(group, feature, label)
    ranked = spread_rank(spread_rank(known, feature, group, "_a"), label, group, "_b")
    return ranked.groupBy(group).agg(F.corr("_a", "_b").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame, date: str = "rebal_date") -> DataFrame:
    """Mean, t-statistic, share positive and the means of both halves in time."""
    w, alone = Window.orderBy(date), Window.partitionBy()
    ic = ic.withColumn("_first", F.row_number().over(w) <= F.floor(F.count(F.lit(1)).over(alone) / 2))
    t = F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(F.count("ic")))
    return ic.agg(
        F.avg("ic").alias("mean_ic"), t.alias("t_stat"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("pct_positive"), F.count("ic").alias("n_dates"),
        F.avg(F.when(F.col("_first"), F.col("ic"))).alias("h1"), F.avg(F.when(~F.col("_first"), F.col("ic"))).alias("h2"),
        F.when(F.abs(t) >= 3, "scored").otherwise("context").alias("verdict"))


def metrics(series: DataFrame, keys: list[str], col: str = "ret", date: str = "date", per_year: int = 12, least: int = 12) -> DataFrame:
    """CAGR, volatility, Sharpe, Sortino, maximum drawdown, Calmar and hit rate of a return series per key."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    s = series.where(F.col(col).isNotNull()).withColumn("_eq", F.product(1 + F.col(col)).over(w))
    s = s.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    n, ann = F.count(F.lit(1)), per_year**0.5
    g = s.groupBy(*keys).agg(
        n.alias("months"), F.max_by("_eq", date).alias("_end"), F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"),
        F.stddev_samp(F.when(F.col(col) < 0, F.col(col))).alias("_d"), F.min("_dd").alias("max_dd"), F.avg((F.col(col) > 0).cast("double")).alias("hit_rate"),
    ).where(F.col("months") >= least)
    cagr = F.when(F.col("_end") > 0, F.pow("_end", per_year / F.col("months")) - 1)
    return g.select(
        *keys, "months", cagr.alias("cagr"), (F.col("_s") * ann).alias("vol"), F.try_divide(F.col("_m") * ann, F.col("_s")).alias("sharpe"),
        F.try_divide(F.col("_m") * ann, F.col("_d")).alias("sortino"), "max_dd", F.try_divide(cagr, F.abs("max_dd")).alias("calmar"), "hit_rate")


HORIZONS = (5, 10, 21, 42, 63, 126, 189, 252)


def window_returns(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per bar and horizon with the return over the next h rows, and the bar's columns `keep`; all from one sorted pass."""
    w = by_symbol()
    wide = bars.select(
        "symbol", "date", *keep, *((F.lead("close", h).over(w) / F.col("close") - 1).alias(f"r{h}") for h in horizons), *(F.lead("date", h).over(w).alias(f"e{h}") for h in horizons))
    cases = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"r{h}").alias("ret"), F.col(f"e{h}").alias("end_date")) for h in horizons))
    return wide.select("symbol", "date", *keep, F.explode(cases).alias("x")).select("symbol", "date", *keep, "x.*").where("ret IS NOT NULL")


#: All windows whose extremes are kept.
EXTREME_HORIZONS = (1, 2, 3, 5, 7, 10, 15, 20, 30, 45, 60, 90, 120, 180, 252, 504, 756)


def window_extremes(bars: DataFrame, most: int = 10, horizons: tuple[int, ...] = HORIZONS, directions: tuple[str, ...] = ("up",)) -> DataFrame:
    """(symbol, horizon, direction, date, end_date, ret, rank): the `most` best (up) or worst (down) returns of a symbol over each horizon, the earlier of equal ones (to 10 digits) first.

    A symbol's closes, at most one a market date, are one sorted array that all
    horizons read, so that no rows times horizons are sorted.
    """
    series = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("_a"))

    def gains(h: int) -> Column:
        pairs = F.arrays_zip(F.slice("_a", 1, F.greatest(F.size("_a") - h, F.lit(0))).alias("x"), F.slice("_a", h + 1, F.greatest(F.size("_a") - h, F.lit(0))).alias("y"))
        gain = lambda p: p["y"]["close"] / p["x"]["close"] - 1
        made = F.transform(pairs, lambda p: F.struct(round_to(gain(p), 10).alias("k"), p["x"]["date"].alias("date"), p["y"]["date"].alias("end_date"), gain(p).alias("ret")))
        return F.filter(made, lambda r: r["ret"].isNotNull()).alias(f"_h{h}")

    def ends(h: int, direction: str) -> Column:
        key = lambda r: F.lit(0.0) - r["k"] if direction == "up" else F.lit(0.0) + r["k"]
        first = F.slice(F.array_sort(F.transform(f"_h{h}", lambda r: F.struct(key(r).alias("k"), r["date"], r["end_date"], r["ret"]))), 1, most)
        return F.transform(first, lambda r, i: F.struct(
            F.lit(h).alias("horizon"), F.lit(direction).alias("direction"), r["date"].alias("date"), r["end_date"].alias("end_date"), r["ret"].alias("ret"), (i + 1).alias("rank")))

    made = series.select("symbol", *map(gains, horizons))
    return made.select("symbol", F.inline(F.flatten(F.array(*(ends(h, d) for h in horizons for d in directions)))))


def window_stats(returns: DataFrame, *keys: str) -> DataFrame:
    q = F.percentile("ret", F.array(*map(F.lit, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))))
    g = returns.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_return"), F.stddev_samp("ret").alias("std_return"), F.min("ret").alias("min_return"), F.max("ret").alias("max_return"),
        q.alias("q"), *(F.avg((F.col("ret") > t).cast("double")).alias(name) for name, t in (("p_gt_0", 0.0), ("p_gt_10", 0.1), ("p_gt_25", 0.25))),
        *(F.avg((F.col("ret") < t).cast("double")).alias(name) for name, t in (("p_lt_m10", -0.1), ("p_lt_m25", -0.25))))
    names = ("p01", "p05", "p25", "median_return", "p75", "p95", "p99")
    return g.select(*g.columns[: len(keys) + 6], *(F.col("q")[i].alias(x) for i, x in enumerate(names)), *g.columns[len(keys) + 7 :])


def pooled_window_stats(returns: DataFrame, key: str, every: str = "all", fineness: int = 1024) -> DataFrame:
    """`window_stats` by a key of a few large groups, and of all rows as the group `every`.

    Rows are first summed up by buckets of their return. The buckets' counts tell in
    which ones the percentiles' neighbours lie; only the rows of those are sorted, so
    that no task holds the values of a group. The root of the size spreads the many
    small returns over more buckets, and keeps their order.
    """
    shares = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    names = ("p01", "p05", "p25", "median_return", "p75", "p95", "p99")
    tails = {"p_gt_0": F.col("ret") > 0, "p_gt_10": F.col("ret") > 0.1, "p_gt_25": F.col("ret") > 0.25, "p_lt_m10": F.col("ret") < -0.1, "p_lt_m25": F.col("ret") < -0.25}
    groups = F.explode(F.array(F.col(key), F.lit(every)))
    bucketed = returns.select(key, "horizon", "ret", (F.signum("ret") * F.floor(F.sqrt(F.abs("ret")) * fineness)).cast("long").alias("_b"))
    few = bucketed.groupBy(key, "horizon", "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("ret").alias("_m"), F.var_pop("ret").alias("_v"), F.min("ret").alias("_lo"), F.max("ret").alias("_hi"),
        *(F.count(F.when(c, 1)).alias(x) for x, c in tails.items())).withColumn(key, groups)
    n, total = F.sum("_n"), F.sum(F.col("_n") * F.col("_m"))
    squares = F.sum(F.col("_n") * (F.col("_v") + F.col("_m") * F.col("_m")))
    figures = few.groupBy(key, "horizon").agg(
        n.alias("n"), (total / n).alias("mean_return"), F.when(n > 1, F.sqrt(F.greatest(squares - total * total / n, F.lit(0.0)) / (n - 1))).alias("std_return"),
        F.min("_lo").alias("min_return"), F.max("_hi").alias("max_return"), *((F.sum(x) / n).alias(x) for x in tails))
    # the places (from 0) that each percentile lies between, and the buckets that hold them
    places = figures.select(key, "horizon", F.posexplode(F.array(*(F.lit(q) * (F.col("n") - 1) for q in shares))).alias("_q", "_at"))
    places = places.select(key, "horizon", "_q", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_place"))
    counts = few.groupBy(key, "horizon", "_b").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(key, "horizon").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))  # a row per bucket
    counts = counts.withColumn("_before", upto - F.col("_n"))
    held = places.join(counts, [key, "horizon"]).where("_place >= _before AND _place < _before + _n")
    asked = held.groupBy(key, "horizon", "_b").agg(F.first("_before").alias("_before"), F.collect_set("_place").alias("_places"))
    inside = bucketed.withColumn(key, groups).join(F.broadcast(asked), [key, "horizon", "_b"])  # a few buckets a group
    place = F.row_number().over(Window.partitionBy(key, "horizon", "_b").orderBy("ret")) - 1 + F.col("_before")
    values = inside.withColumn("_place", place).where(F.array_contains("_places", F.col("_place"))).select(key, "horizon", "_place", "ret")
    ends = places.join(values, [key, "horizon", "_place"]).groupBy(key, "horizon", "_q").agg(
        (F.min("ret") + (F.max("ret") - F.min("ret")) * (F.first("_at") - F.min("_place"))).alias("_value"))
    wide = ends.groupBy(key, "horizon").agg(*(F.max(F.when(F.col("_q") == i, F.col("_value"))).alias(x) for i, x in enumerate(names)))
    return figures.join(wide, [key, "horizon"]).select(key, "horizon", "n", "mean_return", "std_return", "min_return", "max_return", *names, *tails)


def seasonality(bars: DataFrame) -> DataFrame:
    """Month-of-year returns from the first to the last bar of each month, per symbol."""
    m = bars.groupBy("symbol", F.year("date").alias("y"), F.month("date").alias("month")).agg(
        F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    m = m.withColumn("r", F.col("b") / F.col("a") - 1)
    return m.groupBy("symbol", "month").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_return"), median(F.col("r")).alias("median_return"), F.stddev_samp("r").alias("std_return"),
        F.avg((F.col("r") > 0).cast("double")).alias("p_positive")).where("n >= 3")


def series_stats(bars: DataFrame, per_year: int = 252) -> DataFrame:
    """Total return, CAGR by calendar days, volatility, drawdown with its dates, moments and the 52-week range."""
    w = by_symbol()
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    b = bars.withColumns({"_r": ret("close", 1), "_peak": F.max("close").over(up)}).withColumn("_dd", F.col("close") / F.col("_peak") - 1)
    b = b.withColumn("_peak_date", F.max(F.when(F.col("close") == F.col("_peak"), F.col("date"))).over(up))
    g = b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("close", "date").alias("_a"), F.max_by("close", "date").alias("_b"),
        (F.stddev_samp("_r") * per_year**0.5).alias("vol"), (F.avg("_r") * per_year).alias("_m"), F.skewness("_r").alias("skew"), F.kurtosis("_r").alias("kurt"),
        F.avg((F.col("_r") > 0).cast("double")).alias("pct_positive"), F.min("_dd").alias("max_dd"), F.min(F.struct(F.round("_dd", 12), "date", "_peak_date")).alias("_t"))
    years = F.datediff("last_date", "first_date") / 365.25
    return g.select(
        "symbol", "n", "first_date", "last_date", (F.col("_b") / F.col("_a") - 1).alias("total_return"), (F.pow(F.col("_b") / F.col("_a"), 1 / years) - 1).alias("cagr"), "vol",
        (F.col("_m") / F.col("vol")).alias("sharpe"), "skew", "kurt", "pct_positive", "max_dd", F.col("_t._peak_date").alias("dd_start"), F.col("_t.date").alias("dd_trough"))


def corr_beta(bars: DataFrame, index: DataFrame, windows: tuple[int, ...] = (63, 252)) -> DataFrame:
    """Correlation with and beta to an index over the last common dates."""
    r = bars.select("symbol", "date", ret("close", 1).alias("r"))
    ix = index.select("date", (F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1).alias("i"))
    j = r.join(ix, "date").where("r IS NOT NULL AND i IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    when = lambda n, c: F.when(F.col("_k") <= n, F.col(c))
    cols: list[Column] = [F.corr("r", "i").alias("corr_all")]
    for n in windows:
        cols += [F.corr(when(n, "r"), when(n, "i")).alias(f"corr_{n}"), (F.covar_samp(when(n, "r"), when(n, "i")) / F.var_samp(when(n, "i"))).alias(f"beta_{n}")]
    return j.groupBy("symbol").agg(*cols)


def universe_window(bars: DataFrame, month_ends: DataFrame, days: int = 63, least: int = 30) -> DataFrame:
    """Median turnover and days traded over the trailing market dates, for every symbol and month end.

    Bars are placed on a dense index of market dates; a symbol need not trade on the
    month end itself. The month ends that a symbol can have are counted off on that
    calendar, so each asks for its own by number.
    """
    dates = Window.orderBy("date")  # a row per market date, here and below
    ends = month_ends.select(F.col("rebal_date").alias("date"), F.lit(1).alias("_end"))
    calendar = bars.select("date").distinct().join(F.broadcast(ends), "date", "left").withColumns({
        "_i": F.row_number().over(dates), "_upto": F.count("_end").over(dates.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.count(F.lit(1)).over(Window.partitionBy())})
    b = bars.join(F.broadcast(calendar), "date").select("symbol", "_i", (F.col("close") * F.col("volume")).alias("_t"), "_last", (F.col("_upto") - F.coalesce("_end", F.lit(0))).alias("_before"))
    span = b.groupBy("symbol").agg(F.min("_before").alias("_from"), F.least(F.max("_i") + days, F.max("_last")).alias("_i"))
    span = span.join(F.broadcast(calendar.select("_i", "_upto")), "_i").where("_from < _upto").select("symbol", F.explode(F.sequence(F.col("_from") + 1, F.col("_upto"))).alias("_upto"))
    marks = span.join(F.broadcast(calendar.where("_end = 1").select("_upto", "_i", F.col("date").alias("rebal_date"))), "_upto").select("symbol", "_i", "rebal_date")
    both = b.select("symbol", "_i", "_t").unionByName(marks, allowMissingColumns=True)
    # a month end stands behind the bar of its own day
    out = order_statistics(both.withColumn("_mark", F.col("rebal_date").isNotNull()), "_t", days, order=("_i", "_mark"), place="_i")
    out = out.where("rebal_date IS NOT NULL").where(F.col("_held") >= least)
    return out.select("rebal_date", "symbol", F.col("_held").alias("n_days"), F.col("_middle").alias("med_turnover"))


def leading_run(df: DataFrame, good: Column, order: list[Column], *keys: str) -> DataFrame:
    """Length of the run of good rows at the start of the order, per key."""
    d = df.withColumns({"_k": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "_g": good})
    return d.groupBy(*keys).agg((F.coalesce(F.min(F.when(~F.col("_g"), F.col("_k"))), F.count(F.lit(1)) + 1) - 1).alias("streak"))


def phase_headroom(log: DataFrame, order: list[str], share: float = 1 / 3) -> DataFrame:
    """(phase, observed, cap, tight) from lines (phase, detail) like `95s / cap 600s`: the longest of all runs against the latest cap. Other lines don't count."""
    line = r"^\s*([\d.]+)s?\s*/ cap\s*([\d.]+)s?\s*$"
    part = lambda k: F.regexp_extract("detail", line, k).try_cast("double")
    read = log.withColumns({"_o": part(1), "_c": part(2)}).where("_o IS NOT NULL AND _c IS NOT NULL")
    found = read.groupBy("phase").agg(F.max("_o").alias("observed"), F.max_by("_c", F.struct(*order)).alias("cap"))
    return found.withColumn("tight", F.col("observed") > F.col("cap") * share)


def fund_scorecard(navs: DataFrame, risk_free: float = 0.06, least: int = 252) -> DataFrame:
    """1, 3 and 5 year growth to the last value, volatility, drawdown, three-year Sharpe ratio and one-year consistency per symbol."""
    w = by_symbol()
    peak = F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rolling = navs.withColumns({"_r": ret("close", 1), "_dd": F.col("close") / peak - 1, "_y": ret("close", 252), "_last": F.max("date").over(Window.partitionBy("symbol"))})
    before = lambda years: F.max_by("close", F.when(F.col("date") <= F.date_sub("_last", 365 * years), F.col("date")))
    g = rolling.groupBy("symbol").agg(
        F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_nav"), (F.datediff(F.max("date"), F.min("date")) / 365.0).alias("years"), F.count(F.lit(1)).alias("_n"),
        *(before(k).alias(f"_a{k}") for k in (1, 3, 5)), (F.stddev_samp("_r") * 252**0.5).alias("ann_vol"), F.min("_dd").alias("max_dd"),
        F.avg(F.when(F.col("_y") > 0, 1.0).otherwise(0.0)).alias("consistency"))
    growth = lambda k: F.pow(F.col("last_nav") / F.col(f"_a{k}"), F.lit(1.0 / k)) - 1
    g = g.where((F.col("_n") >= least) & (F.col("last_nav") > 0)).withColumns({f"cagr_{k}y": growth(k) for k in (1, 3, 5)})
    sharpe = F.when(F.col("ann_vol") > 0, (F.col("cagr_3y") - risk_free) / F.col("ann_vol"))
    return g.select("symbol", "last_date", "last_nav", "years", "cagr_1y", "cagr_3y", "cagr_5y", "ann_vol", "max_dd", sharpe.alias("sharpe_3y"), "consistency")


def tier_coverage(filings: DataFrame, tiers: tuple[int, ...] = (100, 250, 500)) -> DataFrame:
    """Per quarter how many of the largest scrips by amount filed. Only the largest tier is ranked, so the order is no one-task sort of all."""
    best = filings.groupBy("scrip").agg(F.round(F.sum("amount"), 2).alias("_a")).orderBy(F.desc("_a"), "scrip").limit(max(tiers))
    ranked = best.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("_a"), "scrip"))).select("scrip", "_k")  # at most the largest tier's rows
    filed = filings.join(F.broadcast(ranked), "scrip", "left")
    return filed.groupBy("quarter").agg(*(F.count_distinct(F.when(F.col("_k") <= n, F.col("scrip"))).alias(f"top{n}") for n in tiers))


def freshness(tables: dict[str, DataFrame], today: str, since: str, fresh: int = 5, late: int = 60) -> DataFrame:
    """(source, n, last_date, age, status, missing_days) of tables with a `date`; missing days are weekdays from `since` to the day before without rows."""
    spark = next(iter(tables.values())).sparkSession
    now = F.lit(today).cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.date_sub(now, 1))).alias("date")).where("weekday(date) < 5")
    found = None
    for name, df in tables.items():
        had = df.where(F.col("date") >= since).select("date").distinct()
        missing = days.join(had, "date", "left_anti").agg(F.count(F.lit(1)).alias("missing_days"))  # one row
        age = F.datediff(now, F.max("date"))
        one = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"), age.alias("age"))
        one = one.withColumn("status", F.when(F.col("age") <= fresh, "fresh").when(F.col("age") <= late, "late").otherwise("stale")).crossJoin(F.broadcast(missing))
        found = one if found is None else found.unionByName(one)
    return found


def quality_counts(bars: DataFrame, universe: DataFrame, breadth_daily: DataFrame, band: tuple[int, int] = (400, 500), back: int = 21) -> DataFrame:
    """Bad and crossed prices, size and sector coverage of the latest universe (symbol, sector), regime and whether it flipped over `back` rows."""
    prices = bars.agg(F.count(F.when((F.col("close") <= 0) | F.col("close").isNull(), 1)).alias("bad_prices"), F.count(F.when(F.col("high") < F.col("low"), 1)).alias("crossed"))
    names = universe.agg(F.count("symbol").alias("universe"), F.try_divide(F.count("sector"), F.count("symbol")).alias("sector_coverage"))
    last = breadth_daily.orderBy(F.desc("date")).limit(back + 1).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("date"))))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("pct_above_200dma")))
    state = last.agg(at(1).alias("_now"), at(back + 1).alias("_then"))
    on = lambda c: c >= 50
    flipped = F.coalesce(on(F.col("_now")) != on(F.coalesce("_then", "_now")), F.lit(False))
    regime = F.when(on(F.col("_now")), "risk_on").otherwise("risk_off")
    return prices.crossJoin(names).crossJoin(state).select(
        "bad_prices", "crossed", "universe", F.col("universe").between(*band).alias("universe_ok"), "sector_coverage", regime.alias("regime"), flipped.alias("flipped"))
