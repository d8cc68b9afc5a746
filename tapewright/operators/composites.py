"""Composite tables: price adjustment, universes, membership, filings, options and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import parse_ratio
from .asof import asof
from .rolling import STATISTICS, order_statistics


def _day(c: str = "date"):
    return F.unix_date(F.col(c)).cast("long")


def suffix_factor(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with adj_factor: the product of split and bonus factors of later ex-dates.

    Bars and events go through one window ordered by day, so nothing is joined.
    """
    events = actions.select("symbol", "date", parse_ratio(F.col("action_type"), F.col("ratio")).alias("_f")).where("_f > 0")
    both = bars.withColumn("_f", F.lit(None).cast("double")).unionByName(events, allowMissingColumns=True).withColumn("_day", _day())
    later = Window.partitionBy("symbol").orderBy("_day").rangeBetween(1, Window.unboundedFollowing)
    factor = F.coalesce(F.product("_f").over(later), F.lit(1.0))
    return both.withColumn("adj_factor", factor).where("_f IS NULL").drop("_f", "_day")


def ttm_dividend(bars: DataFrame, actions: DataFrame, days: int = 365) -> DataFrame:
    """Bars with the dividends of the last `days` days over the close."""
    paid = actions.where("action_type = 'DIVIDEND'").select("symbol", "date", F.col("amount").alias("_a"))
    both = bars.withColumn("_bar", F.lit(True)).unionByName(paid, allowMissingColumns=True).withColumn("_day", _day())
    last = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-(days - 1), 0)
    return both.withColumn("_sum", F.coalesce(F.sum("_a").over(last), F.lit(0.0))).where("_bar").withColumn(
        "dividend_yield", F.col("_sum") / F.col("close")).drop("_a", "_bar", "_day", "_sum")


def split_events(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """One factor per symbol and ex-date with its verification.

    The factor is verified if the move between the last close before and the
    first close from the ex-date on is nearer to it than to no move at all.
    Without a bar on both sides it is unverifiable.
    """
    f = actions.select("symbol", F.col("date").alias("ex_date"), parse_ratio(F.col("action_type"), F.col("ratio")).alias("_f")).where("_f > 0")
    f = f.groupBy("symbol", "ex_date").agg(F.product("_f").alias("factor"))
    from .asof import asof

    b = bars.withColumn("prev_close", F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))).select("symbol", "date", "close", "prev_close")
    m = asof(f, b, ["symbol"], "ex_date", "date", ["close", "prev_close"], forward=True)
    obs, want = F.log(F.col("close") / F.col("prev_close")), F.log("factor")
    status = F.when(F.col("close").isNull() | F.col("prev_close").isNull(), "unverifiable").when(F.abs(obs - want) < F.abs(obs), "applied").otherwise("skipped")
    return m.select("symbol", "ex_date", "factor", status.alias("status"))


def split_adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars back-adjusted by the verified factors of later ex-dates: prices times, volume over the factor."""
    good = split_events(bars, actions).where("status = 'applied'").select("symbol", F.col("ex_date").alias("date"), F.col("factor").alias("_f"))
    both = bars.unionByName(good, allowMissingColumns=True).withColumn("_day", _day())
    later = Window.partitionBy("symbol").orderBy("_day").rangeBetween(1, Window.unboundedFollowing)
    a = both.withColumn("adj_factor", F.coalesce(F.product("_f").over(later), F.lit(1.0))).where("_f IS NULL").drop("_f", "_day")
    return a.withColumns({**{c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")}, "volume": F.col("volume") / F.col("adj_factor")})


def total_return(bars: DataFrame, actions: DataFrame, cap: float = 0.5) -> DataFrame:
    """Close adjusted for dividends: the product of 1 - yield of later ex-dates, yields capped."""
    from .asof import asof

    paid = actions.where("action_type = 'DIVIDEND'").groupBy("symbol", F.col("date").alias("ex_date")).agg(F.sum("amount").alias("amount"))
    m = asof(paid, bars.select("symbol", "date", "close"), ["symbol"], "ex_date", "date", ["close"], strict=True).where("close IS NOT NULL")
    y = m.select("symbol", F.col("ex_date").alias("date"), (1 - F.least(F.col("amount") / F.col("close"), F.lit(cap))).alias("_f"))
    both = bars.select("symbol", "date", "close").unionByName(y, allowMissingColumns=True).withColumn("_day", _day())
    later = Window.partitionBy("symbol").orderBy("_day").rangeBetween(1, Window.unboundedFollowing)
    out = both.withColumn("tr_factor", F.coalesce(F.product("_f").over(later), F.lit(1.0))).where("_f IS NULL")
    return out.select("symbol", "date", "tr_factor", (F.col("close") * F.col("tr_factor")).alias("close_tr"))


def membership_islands(members: DataFrame, months: DataFrame) -> DataFrame:
    """Runs of consecutive month ends in which a symbol is a member, as [from, to): to is the next month end, null if open."""
    idx = months.withColumn("_i", F.row_number().over(Window.orderBy("rebal_date"))).withColumn("_next", F.lead("rebal_date").over(Window.orderBy("rebal_date")))
    m = members.join(F.broadcast(idx), "rebal_date").withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy("symbol").orderBy("_i")))
    return m.groupBy("symbol", "_g").agg(F.min("rebal_date").alias("effective_from"), F.max_by("_next", "_i").alias("effective_to"), F.count(F.lit(1)).alias("months")).drop("_g")


def first_filing(statements: DataFrame, filings: DataFrame, least: int = 90, most: int = 210, estimate: int = 135) -> DataFrame:
    """(symbol, quarter, real_date, pit_date, dated_by): the first filing (symbol, broadcast) between `least` and `most` days after
    the quarter, or an estimate of its day: one as-of pass forward."""
    own = statements.select("symbol", "quarter", F.date_add("quarter", least).alias("_at"))
    at = asof(own, filings.select("symbol", "broadcast"), ["symbol"], "_at", "broadcast", [], forward=True, max_days=most - least).withColumnRenamed("matched_on", "real_date")
    dated = F.when(F.col("real_date").isNull(), "lag").otherwise("filing")
    return at.select("symbol", "quarter", "real_date", F.coalesce("real_date", F.date_add("quarter", estimate)).alias("pit_date"), dated.alias("dated_by"))


def revision_chain(filings: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Versions of each key: the one it revises, its number, whether it is current, and a hash of its content."""
    w = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return filings.withColumns(
        {"is_revision_of": F.lag("filing_id").over(w), "version": F.row_number().over(w), "is_current": F.row_number().over(down) == 1,
         "content_hash": F.sha2(F.col(content).cast("string"), 256)})


def max_pain(chain: DataFrame, least: int = 3) -> DataFrame:
    """Strike of least total payout of the nearest expiry, lowest strike on ties; chains of `least` strikes or more."""
    near = chain.groupBy("date", "symbol").agg(F.min("expiry").alias("expiry"))
    c = chain.join(near, ["date", "symbol", "expiry"]).groupBy("date", "symbol", "strike").agg(
        F.sum(F.when(F.col("option_typ") == "CE", F.col("open_int")).otherwise(0.0)).alias("ce"), F.sum(F.when(F.col("option_typ") == "PE", F.col("open_int")).otherwise(0.0)).alias("pe"))
    # a chain has a bounded number of strikes: pay-outs at each from running sums, without a self-join
    up = Window.partitionBy("date", "symbol").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("date", "symbol").orderBy("strike").rowsBetween(0, Window.unboundedFollowing)
    k = F.col("strike")
    calls = k * F.sum("ce").over(up) - F.sum(F.col("ce") * k).over(up)
    puts = F.sum(F.col("pe") * k).over(down) - k * F.sum("pe").over(down)
    p = c.withColumn("pain", F.round(calls + puts, 6))
    return p.groupBy("date", "symbol").agg(F.min(F.struct("pain", "strike")).alias("m"), F.count(F.lit(1)).alias("strikes")).where(F.col("strikes") >= least).select("date", "symbol", F.col("m.strike").alias("max_pain"), "strikes")


def greeks(chain: DataFrame, spot: DataFrame, rate: float = 0.065, dividend: float = 0.012, sigma: float = 0.20) -> DataFrame:
    """Black-Scholes Greeks and gamma exposure per option row; `spot` has (date, symbol, spot)."""
    from ..functions.core import norm_cdf, norm_pdf

    t = F.greatest(F.datediff("expiry", "date") / 365.0, F.lit(1e-4))
    j = chain.join(spot, ["date", "symbol"]).withColumn("t", t)
    s, k = F.col("spot"), F.col("strike")
    j = j.withColumn("d1", (F.log(s / k) + (rate - dividend + sigma**2 / 2) * F.col("t")) / (sigma * F.sqrt("t"))).withColumn("d2", F.col("d1") - sigma * F.sqrt("t"))
    eq, er = F.exp(-dividend * F.col("t")), F.exp(-rate * F.col("t"))
    call = F.col("option_typ") == "CE"
    gamma = eq * norm_pdf(F.col("d1")) / (s * sigma * F.sqrt("t"))
    side = F.when(call, 1.0).otherwise(-1.0)  # of a call or put: the sign of what interest costs and dividends give
    decay = -eq * s * norm_pdf(F.col("d1")) * sigma / (2 * F.sqrt("t"))
    theta = decay - side * rate * k * er * norm_cdf(side * F.col("d2")) + side * dividend * s * eq * norm_cdf(side * F.col("d1"))
    return j.select(
        "date", "symbol", "expiry", "strike", "option_typ", F.when(call, eq * norm_cdf(F.col("d1"))).otherwise(-eq * norm_cdf(-F.col("d1"))).alias("delta"), gamma.alias("gamma"),
        (s * eq * norm_pdf(F.col("d1")) * F.sqrt("t") / 100).alias("vega"),
        (F.when(call, k * F.col("t") * er * norm_cdf(F.col("d2"))).otherwise(-k * F.col("t") * er * norm_cdf(-F.col("d2"))) / 100).alias("rho"),
        (theta / 365).alias("theta"), (gamma * s * F.col("open_int")).alias("gex"))


def cluster_events(trades: DataFrame, days: int = 28, least: int = 2) -> DataFrame:
    """Days on which `least` or more names traded within the last `days`, with no refire within `days` of the last fired.

    The suppression is not associative, so each symbol's days are folded in order.
    """
    w = Window.partitionBy("symbol").orderBy(_day("filing_date")).rangeBetween(-days, 0)
    d = trades.withColumn("_names", F.size(F.collect_set("name").over(w))).groupBy("symbol", "filing_date").agg(F.max("_names").alias("n"), F.sum("value").alias("value"))
    s = d.where(F.col("n") >= least).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("filing_date", "n", "value"))).alias("a"))
    fired = F.expr(
        f"""aggregate(a, slice(a, 1, 0), (x, v) -> if(size(x) = 0 OR datediff(v.filing_date, element_at(x, -1).filing_date) > {days}, concat(x, array(v)), x))"""
    )
    return s.select("symbol", F.explode(fired).alias("v")).select("symbol", F.col("v.filing_date").alias("event_date"), F.col("v.n").alias("insiders"), (F.col("v.value") / 1e7).alias("value_cr"))


def regime_votes(index: DataFrame, breadth: DataFrame) -> DataFrame:
    """Votes per date: close over its 200-day mean, below its one-year median volatility, breadth of 50 or more, and 63-day momentum."""
    w = Window.orderBy("date")  # one row per market date
    full = lambda f, c, n: F.when(F.count(c).over(w.rowsBetween(-(n - 1), 0)) >= n, f(c).over(w.rowsBetween(-(n - 1), 0)))
    i = index.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    i = i.withColumns({"_v": full(F.stddev_samp, "_r", 21), "_a": full(F.avg, "close", 200), "_m": F.col("close") / F.lag("close", 63).over(w) - 1})
    i = i.withColumn("_md", full(lambda c: F.percentile(c, F.lit(0.5)), "_v", 252))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    j = i.join(breadth.select("date", "pct_above_200dma"), "date", "left")
    v = j.select("date", flag(F.col("close") > F.col("_a")).alias("trend"), flag(F.col("_v") < F.col("_md")).alias("calm"), flag(F.col("pct_above_200dma") >= 50).alias("broad"), flag(F.col("_m") > 0).alias("momentum"))
    return v.withColumn("score", F.col("trend") + F.col("calm") + F.col("broad") + F.col("momentum"))


def atm_volatility(chain: DataFrame, spot: DataFrame) -> DataFrame:
    """(symbol, date, iv_ce, iv_pe, iv, pcr_oi): volatilities of the nearest expiry's strikes nearest to the spot, in percent.

    A premium over the spot times sqrt(2 pi / years) estimates the volatility, up
    to 200; `iv` is the mean of the sides that there are. `spot` has (date, symbol, spot).
    """
    near = chain.groupBy("date", "symbol").agg(F.min("expiry").alias("expiry"))
    j = chain.join(near, ["date", "symbol", "expiry"]).join(spot, ["date", "symbol"])
    side = lambda t, c: F.when(F.col("option_typ") == t, c)
    away = F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")
    total = lambda t: F.sum(F.when(F.col("option_typ") == t, F.col("open_int")).otherwise(0))
    a = j.groupBy("date", "symbol", "expiry", "spot").agg(
        F.min_by("close", side("CE", away)).alias("_ce"), F.min_by("close", side("PE", away)).alias("_pe"),
        F.try_divide(total("PE"), F.nullif(total("CE"), F.lit(0.0))).alias("pcr_oi"))
    scale = F.sqrt(F.lit(2 * 3.141592653589793) / (F.datediff("expiry", "date") / 365.0)) * 100
    iv = lambda c: F.when(F.col(c).isNotNull(), F.least(F.col(c) / F.col("spot") * scale, F.lit(200.0)))
    a = a.withColumns({"iv_ce": iv("_ce"), "iv_pe": iv("_pe")})
    both = (F.coalesce("iv_ce", "iv_pe") + F.coalesce("iv_pe", "iv_ce")) / 2
    return a.select("symbol", "date", "iv_ce", "iv_pe", both.alias("iv"), "pcr_oi").where("iv IS NOT NULL")


def volatility_history(iv: DataFrame, rows: int = 252) -> DataFrame:
    """`iv` with its rank and percentile among the symbol's last `rows` values, the current one included."""
    ranked = order_statistics(iv, "iv", rows)
    return ranked.withColumns(
        {"iv_rank": F.try_divide(F.col("iv") - F.col("_low"), F.col("_high") - F.col("_low")) * 100, "iv_percentile": F.col("_upto") * 100.0 / F.col("_held")}
    ).drop(*STATISTICS)


#: Weights of the regime axes (fixed values).
AXES = {"risk": 0.40, "vol": 0.25, "fx": 0.10, "commodity": 0.10, "rates": 0.10, "flow": 0.05}


def regime_spine(scores: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, one score per axis, regime_score, label) from component scores (axis, component, date, score) of -100 to 100.

    Every component is carried forward onto the calendar; an axis is the mean of
    the components that it has, and the composite the mean of the axes that there
    are by their weights, as 0 to 100: up to 40 risk_off, up to 60 neutral.
    """
    from .asof import align_ffill

    keyed = scores.withColumn("series", F.concat_ws("/", "axis", "component")).where("score IS NOT NULL").select("series", "date", "score")
    aligned = align_ffill(keyed, calendar, "score", by=["series"])
    axis = F.substring_index("series", "/", 1)
    wide = aligned.groupBy("date").agg(*(F.avg(F.when(axis == a, F.col("score"))).alias(f"{a}_axis") for a in AXES))
    held = [F.col(f"{a}_axis") for a in AXES]
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in zip(held, AXES.values())), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in zip(held, AXES.values())), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.try_divide(total, F.nullif(weight, F.lit(0.0))) + 100) / 2))
    made = wide.withColumn("regime_score", F.when(weight > 0, score)).where("risk_axis IS NOT NULL AND regime_score IS NOT NULL")
    label = F.when(F.col("regime_score") <= 40, "risk_off").when(F.col("regime_score") <= 60, "neutral").otherwise("risk_on")
    return made.withColumn("label", label)


def trend_score(series: DataFrame, cap: float) -> DataFrame:
    """Distance from the 200-row mean, capped, as -100 to 100, of (symbol, date, close)."""
    from ..functions.core import clip, roll

    d = series.withColumn("_a", roll(F.avg, "close", 200))
    return d.where("_a IS NOT NULL").select("symbol", "date", (clip(F.col("close") / F.col("_a") - 1, -cap, cap) / cap * 100).alias("score"))


LAGS = {"quarterly": 45, "annual": 60}


def fundamentals_pit(statements: DataFrame, filings: DataFrame, within: int = 120) -> DataFrame:
    """(statement, symbol, period_type, report_date, pit_date, dated_by) of (statement, symbol, period_type, report_date).

    The public date is that of the first filing (symbol, broadcast) from the report
    date on, up to `within` days later, else the report date plus the period's lag.
    One as-of pass per symbol serves all statement kinds, and the rows are made
    distinct where it brought them together.
    """
    from .asof import asof

    parts = int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = asof(statements, filings, ["symbol"], "report_date", "broadcast", [], forward=True, max_days=within, parts=parts).distinct()
    lag = F.create_map(*[F.lit(x) for k, v in LAGS.items() for x in (k, v)])[F.col("period_type")]
    return matched.select(
        "statement", "symbol", "period_type", "report_date", F.coalesce("matched_on", F.date_add("report_date", lag)).alias("pit_date"),
        F.when(F.col("matched_on").isNotNull(), "filing").otherwise("lag_estimate").alias("dated_by"))


def event_study(abnormal: DataFrame) -> DataFrame:
    """Count, mean, t statistic, hit rate and the means before and from the median event date, by aggregates alone."""
    day = F.unix_date("event_date")
    middle = abnormal.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_date(event_date))").alias("_mid"))
    return abnormal.crossJoin(F.broadcast(middle)).agg(  # one row
        F.count(F.lit(1)).alias("n"), F.avg("abnormal").alias("mean"), (F.avg("abnormal") / (F.stddev_samp("abnormal") / F.sqrt(F.count(F.lit(1))))).alias("t_stat"),
        F.avg((F.col("abnormal") > 0).cast("double")).alias("hit"), F.avg(F.when(day < F.col("_mid"), F.col("abnormal"))).alias("h1"),
        F.avg(F.when(day >= F.col("_mid"), F.col("abnormal"))).alias("h2"))


def filing_universe(membership: DataFrame, spans: DataFrame, tiers: DataFrame, filings: DataFrame) -> DataFrame:
    """(symbol, quarter, days, isin, isin_basis, tier, status) of every quarter that a symbol was a member of.

    `membership`: (symbol, quarter, quarter_end, days); `spans`: (isin, symbol,
    first_date, last_date); the ISIN is the one valid at the quarter's end, of several
    the one seen last, else the latest known. `tiers`: (rebal_date, symbol, tier), as
    of the quarter's end. `filings`: (symbol, quarter); none is missing, one filed, more revised.
    """
    from .asof import asof

    # of the spans begun by a quarter's end the one seen last is valid, or none is: one sorted pass per symbol instead of quarters times spans
    both = membership.withColumn("_d", F.col("quarter_end")).unionByName(
        spans.select("symbol", F.col("first_date").alias("_d"), F.struct("last_date", "isin").alias("_span")), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("_d")
    ends = both.withColumns({
        "_begun": F.max("_span").over(w.rangeBetween(Window.unboundedPreceding, 0)),
        "_last": F.max("_span").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).where("quarter IS NOT NULL")
    valid = F.coalesce(F.col("_begun.last_date") >= F.col("quarter_end"), F.lit(False))
    b = F.when(F.col("_last").isNotNull(), F.struct(valid.alias("valid"), F.when(valid, F.col("_begun.isin")).otherwise(F.col("_last.isin")).alias("isin")))
    known = ends.select(*membership.columns, b.alias("_b"))
    at = asof(known, tiers, ["symbol"], "quarter_end", "rebal_date", ["tier"]).drop("matched_on")
    filed = filings.groupBy("symbol", "quarter").agg(F.count(F.lit(1)).alias("_n"))
    j = at.join(filed, ["symbol", "quarter"], "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "revised").otherwise("filed")
    basis = F.when(F.col("_b.valid"), "as_of").when(F.col("_b").isNotNull(), "latest_known").otherwise("none")
    return j.select("symbol", "quarter", "days", F.col("_b.isin").alias("isin"), basis.alias("isin_basis"), F.coalesce("tier", F.lit("untiered")).alias("tier"), status.alias("status"))


def recovery_targets(scrips: DataFrame, quarters: DataFrame, filings: DataFrame, log: DataFrame, max_lag: int = 400) -> DataFrame:
    """(scrip, missing, usable, outcome) of the non-active scrips (scrip, active) that lack filings and were not tried before (`log`: scrip).

    A scrip lacks the quarters, of those it was a member of (scrip, quarter), that it
    has no filing for. With a filing (scrip, quarter, broadcast) within `max_lag` days
    of its quarter it counts as recovered, without as nothing_usable, and without any as never_filed.
    """
    missing = quarters.join(filings.select("scrip", "quarter").distinct(), ["scrip", "quarter"], "left_anti").groupBy("scrip").agg(F.count(F.lit(1)).alias("missing"))
    lag = F.datediff("broadcast", "quarter")
    used = filings.groupBy("scrip").agg(F.count(F.when(lag <= max_lag, 1)).alias("usable"))
    targets = scrips.where("NOT active").join(missing, "scrip").join(log.select("scrip").distinct(), "scrip", "left_anti").join(used, "scrip", "left")
    outcome = F.when(F.col("usable").isNull(), "never_filed").when(F.col("usable") > 0, "recovered").otherwise("nothing_usable")
    return targets.select("scrip", "missing", F.coalesce("usable", F.lit(0)).alias("usable"), outcome.alias("outcome"))


def pledge_risk(trades: DataFrame, least: float = 1e7) -> DataFrame:
    """(event_id, symbol, filing_date, value_cr) of pledges of a value that counts."""
    return trades.where((F.col("transaction_type") == "Pledge") & (F.col("value") >= least)).select("event_id", "symbol", "filing_date", (F.col("value") / 1e7).alias("value_cr"))


def recency_score(trades: DataFrame, day: str, days: int) -> DataFrame:
    """(symbol, score, pledge): 50 plus or minus what a symbol's freshest trade before the day still weighs, and whether one was a pledge."""
    aged = trades.withColumn("_age", F.datediff(F.lit(day).cast("date"), "filing_date")).where((F.col("_age") > 0) & (F.col("_age") <= days))
    weight = 50 + F.when(F.col("transaction_type") == "Buy", 50).otherwise(-50) * (1 - F.col("_age") / float(days))
    return aged.groupBy("symbol").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.max(weight))).alias("score"), F.max((F.col("transaction_type") == "Pledge").cast("int")).alias("pledge"))
