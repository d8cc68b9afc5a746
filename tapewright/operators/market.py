"""The sector engine and the ranked lists of market intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import by_symbol, rank_pct
from .series import sma_distance


def rotation(strength: Column, momentum: Column) -> Column:
    """The quadrant of relative strength and its change; null where either is unknown."""
    up = strength > 0
    return F.when(strength.isNotNull() & momentum.isNotNull(), F.when(momentum > 0, F.when(up, "leading").otherwise("improving")).otherwise(F.when(up, "weakening").otherwise("lagging")))


def sector_engine(bars: DataFrame, sectors: DataFrame, index: DataFrame, window: int = 63, back: int = 21, least: int = 5, start: str | None = None) -> DataFrame:
    """(sector, date, rs, rs_mom, rank, score, quadrant, breadth, members) of each date on which a sector trades.

    A sector's level compounds the mean return of its members; `rs` is its change
    over `window` rows less that of the index (date, close), `rs_mom` its change over
    `back` rows. Rank (1 is strongest; ties share their average, rounded down) and
    score (percentile, 100 is strongest) compare the sectors of a date. Breadth is
    the share of members above their 200-day average, in per cent, where at least
    `least` have a return; sectors of fewer mapped symbols are left out.
    """
    large = sectors.groupBy("sector").agg(F.count_distinct("symbol").alias("_n")).where(F.col("_n") >= least).select("sector")
    mapped = sectors.select("symbol", "sector").join(large, "sector")
    own = sma_distance(bars).withColumn("_r", F.col("close") / F.lag("close").over(by_symbol()) - 1).join(mapped, "symbol")
    daily = own.groupBy("sector", "date").agg(F.avg("_r").alias("_ret"), F.count("_r").alias("members"), (100 * F.avg("above_200")).alias("_above"))
    by_sector = Window.partitionBy("sector").orderBy("date")
    upto = by_sector.rowsBetween(Window.unboundedPreceding, 0)
    level = F.exp(F.sum(F.log1p(F.coalesce("_ret", F.lit(0.0)))).over(upto))
    daily = daily.withColumn("_level", level)
    calendar = Window.orderBy("date")  # a row per market date
    market = index.select("date", (F.col("close") / F.lag("close", window).over(calendar) - 1).alias("_index"))
    rs = daily.join(market, "date", "left").withColumn("rs", F.col("_level") / F.lag("_level", window).over(by_sector) - 1 - F.col("_index"))
    rs = rs.withColumn("rs_mom", F.col("rs") - F.lag("rs", back).over(by_sector)).where("rs IS NOT NULL")
    if start:
        rs = rs.where(F.col("date") >= F.lit(start).cast("date"))
    among = Window.partitionBy("date")
    return rs.withColumn("score", 100 * rank_pct("rs", "date")).select(
        "sector", "date", "rs", "rs_mom", F.floor((100 - F.col("score")) / 100 * F.count(F.lit(1)).over(among) + 1 + 1e-9).cast("int").alias("rank"), "score",
        rotation(F.col("rs"), F.col("rs_mom")).alias("quadrant"), F.when(F.col("members") >= least, F.col("_above")).alias("breadth"), "members")


def since_last(df: DataFrame, date: str, days: int) -> DataFrame:
    """The rows of the last `days` days before, and of, the latest date."""
    last = df.agg(F.date_sub(F.max(date), days).alias("_from"))
    return df.crossJoin(F.broadcast(last)).where(F.col(date) >= F.col("_from")).drop("_from")  # one row


def at_last(df: DataFrame, date: str) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.max(date).alias(date))), date)  # one row


#: What price and open interest did together, and how it is read.
BUILD_UPS = {(1, 1): "Long buildup (bullish)", (1, -1): "Short buildup (bearish)", (-1, 1): "Short covering", (-1, -1): "Long unwinding"}


def market_intel(
    insiders: DataFrame, deals: DataFrame, interest: DataFrame, ratios: DataFrame, cluster_days: int = 120, deal_days: int = 30, least: int = 3,
    clusters: int = 12, accumulated: int = 10, build_ups: int = 6, extremes: int = 5,
) -> DataFrame:
    """(category, symbol, detail, value): ranked lists in one long table, each the top of its own window.

    insiders  (symbol, filing_date, name, value) of buys: symbols that at least `least` persons bought
    deals     (symbol, date, net): net value bought in bulk, where positive
    interest  (symbol, date, oi, doi, ret) of the latest date: the largest changes of open interest in
              each of the four directions of price and interest; value is the return in per cent
    ratios    (symbol, date, pcr) of the latest date: the highest and the lowest put-call ratios

    Equal rows of a list are ordered by symbol.
    """

    def top(df: DataFrame, category: Column, detail: Column, value: Column, order: Column, n: int) -> DataFrame:
        rows = df.select(category.alias("category"), "symbol", detail.alias("detail"), value.cast("double").alias("value"), F.round(order, 9).alias("_o"))
        return rows.orderBy(F.desc("_o"), "symbol").limit(n).drop("_o")

    bought = since_last(insiders, "filing_date", cluster_days).groupBy("symbol").agg(
        F.count_distinct("name").alias("n"), F.sum(F.greatest("value", F.lit(0))).alias("v")).where(F.col("n") >= least)
    net = since_last(deals, "date", deal_days).groupBy("symbol").agg(F.sum("net").alias("net")).where("net > 0")
    moved = at_last(interest, "date").where("doi IS NOT NULL AND ret IS NOT NULL").withColumn("change", 100 * F.try_divide("doi", F.col("oi") - F.col("doi")))
    moved = moved.where("change IS NOT NULL")
    share = F.concat(F.lit("OI "), F.round("change", 0).cast("long").cast("string"), F.lit("%"))
    pcr = at_last(ratios, "date").where("pcr IS NOT NULL")
    lists = [
        top(bought, F.lit("Insider cluster-buy"), F.concat(F.col("n").cast("string"), F.lit(" insiders")), F.col("v"), F.col("n"), clusters),
        top(net, F.lit("Bulk-deal accumulation"), F.lit("net buy"), F.col("net"), F.col("net"), accumulated),
        top(pcr, F.lit("High PCR (puts heavy)"), F.lit("PCR"), F.col("pcr"), F.col("pcr"), extremes),
        top(pcr.where("pcr > 0"), F.lit("Low PCR (calls heavy)"), F.lit("PCR"), F.col("pcr"), -F.col("pcr"), extremes),
    ]
    for (interest_up, price_up), name in BUILD_UPS.items():
        own = moved.where((F.col("doi") > 0 if interest_up > 0 else F.col("doi") <= 0) & (F.col("ret") > 0 if price_up > 0 else F.col("ret") <= 0))
        lists.append(top(own, F.lit(name), share, 100 * F.col("ret"), F.abs("change"), build_ups))
    out = lists[0]
    for each in lists[1:]:
        out = out.unionByName(each)
    return out
