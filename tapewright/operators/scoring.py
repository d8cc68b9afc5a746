"""Recommendations, risk bands and scored cards from the feature panel and technical columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clip
from .asof import asof
from .strategies import COMPOSITE, mean_rank

#: Fixed weights of the pillars; the last is a penalty.
WEIGHTS = {
    "signal_strength": 0.35, "trend_align": 0.18, "regime_align": 0.15, "confirmation": 0.12, "liquidity_capacity": 0.10,
    "event_score": 0.10, "risk_penalty": -0.10,
}
FUND_CAP, FUND_MIN_YEARS = 70.0, 8


def clamp(c: Column) -> Column:
    return clip(c, 0.0, 100.0)


def recommend(panel: DataFrame, picks: int = 15, horizon: int = 21, target: float = 1.5, stop: float = 1.0) -> DataFrame:
    """(entry_date, symbol, score, entry, target, stop): the best composites of each date with bands of horizon volatility."""
    known = panel.where(" AND ".join(f"{c} IS NOT NULL" for c in [*COMPOSITE, "close"]))
    order = Window.partitionBy("rebal_date").orderBy(F.desc("composite"), "symbol")
    best = mean_rank(known, COMPOSITE).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= picks)
    sigma = F.col("vol_3m") * (horizon / 252) ** 0.5
    return best.select(
        F.col("rebal_date").alias("entry_date"), "symbol", (F.col("composite") * 100).alias("score"), F.col("close").alias("entry"),
        (F.col("close") * (1 + target * sigma)).alias("target"), (F.col("close") * (1 - stop * sigma)).alias("stop"),
    )


def bands(cards: DataFrame, capital: float = 1e7, risk: float = 1e4, widest: float = 0.10, largest: float = 0.10, multiple: float = 2.0) -> DataFrame:
    """Add timeframe, atr_k, stop, target and size to (entry, atr_pct, adx, dist_sma200, ...).

    Strong trends (ADX of 25 or more above the 200-day average) are positional and
    get the wider multiple of the average true range; a stop is never wider than
    `widest`, the target is `multiple` stops away, and a position risks at most
    `risk` and holds at most `largest` of the capital. Cards whose range is
    useless or whose size is below one share are left out.
    """
    strong = (F.coalesce("adx", F.lit(0.0)) >= 25) & (F.coalesce("dist_sma200", F.lit(0.0)) > 0)
    span = F.col("atr_pct") / 100
    made = cards.where((F.col("entry") > 0) & (span > 0) & (span < 0.9)).withColumns(
        {"timeframe": F.when(strong, "positional").otherwise("swing"), "atr_k": F.when(strong, 2.75).otherwise(1.75)}
    )
    cents = lambda c: F.round(F.round(c, 6), 2)  # noqa: E731  (first without the noise of binary fractions)
    made = made.withColumn("stop", cents(F.col("entry") - F.least(F.col("entry") * F.col("atr_k") * span, F.col("entry") * widest)))
    away = F.col("entry") - F.col("stop")
    made = made.where(away > 0).withColumn("target", cents(F.col("entry") + multiple * away))
    size = F.least(F.floor(F.lit(risk) / away), F.floor(F.lit(largest * capital) / F.col("entry")))
    return made.withColumn("size", size.cast("long")).where("size >= 1 AND stop < entry AND entry < target")


def event_score(cards: DataFrame, events: DataFrame, horizons: dict[str, int] | None = None, default: int = 63) -> DataFrame:
    """Add event_score (50: none) and at_risk from (symbol, event_date, tier, direction) strictly before the card's date.

    An event counts for as many days as `horizons` says of its event_type, or
    `default`. Of the bullish scored ones that still count, the strongest lifts the
    score, by 50 less what has faded linearly; bearish ones don't lower it. Of one
    horizon the freshest event is the strongest, so each horizon is one as-of join.
    """
    by_days: dict[int, list[str]] = {}
    for kind, days in (horizons or {}).items():
        by_days.setdefault(days, []).append(kind)
    groups = [(days, F.col("event_type").isin(kinds)) for days, kinds in by_days.items()]
    others = ~F.coalesce(F.col("event_type").isin(list(horizons)), F.lit(False)) if horizons else F.lit(True)
    tiers = {"_bull": "tier = 'scored' AND direction = 'bullish'", "_risk": "tier = 'risk'"}
    at, found = cards, {t: [] for t in tiers}
    for days, own in [*groups, (default, others)]:
        for tier, which in tiers.items():
            name = f"{tier}{len(found[tier])}"
            rows = events.where(which).where(own).select("symbol", "event_date")
            at = asof(at, rows, ["symbol"], "rebal_date", "event_date", [], strict=True, max_days=days).withColumnRenamed("matched_on", name)
            found[tier].append((name, days))
    lifts = [F.coalesce(clamp(50 + 50 * (1 - F.datediff("rebal_date", name) / days)), F.lit(50.0)) for name, days in found["_bull"]]
    risks = [F.col(name).isNotNull() for name, _ in found["_risk"]]
    out = at.withColumns({"event_score": F.greatest(F.lit(50.0), *lifts), "at_risk": reduce(lambda a, b: a | b, risks)})
    return out.drop(*(name for names in found.values() for name, _ in names))


def pillars(cards: DataFrame) -> DataFrame:
    """(rebal_date, symbol, seven sub-scores of 0 to 100) of cards with composite, technical, delivery, event and vote columns."""
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    rank = F.cume_dist().over(Window.partitionBy("rebal_date").orderBy(F.col("turnover").asc_nulls_last())) * 100
    return cards.select(
        "rebal_date", "symbol", clamp(F.col("composite") * 100).alias("signal_strength"),
        (0.5 * clamp(50 + or_zero(F.col("dist_sma200") * 100)) + 0.5 * clamp(or_zero(F.col("adx")) * 2)).alias("trend_align"),
        (F.coalesce("votes", F.lit(0)) / 4 * 100).alias("regime_align"), clamp(F.coalesce("deliv_1m", F.lit(50.0))).alias("confirmation"),
        F.when(F.col("turnover").isNull(), 50.0).otherwise(rank).alias("liquidity_capacity"), "event_score",
        clamp(or_zero(F.col("atr_pct")) * 10 + F.when(F.col("at_risk"), 25).otherwise(0)).alias("risk_penalty"),
    )


def statement_years(statements: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    """(symbol, years): distinct fiscal years of a symbol's statements, or its validated (symbol, depth) where that is more."""
    base = statements.groupBy("symbol").agg(F.count_distinct(F.year("quarter")).alias("years"))
    if validated is None:
        return base
    return base.join(validated, "symbol", "left").select("symbol", F.greatest("years", F.coalesce("depth", F.lit(0))).alias("years"))


def confidence(scored: DataFrame, years: DataFrame, thesis: Column) -> DataFrame:
    """Audit rows (rebal_date, symbol, thesis, pillar, subscore, weight, contribution, confidence).

    Confidence is the clamped sum of contributions; value and quality theses of
    symbols with too few years of statements can't exceed the cap.
    """
    weight = F.create_map(*[F.lit(x) for p, w in WEIGHTS.items() for x in (p, w)])
    long = scored.withColumn("thesis", thesis).unpivot(["rebal_date", "symbol", "thesis"], list(WEIGHTS), "pillar", "subscore")
    long = long.withColumn("weight", weight[F.col("pillar")]).withColumn("contribution", F.col("weight") * F.col("subscore"))
    total = clamp(F.sum("contribution").over(Window.partitionBy("rebal_date", "symbol")))
    short = F.col("thesis").isin("value", "quality") & (F.coalesce("years", F.lit(0)) < FUND_MIN_YEARS)
    return long.join(years, "symbol", "left").withColumn("confidence", F.when(short, F.least(total, F.lit(FUND_CAP))).otherwise(total)).drop("years")
