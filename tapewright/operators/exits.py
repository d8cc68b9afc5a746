"""Exit simulation: what each way to leave a trade would have made of its path, and which way is worth adopting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof

#: Stops and targets at multiples of the distance from entry to stop.
WIDER = {"current": 1.0, "wide_1.25x": 1.25, "wide_1.5x": 1.5, "wide_2x": 2.0}
TRAIL, TIME = "trail_atr3", "time_only"
VARIANTS = [*WIDER, TRAIL, TIME]
TRADE = ["symbol", "entry_date", "entry", "target", "stop"]


def numbered(bars: DataFrame, average: int = 14) -> DataFrame:
    """Bars with their number in the symbol and the average true range of the last `average` bars, once all have a bar before them and one more."""
    w = Window.partitionBy("symbol").orderBy("date")
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    own = bars.select("symbol", "date", "high", "low", "close", F.row_number().over(w).alias("n"), true_range.alias("_tr"))
    return own.withColumn("atr", F.when(F.col("n") > average + 1, F.avg("_tr").over(w.rowsBetween(1 - average, 0)))).drop("_tr")


def exit_variants(trades: DataFrame, bars: DataFrame, days: int = 21, reward: float = 2.0, trail: float = 3.0) -> DataFrame:
    """One row per trade (symbol, entry_date, entry, target, stop) and variant: outcome, exit_date, realized, r, mfe, mae.

    A path is the first bar after the entry date and the `days` bars that follow.
    A bar that touches both levels counts as stopped.

    current, wide_*  the stop at a multiple of the distance d from entry to stop, the target `reward` times as far
    trail_atr3       no target; the stop rises with the highest close so far less `trail` times the average true
                     range at the entry (d where that is unknown or zero), and never falls
    time_only        neither; the last close of the path

    `r` is the realized return in units of the variant's d, `mfe` and `mae` the
    best high and worst low up to the exit as returns, at least and at most 0. All
    variants come from one window over the path. Trades without a positive stop
    below the entry, or without a bar after it, have no rows; equal trades count once.
    """
    b = numbered(bars)
    valid = trades.select(*TRADE).where("entry > stop AND stop > 0 AND target > 0").distinct()
    at = asof(valid, b.select("symbol", "date", "n", "atr"), ["symbol"], "entry_date", "date", ["n", "atr"]).drop("matched_on")
    first = F.coalesce("n", F.lit(0)) + 1
    asked = at.select(*TRADE, F.col("atr").alias("_atr"), F.explode(F.sequence(first, first + days)).alias("n"))
    path = asked.join(b.drop("atr"), ["symbol", "n"])
    so_far = Window.partitionBy(*TRADE).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumns({"_up": F.max("high").over(so_far), "_down": F.min("low").over(so_far), "_peak": F.greatest("entry", F.max("close").over(so_far))})
    d = F.col("entry") - F.col("stop")
    rising = F.greatest(F.col("stop"), F.col("_peak") - trail * F.coalesce(F.nullif("_atr", F.lit(0.0)), d))
    levels: dict[str, tuple[Column | None, Column | None]] = {v: (F.col("entry") - k * d, F.col("entry") + reward * k * d) for v, k in WIDER.items()}
    levels |= {TRAIL: (rising, None), TIME: (None, None)}

    def at_bar(outcome: Column, price: Column) -> Column:
        return F.struct("n", outcome.alias("outcome"), F.col("date").alias("exit_date"), price.alias("price"), "_up", "_down")

    def touched(stop: Column | None, target: Column | None) -> Column:
        hit = F.lit(None).cast(at_none)
        if target is not None:
            hit = F.when(F.col("high") >= target, at_bar(F.lit("target"), target)).otherwise(hit)
        if stop is not None:
            hit = F.when(F.col("low") <= stop, at_bar(F.lit("stop"), stop)).otherwise(hit)
        return hit

    expiry = at_bar(F.lit("expired"), F.col("close"))
    at_none = path.select(expiry.alias("x")).schema["x"].dataType
    touches = [F.min(touched(*levels[v])).alias(v) for v in VARIANTS]
    ends = path.groupBy(*TRADE).agg(*touches, F.max(expiry).alias("_end"))
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(WIDER.get(v, 1.0)).alias("k"), F.coalesce(F.col(f"`{v}`"), F.col("_end")).alias("x")) for v in VARIANTS))
    out = ends.select(*TRADE, F.inline(each)).withColumn("realized", F.col("x.price") / F.col("entry") - 1)
    zero = F.lit(0.0)
    return out.select(
        *TRADE, "variant", "x.outcome", "x.exit_date", "realized", (F.col("realized") * F.col("entry") / (F.col("k") * d)).alias("r"),
        F.greatest(zero, F.col("x._up") / F.col("entry") - 1).alias("mfe"), F.least(zero, F.col("x._down") / F.col("entry") - 1).alias("mae"),
    )


def split_in_time(trades: DataFrame, share: float = 0.70, date: str = "entry_date", by: tuple[str, ...] = ("symbol", "entry", "target", "stop")) -> DataFrame:
    """Add `train`: whether a trade is among the first `share` of all in order of date (of one date, in order of `by`)."""
    days = trades.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))  # a row per date
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(date, (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.floor(share * F.sum("_n").over(Window.partitionBy())).alias("_cut"))
    own = F.row_number().over(Window.partitionBy(date).orderBy(*by))
    return trades.join(days, date).withColumn("train", F.col("_before") + own <= F.col("_cut")).drop("_before", "_cut")


def calibrated(outcomes: DataFrame, share: float = 0.70, capture: float = 0.60, least_mfe: float = 0.005) -> DataFrame:
    """One row per variant: expectancy in R before and after the split, hit and stop rate, median MFE capture, and the verdict.

    A variant other than the current one is worth adopting if its expectancy is
    higher on both sides of the split and winners keep at least `capture` of their
    best excursion after it; of several, the one that gains most after the split
    (the first of VARIANTS among equals) is ADOPTed. Otherwise the current one is KEPT.
    """
    sides = split_in_time(outcomes.where("variant = 'current'").select(*TRADE), share).select(*(F.col(c).alias(f"_{c}") for c in TRADE), "train")
    same = [F.col(c) == F.col(f"_{c}") for c in TRADE]
    dealt = outcomes.join(sides, same)
    train, test = F.col("train"), ~F.col("train")
    kept = F.when(test & (F.col("mfe") > least_mfe) & (F.col("realized") > 0), F.col("realized") / F.col("mfe"))
    rate = lambda c: F.avg(F.when(test, c.cast("double")))
    found = dealt.groupBy("variant").agg(
        F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(test, 1)).alias("n_test"),
        F.avg(F.when(train, F.col("r"))).alias("exp_train"), F.avg(F.when(test, F.col("r"))).alias("exp_test"), rate(F.col("r") > 0).alias("hit_test"),
        rate(F.col("outcome") == "stop").alias("stop_test"), F.median(kept).alias("mfe_capture"),
    )
    every = Window.partitionBy()  # six rows
    current = F.col("variant") == "current"
    base = lambda c: F.max(F.when(current, F.col(c))).over(every)
    gain = F.col("exp_test") - base("exp_test")
    better = ~current & (F.col("exp_train") > base("exp_train")) & (gain > 0) & (F.col("mfe_capture") >= capture)
    turn = F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant"))
    found = found.withColumn("_gain", F.when(better, gain)).withColumn("_turn", turn)
    best = F.max(F.when(F.col("_gain").isNotNull(), F.struct("_gain", -F.col("_turn")))).over(every)
    chosen = F.struct("_gain", -F.col("_turn")) == best
    verdict = F.when(F.col("_gain").isNotNull() & chosen, "ADOPT").when(current & best.isNull(), "KEEP").otherwise("reject")
    return found.withColumn("verdict", verdict).drop("_gain", "_turn")


def whipsaw(outcomes: DataFrame) -> DataFrame:
    """(stopped, reversed, share): trades that the current stop took out, and those of them whose path had reached the trade's own target."""
    stopped = outcomes.where("variant = 'current' AND outcome = 'stop'")
    back = F.count(F.when(F.col("mfe") >= F.col("target") / F.col("entry") - 1, 1))
    return stopped.agg(F.count(F.lit(1)).alias("stopped"), back.alias("reversed")).withColumn("share", F.col("reversed") / F.greatest("stopped", F.lit(1)))
