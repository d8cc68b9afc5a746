"""What may be relied on: registered claims, filing lags, shadow events, and fundamentals from raw statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof
from .series import forward_labels


def gate_violations(registry: DataFrame, results: DataFrame, weights: DataFrame, tiers: DataFrame) -> DataFrame:
    """(signal, rule, observed): where practice departs from the registered claims; no rows, no violation.

    `registry` (signal, status, least_mean, least_t, least_late) registers each signal
    as scored, context or killed with what its validation must exceed (mean and mean
    of the later half) or reach (t); `results` (signal, mean, t_stat, late) is the
    latest validation, `weights` (signal, weight) and `tiers` (signal) what is used
    and scored. Scored signals need a scored registration and a result that meets it;
    killed ones have neither weight nor tier.
    """
    known = registry.select("signal", "status")
    named = lambda df, rule, observed: df.select("signal", F.lit(rule).alias("rule"), observed.cast("double").alias("observed"))
    none = F.lit(None)
    used = tiers.select("signal").distinct().join(known, "signal", "left")
    held = registry.where("status = 'scored'").join(results.withColumn("_has", F.lit(True)), "signal", "left")
    killed = known.where("status = 'killed'")
    out = named(used.where("status IS NULL OR status <> 'scored' AND status <> 'killed'"), "scored without registration", none)
    short = {
        "no result": (F.col("_has").isNull(), none), "mean too low": (~(F.col("mean") > F.col("least_mean")), F.col("mean")),
        "t too low": (~(F.col("t_stat") >= F.col("least_t")), F.col("t_stat")), "later half too low": (~(F.col("late") > F.col("least_late")), F.col("late")),
    }
    for rule, (broken, observed) in short.items():
        out = out.unionByName(named(held.where(broken), rule, observed))
    out = out.unionByName(named(killed.join(weights.groupBy("signal").agg(F.sum(F.abs("weight")).alias("_w")), "signal").where("_w <> 0"), "killed but weighted", F.col("_w")))
    return out.unionByName(named(killed.join(tiers.select("signal").distinct(), "signal"), "killed but scored", none))


def filing_lag_gate(filings: DataFrame, most: int = 400, least: int = 1) -> DataFrame:
    """(quarter_end, filings, retro, usable, good, in_window) of every quarter, from (quarter_end, broadcast).

    A filing is usable if it was broadcast within `most` days of the quarter's end; the
    others are retro uploads. A quarter is good with at least `least` usable filings.
    The usable window is the longest run of good quarters without a gap in the
    calendar, the first of equal ones.
    """
    lag = F.datediff("broadcast", "quarter_end")
    by_quarter = filings.groupBy("quarter_end").agg(
        F.count(F.lit(1)).alias("filings"), F.count(F.when(lag > most, 1)).alias("retro"), F.count(F.when(lag <= most, 1)).alias("usable")
    ).withColumn("good", F.col("usable") >= least)
    number = F.year("quarter_end") * 4 + F.quarter("quarter_end")
    order = Window.orderBy("quarter_end")  # a row per quarter, here and below
    good = by_quarter.where("good").withColumn("_run", number - F.row_number().over(order))
    run = Window.partitionBy("_run")
    good = good.withColumns({"_n": F.count(F.lit(1)).over(run), "_first": F.min("quarter_end").over(run)})
    best = good.agg(F.max(F.struct("_n", (-F.unix_date("_first")).alias("_f"))).alias("_best"))
    window = good.join(F.broadcast(best), (F.col("_n") == F.col("_best._n")) & (-F.unix_date("_first") == F.col("_best._f"))).select("quarter_end", F.lit(True).alias("in_window"))
    return by_quarter.join(window, "quarter_end", "left").withColumn("in_window", F.coalesce("in_window", F.lit(False)))


HORIZONS = (21, 63, 126)


def shadow_returns(events: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, event_date, event_type, entry_date, ret_21, filled_21, ...): returns from the first close after an event; a horizon is filled once it has passed."""
    forward = forward_labels(bars.where("close > 0"), {f"ret_{h}": h for h in horizons})
    names = [f"ret_{h}" for h in horizons]
    at = asof(events.select("symbol", "event_date", "event_type").distinct(), forward.select("symbol", "date", *names), ["symbol"], "event_date", "date", names, forward=True, strict=True)
    filled = [c for h in horizons for c in (f"ret_{h}", F.col(f"ret_{h}").isNotNull().alias(f"filled_{h}"))]
    return at.where("matched_on IS NOT NULL").select("symbol", "event_date", "event_type", F.col("matched_on").alias("entry_date"), *filled)


def shadow_board(shadows: DataFrame, horizon: int = 63, least: int = 30) -> DataFrame:
    """(event_type, n, filled, hit, mean, enough): how events whose horizon has passed did; `enough` of them may be judged."""
    r = F.when(F.col(f"filled_{horizon}"), F.col(f"ret_{horizon}"))
    board = shadows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(r).alias("filled"), F.avg((r > 0).cast("double")).alias("hit"), F.avg(r).alias("mean"))
    return board.withColumn("enough", F.col("filled") >= least)


def first_of(json: str, *keys: str) -> Column:
    """The first of several keys that an object of figures holds."""
    figures = F.from_json(json, "map<string,double>")
    return F.coalesce(*(F.try_element_at(figures, F.lit(k)) for k in keys))


def fundamentals_features(income: DataFrame, balance: DataFrame, dates: DataFrame) -> DataFrame:
    """(symbol, report_date, pit_date, eps, net_income, revenue, total_equity, roe) of the statements with a known publication.

    `income` and `balance` (symbol, report_date, data_json) hold figures under any of
    their usual names. Return on equity is by positive equity only.
    """
    made = income.select(
        "symbol", "report_date", first_of("data_json", "Diluted EPS", "Basic EPS").alias("eps"),
        first_of("data_json", "Net Income", "Net Income Common Stockholders").alias("net_income"), first_of("data_json", "Total Revenue", "Operating Revenue").alias("revenue"))
    equity = balance.select(
        "symbol", "report_date", first_of("data_json", "Stockholders Equity", "Total Equity Gross Minority Interest", "Common Stock Equity").alias("total_equity"))
    both = made.join(equity, ["symbol", "report_date"], "left").join(dates.select("symbol", "report_date", "pit_date").where("pit_date IS NOT NULL"), ["symbol", "report_date"])
    roe = F.when(F.col("total_equity") > 0, F.col("net_income") / F.col("total_equity"))
    return both.select("symbol", "report_date", "pit_date", "eps", "net_income", "revenue", "total_equity", roe.alias("roe"))


#: The lines of an annual statement that are kept.
KEPT = [
    "Sales", "Expenses", "Operating Profit", "OPM %", "Other Income", "Interest", "Depreciation", "Profit before tax", "Net Profit", "EPS in Rs", "Revenue",
    "Financing Profit", "Financing Margin %",
]
#: The month in which a fiscal year ends, and the month counted for any other word.
YEAR_ENDS = {"Mar": 3, "Jun": 6, "Sep": 9, "Dec": 12}


def annual_pit(lines: DataFrame, lag: int = 60) -> DataFrame:
    """(symbol, fiscal_year, report_date, pit_date, pit_estimated, metric, value) of the kept lines (symbol, fiscal_year like `Mar 2015`, field, value).

    Publication is estimated as `lag` days after the year's end. Years that name no
    year are left out; of lines that repeat, the largest value is kept.
    """
    parts = F.split(F.trim("fiscal_year"), r"\s+")
    month = F.coalesce(F.create_map(*[F.lit(x) for k, v in YEAR_ENDS.items() for x in (k, v)])[parts[0]], F.lit(YEAR_ENDS["Mar"]))
    year = F.try_element_at(parts, F.lit(2)).try_cast("int")
    kept = lines.where(F.col("field").isin(KEPT)).withColumn("report_date", F.last_day(F.make_date(year, month, F.lit(1)))).where("report_date IS NOT NULL")
    once = kept.groupBy("symbol", "fiscal_year", "report_date", F.col("field").alias("metric")).agg(F.max("value").alias("value"))
    return once.select("symbol", "fiscal_year", "report_date", F.date_add("report_date", lag).alias("pit_date"), F.lit(1).alias("pit_estimated"), "metric", "value")


def validated_depth(figures: DataFrame, other: DataFrame, tolerance: float = 0.25, least: int = 8, floor: float = 1.0) -> DataFrame:
    """(symbol, depth, validated, eligible): years of a figure (symbol, year, value), and whether a second source of it agrees in one of them.

    A year agrees if the values differ by at most `tolerance` of the other's, which must exceed `floor`.
    """
    both = figures.join(other.select("symbol", "year", F.col("value").alias("_o")), ["symbol", "year"], "left")
    agrees = (F.abs("_o") > floor) & (F.abs(F.col("value") - F.col("_o")) <= tolerance * F.abs("_o"))
    found = both.groupBy("symbol").agg(F.count_distinct("year").alias("depth"), F.max(F.coalesce(agrees, F.lit(False)).cast("int")).alias("validated"))
    return found.withColumn("eligible", (F.col("depth") >= least) & (F.col("validated") == 1))
