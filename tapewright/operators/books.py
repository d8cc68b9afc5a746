"""Portfolio books: weights, turnover, costs and gates. A previous book is the row before in a window, never a loop."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import norm_cdf, norm_ppf, rank_pct, ratio


def dated(book: DataFrame, date: str = "rebal_date") -> DataFrame:
    """`book` with `_i`, the place of each row's date among the dates of the book: one row per date is numbered and given back."""
    places = book.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    return book.join(F.broadcast(places), date)  # a row per rebalance date


def weight_diff(book: DataFrame, date: str = "rebal_date") -> DataFrame:
    """Weights with the change against the previous date; symbols that left have weight 0.

    Each holding is sent to its own date and, negated, to the next one, so a sum
    per date and symbol gives the change without a join.
    """
    places = book.select(date).distinct().withColumn("_next", F.lead(date).over(Window.orderBy(date)))
    sent = F.array(
        F.struct(F.col(date).alias("d"), F.col("weight").alias("now"), F.col("weight").alias("change")),
        F.struct(F.col("_next").alias("d"), F.lit(0.0).alias("now"), (-F.col("weight")).alias("change")),
    )
    both = book.join(F.broadcast(places), date).select("symbol", F.explode(sent).alias("x")).where("x.d IS NOT NULL")
    return both.groupBy(F.col("x.d").alias(date), "symbol").agg(F.sum("x.now").alias("weight"), F.sum("x.change").alias("delta"))


def normalized(book: DataFrame, date: str = "rebal_date") -> DataFrame:
    return book.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(date)))


def portfolio(book: DataFrame, bps: float = 30.0, date: str = "rebal_date") -> DataFrame:
    """Gross and net return, turnover and equity per date of a weighted book (rebal_date, symbol, weight, realized)."""
    b = normalized(book, date)
    gross = b.groupBy(date).agg(F.sum(F.col("weight") * F.col("realized")).alias("gross"), F.count(F.lit(1)).alias("names"))
    turn = weight_diff(b, date).groupBy(date).agg(F.sum(F.abs("delta")).alias("turnover"))
    p = gross.join(turn, date).withColumn("net", F.col("gross") - F.col("turnover") * bps / 1e4)
    return p.withColumn("equity", F.product(1 + F.col("net")).over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))


def leg_changes(book: DataFrame, leg: str = "strategy", date: str = "rebal_date") -> DataFrame:
    """(leg, date, symbol, weight, delta) of several books at once: each book's weights against those of its own previous date."""
    places = book.select(leg, date).distinct().withColumn("_next", F.lead(date).over(Window.partitionBy(leg).orderBy(date)))
    sent = F.array(
        F.struct(F.col(date).alias("d"), F.col("weight").alias("now"), F.col("weight").alias("change")),
        F.struct(F.col("_next").alias("d"), F.lit(0.0).alias("now"), (-F.col("weight")).alias("change")),
    )
    both = book.join(F.broadcast(places), [leg, date]).select(leg, "symbol", F.explode(sent).alias("x")).where("x.d IS NOT NULL")  # a row per book and date
    return both.groupBy(leg, F.col("x.d").alias(date), "symbol").agg(F.sum("x.now").alias("weight"), F.sum("x.change").alias("delta"))


def target_weights(signals: DataFrame, returns: DataFrame, leg: str = "strategy", date: str = "rebal_date") -> DataFrame:
    """(leg, date, symbol, weight, realized): the positive target weights of names whose return is known, normalised by book and date."""
    held = signals.where("weight > 0").join(returns.select(date, "symbol", "realized").where("realized IS NOT NULL"), [date, "symbol"])
    return held.select(leg, date, "symbol", (F.col("weight") / F.sum("weight").over(Window.partitionBy(leg, date))).alias("weight"), "realized")


def run_books(held: DataFrame, scores: DataFrame | None = None, threshold: float = 50.0, bps: float = 30.0, leg: str = "strategy", date: str = "rebal_date") -> DataFrame:
    """(leg, date, names, gross, turnover, net, on, net_gated, equity) of the books that `target_weights` gives.

    Turnover is the sum of absolute changes of weight, at `bps` a unit. A date whose
    gate score (date, score) is below the threshold is held in cash; one without a
    score is invested. Equity compounds the gated net returns of a book.
    """
    gross = held.groupBy(leg, date).agg(F.count(F.lit(1)).alias("names"), F.sum(F.col("weight") * F.col("realized")).alias("gross"))
    turn = leg_changes(held, leg, date).groupBy(leg, date).agg(F.sum(F.abs("delta")).alias("turnover"))
    p = gross.join(turn, [leg, date]).withColumn("net", F.col("gross") - F.col("turnover") * bps / 1e4)
    if scores is None:
        p = p.withColumn("on", F.lit(True))
    else:
        p = p.join(scores.select(date, "score"), date, "left").withColumn("on", F.coalesce(F.col("score") >= threshold, F.lit(True))).drop("score")
    p = p.withColumn("net_gated", F.when(F.col("on"), F.col("net")).otherwise(0.0))
    return p.withColumn("equity", F.product(1 + F.col("net_gated")).over(Window.partitionBy(leg).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))


def leg_trades(held: DataFrame, least: float = 1e-6, leg: str = "strategy", date: str = "rebal_date") -> DataFrame:
    """(leg, date, symbol, delta, side) of every change of weight that counts."""
    moved = leg_changes(held, leg, date).where(F.abs("delta") > least)
    return moved.select(leg, date, "symbol", "delta", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"))


def weighted_deciles(deciled: DataFrame, least: int = 5, floor: float = 0.05, date: str = "rebal_date") -> DataFrame:
    """(kind, date, symbol, weight) of the top decile, equally (`ew`) and inversely to volatility (`iv`) weighted, on dates that have `least` names in it."""
    top = deciled.where("decile = 10").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(date))).where(F.col("_n") >= least)
    kinds = F.array(F.struct(F.lit("ew").alias("kind"), F.lit(1.0).alias("weight")), F.struct(F.lit("iv").alias("kind"), F.when(F.col("vol_3m").isNotNull(), 1 / F.greatest("vol_3m", F.lit(floor))).alias("weight")))
    return top.select(date, "symbol", F.inline(kinds)).where("weight IS NOT NULL")


def book_returns(held: DataFrame, leg: list[str], bps: float = 30.0, date: str = "rebal_date") -> DataFrame:
    """(date, *leg, ret, cost) of equally weighted books: names that the leg did not hold on its previous date cost twice the rate."""
    w = Window.partitionBy("symbol", *leg).orderBy("_i")
    entered = F.coalesce(F.lag("_i").over(w) != F.col("_i") - 1, F.lit(True)).cast("double")
    d = dated(held, date).withColumn("_new", entered)
    return d.groupBy(date, *leg).agg(F.avg("realized").alias("ret"), (2 * F.avg("_new") * bps / 1e4).alias("cost"))


def decile_book(deciled: DataFrame, bps: float = 30.0, date: str = "rebal_date", least: int = 10) -> DataFrame:
    """Equal-weight long (10) and short (1) books: entry turnover costs twice the rate on each leg."""
    many = F.count("decile").over(Window.partitionBy(date))
    d = deciled.withColumn("_n", many).where((F.col("_n") >= least) & F.col("decile").isin(1, 10))
    g = book_returns(d, ["decile"], bps, date)
    side = lambda k, c: F.max(F.when(F.col("decile") == k, F.col(c)))
    out = g.groupBy(date).agg(side(10, "ret").alias("long_gross"), side(1, "ret").alias("short_gross"), side(10, "cost").alias("_lc"), side(1, "cost").alias("_sc"))
    return out.select(date, "long_gross", "short_gross", (F.col("long_gross") - F.col("_lc")).alias("long_net"), (F.col("long_gross") - F.col("short_gross") - F.col("_lc") - F.col("_sc")).alias("ls_net"))


def cut_grid(deciled: DataFrame, scores: DataFrame, cuts: tuple[int, ...] = (10, 9, 8), thresholds: tuple[float, ...] = (40, 50, 60), date: str = "rebal_date") -> DataFrame:
    """(cut, threshold, months, sharpe, cagr) of the gated long books of the deciles from each cut, net of costs."""
    from .stats import metrics

    held = deciled.where("decile IS NOT NULL").withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where("decile >= cut")
    net = book_returns(held, ["cut"], date=date).select(date, "cut", (F.col("ret") - F.col("cost")).alias("net")).join(scores, date, "left")
    cells = net.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    cells = cells.withColumn("ret", F.when(F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True)), F.col("net")).otherwise(0.0))
    return metrics(cells, ["cut", "threshold"], "ret", date).select("cut", "threshold", "months", "sharpe", "cagr")


def walkforward_gate(returns: DataFrame, scores: DataFrame, thresholds: list[float], least: int = 24, date: str = "rebal_date") -> DataFrame:
    """Per date the threshold whose gated past returns have the best Sharpe (ties: the lowest), applied to the date.

    Dates by thresholds is one small table; past statistics are expanding windows that end a row earlier.
    """
    r = returns.join(scores, date, "left").withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    r = r.withColumn("gated", F.when(F.coalesce(F.col("score") >= F.col("threshold"), F.lit(True)), F.col("ret")).otherwise(0.0))
    past = Window.partitionBy("threshold").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({"_n": F.count("gated").over(past), "_s": F.round(F.try_divide(F.avg("gated").over(past), F.stddev_samp("gated").over(past)), 9)})
    best = r.where(F.col("_n") >= least).groupBy(date).agg(F.max_by(F.struct("threshold", "gated"), F.struct(F.coalesce("_s", F.lit(-1e9)), -F.col("threshold"))).alias("b"))
    return best.select(date, F.col("b.threshold").alias("threshold"), F.col("b.gated").alias("ret"))


def gate_compare(challenger: DataFrame, incumbent: DataFrame, date: str = "rebal_date", per_year: int = 12) -> DataFrame:
    """(n, challenger, incumbent, ship): Sharpe ratios of two return series (date, ret) over their common dates; without spread infinite, or NaN where the mean is 0 too."""
    sharpe = lambda c: ratio(F.avg(c), F.stddev_samp(c)) * per_year**0.5
    both = challenger.select(date, F.col("ret").alias("_a")).join(incumbent.select(date, F.col("ret").alias("_b")), date)
    return both.agg(F.count(F.lit(1)).alias("n"), sharpe("_a").alias("challenger"), sharpe("_b").alias("incumbent"), (sharpe("_a") > sharpe("_b")).alias("ship"))


def ic_weighted(panel: DataFrame, signals: list[str], label: str, date: str = "rebal_date", least: int = 12) -> DataFrame:
    """Weights per date and signal: the positive part of its mean past IC, normalised."""
    from .stats import rank_ic

    long = panel.unpivot([date, "symbol", label], signals, "signal", "value").withColumn("_k", F.concat_ws("|", F.col(date).cast("string"), "signal"))
    ic = rank_ic(long, "value", label, "_k", 5).select(F.to_date(F.split("_k", r"\|")[0]).alias(date), F.split("_k", r"\|")[1].alias("signal"), "ic")
    past = Window.partitionBy("signal").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    w = ic.withColumns({"_m": F.avg("ic").over(past), "_n": F.count("ic").over(past)}).where(F.col("_n") >= least).withColumn("_w", F.greatest("_m", F.lit(0.0)))
    return w.select(date, "signal", F.coalesce(F.try_divide(F.col("_w"), F.sum("_w").over(Window.partitionBy(date))), F.lit(0.0)).alias("weight"))


def ensemble_rank(learned: DataFrame, linear: DataFrame, date: str = "rebal_date") -> DataFrame:
    """(date, symbol, score): the mean of the percentile ranks, among the names of a date that have both, of two scores (date, symbol, score).

    Equal scores share their mean rank.
    """
    both = learned.select(date, "symbol", F.round("score", 9).alias("_a")).join(linear.select(date, "symbol", F.round("score", 9).alias("_b")), [date, "symbol"]).dropna(subset=["_a", "_b"])
    return both.select(date, "symbol", ((rank_pct("_a", date) + rank_pct("_b", date)) / 2).alias("score"))


def block_bootstrap(returns: DataFrame, draws: int = 500, block: int = 6, date: str = "rebal_date", per_year: int = 12) -> DataFrame:
    """Sharpe quantiles over circular block resamples; starts come from a hash of (draw, block)."""
    spark = returns.sparkSession
    r = returns.where("ret IS NOT NULL").withColumn("i", F.row_number().over(Window.orderBy(date)) - 1).select("i", "ret")
    n = r.count()
    blocks = -(-n // block)
    picks = spark.range(draws * blocks).select((F.col("id") / blocks).cast("long").alias("draw"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("s"))
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).select("draw", F.pmod(F.col("s") + F.col("j"), F.lit(n)).alias("i"))
    s = picks.join(F.broadcast(r), "i").groupBy("draw").agg((F.avg("ret") / F.stddev_samp("ret") * per_year**0.5).alias("sharpe"))
    q = F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return s.agg(q.alias("q"), F.avg((F.col("sharpe") > 0).cast("double")).alias("p_positive")).select(*(F.col("q")[i].alias(x) for i, x in enumerate(("p05", "p50", "p95"))), "p_positive")


def psr_z(benchmark) -> Column:
    """The z score of a Sharpe ratio above a benchmark, from columns n, sr, skew and kurt."""
    sr = F.col("sr")
    spread = F.greatest(F.lit(1e-9), 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr)
    return (sr - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(spread)


def psr(returns: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """Probabilistic Sharpe ratio with bias-corrected skewness and kurtosis."""
    n = F.count("ret")
    a = returns.agg(n.alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    skew = F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2) * F.col("g1")
    kurt = (F.col("n") - 1) / ((F.col("n") - 2) * (F.col("n") - 3)) * ((F.col("n") + 1) * F.col("g2") + 6)
    a = a.withColumns({"skew": skew, "kurt": kurt + 3})
    return a.select("n", "sr", "skew", "kurt", norm_cdf(psr_z(F.lit(benchmark))).alias("psr"))


def deflated_sharpe(returns: DataFrame, trials: DataFrame, per_year: int = 12) -> DataFrame:
    """psr of `returns` against the best Sharpe ratio that as many trials (sharpe, yearly) give by luck, and that ratio, yearly.

    The expected best of N trials of variance V is sqrt(V) * ((1 - g) * z(1 - 1 / N) + g * z(1 - 1 / (N * e))), g being Euler's constant.
    """
    v = trials.agg(F.var_samp(F.col("sharpe") / per_year**0.5).alias("_v"), F.count("sharpe").alias("trials"))
    g, n = 0.5772156649015329, F.col("trials")
    once = F.try_divide(F.lit(1.0), n)  # null without trials
    best = F.sqrt("_v") * ((1 - g) * norm_ppf(1 - once) + g * norm_ppf(1 - once / math.e))
    figures = psr(returns).crossJoin(F.broadcast(v.select("trials", best.alias("_best"))))  # one row each
    z = psr_z(F.col("_best"))
    return figures.withColumns({"dsr": norm_cdf(z), "expected_best": F.col("_best") * per_year**0.5}).drop("_best")


def cpcv_paths(dates: DataFrame, groups: int = 6, date: str = "rebal_date") -> DataFrame:
    """Combinatorial purged splits: every pair of groups is a test set; training months next to a test month are purged."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy(date)) - 1
    d = dates.select(date, i.alias("_i"), F.floor(i * groups / n).cast("int").alias("_g"))
    pairs = F.array(*(F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a in range(groups) for b in range(a + 1, groups)))
    p = d.withColumn("_p", F.explode(pairs)).select(date, "_i", F.col("_p.g1").alias("g1"), F.col("_p.g2").alias("g2"), ((F.col("_g") == F.col("_p.g1")) | (F.col("_g") == F.col("_p.g2"))).alias("test"))
    w = Window.partitionBy("g1", "g2").orderBy("_i")
    beside = F.coalesce(F.lag("test").over(w), F.lit(False)) | F.coalesce(F.lead("test").over(w), F.lit(False))
    return p.select(date, "g1", "g2", F.when(F.col("test"), "test").when(beside, "purged").otherwise("train").alias("role"))


def first_touch(trades: DataFrame, bars: DataFrame, days: int = 21, target_first: bool = True) -> DataFrame:
    """Outcome of (symbol, entry_date, entry, target, stop): the first of the next `days` bars to touch a level, else expiry at the last close."""
    b = bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("date"))).select("symbol", F.col("date").alias("_d"), "_n", "high", "low", "close")
    at = trades.join(b.select("symbol", F.col("_d").alias("entry_date"), F.col("_n").alias("_n0")), ["symbol", "entry_date"])
    # each trade asks for its next bars by their number, so that no trade meets all bars of its symbol
    asked = at.withColumn("_n", F.explode(F.sequence(F.col("_n0") + 1, F.col("_n0") + days)))
    path = asked.join(b, ["symbol", "_n"])
    up, down = F.col("high") >= F.col("target"), F.col("low") <= F.col("stop")
    hit = F.when(up, "target").when(down, "stop") if target_first else F.when(down, "stop").when(up, "target")
    p = path.withColumn("_hit", hit)
    g = p.groupBy("symbol", "entry_date", "entry", "target", "stop").agg(
        F.min(F.when(F.col("_hit").isNotNull(), F.struct("_n", "_hit", "_d"))).alias("h"), F.max(F.struct("_n", "close", "_d")).alias("z"))
    out = F.coalesce("h._hit", F.lit("expired"))
    price = F.when(out == "target", F.col("target")).when(out == "stop", F.col("stop")).otherwise(F.col("z.close"))
    return g.select("symbol", "entry_date", out.alias("outcome"), F.coalesce("h._d", "z._d").alias("exit_date"), (price / F.col("entry") - 1).alias("realized"))


def greedy_book(cards: DataFrame, capital: float, date: str = "date") -> DataFrame:
    """(date, rank, symbol): per date, cards by confidence are taken while their notional still fits; one that doesn't is skipped, not the end.

    What is taken depends on all before it, so each date's cards stream through a
    task in their order; what is held in memory is the capital that is left.
    """
    kind = cards.schema[date].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, left, rank = None, 0.0, 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for d, symbol, notional in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if rank == 0 or d != day:
                    day, left, rank = d, capital, 1
                if notional is not None and notional <= left:
                    left -= notional
                    for c, v in zip(out, (d, rank, symbol)):
                        c.append(v)
                    rank += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], [date, "rank", "symbol"])

    ordered = cards.select(date, "symbol", "notional", "confidence").repartition(date).sortWithinPartitions(date, F.desc("confidence"), "symbol", "notional")
    return ordered.select(date, "symbol", "notional").mapInArrow(take, f"{date} {kind}, rank int, symbol string")


#: Drawdown from which the size is cut to the factor; the deepest also halts. Losses in a row from which it is cut, and the factor.
DRAWDOWN_STEPS = {0.10: 0.75, 0.15: 0.5, 0.22: 0.25}
STREAK, STREAK_FACTOR = 3, 0.75


def risk_curve(trades: DataFrame, risk: float = 10_000.0) -> DataFrame:
    """R multiples, P&L, equity, drawdown, losses in a row and the size multiplier after each closed trade of a strategy.

    Drawdown is measured against the high-water mark plus a hundred times the risk of
    a trade, so that a young curve doesn't brake; a trade that gains nothing is a loss.
    """
    order = Window.partitionBy("strategy").orderBy("exit_date", "trade_id")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("r", F.col("realized") / ((F.col("entry_price") - F.col("stop")) / F.col("entry_price"))).withColumn("pnl", F.col("r") * risk)
    t = t.withColumn("equity", F.sum("pnl").over(w)).withColumn("_hwm", F.greatest(F.max("equity").over(w), F.lit(0.0)))
    t = t.withColumn("drawdown", (F.col("_hwm") - F.col("equity")) / (F.col("_hwm") + 100 * risk)).withColumn("_n", F.row_number().over(order))
    t = t.withColumn("streak", F.col("_n") - F.coalesce(F.max(F.when(F.col("r") > 0, F.col("_n"))).over(w), F.lit(0)))
    by_streak = F.when(F.col("streak") >= STREAK, STREAK_FACTOR).otherwise(1.0)
    return t.select(
        "strategy", "trade_id", "exit_date", "r", "pnl", "equity", "drawdown", "streak", F.least(drawdown_multiplier(F.col("drawdown")), by_streak).alias("multiplier"),
        (F.col("drawdown") >= max(DRAWDOWN_STEPS)).alias("halt"))


def drawdown_multiplier(dd: Column) -> Column:
    out = F.lit(1.0)
    for step, factor in DRAWDOWN_STEPS.items():
        out = F.when(dd >= step, factor).otherwise(out)
    return out


def max_cards(curve: DataFrame, votes: DataFrame, correlations: DataFrame, most: int = 50, least_votes: int = 2, together: float = 0.6) -> DataFrame:
    """Add max_cards: how many new cards a strategy may open after a trade.

    `most`, half of it where the regime (exit_date, votes) has fewer than
    `least_votes` (none are none), and half of that where the names of its book move
    together (strategy, correlation).
    """
    at = curve.join(votes, "exit_date", "left").join(correlations, "strategy", "left")
    calm = F.when(F.coalesce("votes", F.lit(0)) >= least_votes, most).otherwise(most // 2)
    cards = F.when(F.col("correlation") > together, F.floor(calm / 2)).otherwise(calm)
    return at.withColumn("max_cards", cards.cast("int")).drop("votes", "correlation")


#: How a recommendation ended, as a trade's reason of exit.
EXIT_REASONS = {"TARGET": "target", "STOP": "stop", "EXPIRED_WIN": "expired", "EXPIRED_LOSS": "expired"}
#: Words of a strategy's name that say the kind of its thesis; momentum if none does.
THESES = {"momentum": "momentum", "value": "value", "quality": "quality", "event": "event", "macro": "macro_overlay"}


def trades_of(recommendations: DataFrame) -> DataFrame:
    """A thesis with its trade for every recommendation (rec_id, strategy, horizon, entry, target, stop, close_date, exit_price, realized, outcome)."""
    name = F.lower(F.coalesce("strategy", F.lit("")))
    thesis = F.coalesce(*(F.when(name.contains(word), kind) for word, kind in THESES.items()), F.lit("momentum"))
    reasons = F.create_map(*[F.lit(x) for pair in EXIT_REASONS.items() for x in pair])
    return recommendations.select(
        F.col("rec_id").alias("thesis_id"), thesis.alias("thesis_type"), F.when(F.coalesce("horizon", F.lit(0)) <= 21, "swing").otherwise("positional").alias("timeframe"),
        F.when(F.col("close_date").isNotNull(), "closed").otherwise("active").alias("status"), F.col("entry").alias("entry_price"), "stop", "target",
        F.col("close_date").alias("exit_date"), "exit_price", reasons[F.col("outcome")].alias("exit_reason"), F.col("realized").alias("realized_return"))


def trade_parity(recommendations: DataFrame, trades: DataFrame, within: float = 1e-6) -> DataFrame:
    """(rec_mean, trade_mean, parity): the mean return of closed recommendations and of exited trades, and whether they agree; without any both count as 0."""
    recs = recommendations.where("close_date IS NOT NULL").agg(F.avg("realized").alias("rec_mean"))
    made = trades.where("exit_price IS NOT NULL").agg(F.avg("realized_return").alias("trade_mean"))
    apart = F.abs(F.coalesce("rec_mean", F.lit(0.0)) - F.coalesce("trade_mean", F.lit(0.0)))
    return recs.crossJoin(F.broadcast(made)).withColumn("parity", apart < within)  # one row each


def shrink_weights(proposals: DataFrame, kappa: float = 100.0, least: int = 30, move: float = 0.02) -> DataFrame:
    """(kappa*prior + n*estimate) / (kappa + n), moved at most `move`, from n >= least; renormalised over pillars."""
    shrunk = (kappa * F.col("prior") + F.col("n") * F.col("estimate")) / (kappa + F.col("n"))
    capped = F.when(F.col("n") >= least, F.col("prior") + F.greatest(F.least(shrunk - F.col("prior"), F.lit(move)), F.lit(-move))).otherwise(F.col("prior"))
    return proposals.withColumn("raw", capped).withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("group")))


def capacity_curve(book: DataFrame, turnover: DataFrame, sizes: tuple[float, ...], k: float = 0.025, date: str = "rebal_date") -> DataFrame:
    """(aum, impact, cost): square-root impact of buying a book (date, symbol, weight, adv) at each size, and times the mean turnover."""
    sized = normalized(book, date).withColumn("aum", F.explode(F.array(*map(F.lit, sizes))))
    share = F.least(F.try_divide(F.col("aum") * F.col("weight"), F.col("adv")), F.lit(10.0))
    daily = sized.groupBy("aum", date).agg(F.sum(F.col("weight") * k * F.sqrt(share)).alias("_impact"))
    mean = turnover.agg(F.avg("turnover").alias("_turn"))  # one row
    return daily.groupBy("aum").agg(F.avg("_impact").alias("impact")).crossJoin(F.broadcast(mean)).select("aum", "impact", (F.col("impact") * F.col("_turn")).alias("cost"))


def checked_orders(
    book: DataFrame, prices: DataFrame, nav: float, cap: float = 0.06, ticket: float = 5_000.0, adv_share: float = 0.10, date: str = "rebal_date"
) -> DataFrame:
    """Orders that move each date's positions to the book's (date, symbol, weight), with the reason of each refusal.

    Target shares are floor(nav * min(weight, cap) / price); symbols without a
    price on the date are passed over. `prices` has (date, symbol, close, adv).
    """
    target = F.floor(nav * F.least("weight", F.lit(cap)) / F.col("close"))
    held = book.select(date, "symbol", "weight").join(prices, [date, "symbol"]).select(date, "symbol", target.alias("weight"))
    moves = weight_diff(held, date).where("delta <> 0").join(prices, [date, "symbol"])
    notional = F.abs("delta") * F.col("close")
    reason = (
        F.when(notional < ticket, "ticket").when(notional > cap * nav * 1.05, "cap")
        .when((F.col("adv") > 0) & (notional > adv_share * F.col("adv")), "adv").otherwise("ok")
    )
    return moves.select(date, "symbol", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("shares"), notional.alias("notional"), reason.alias("verdict"))


def lifecycle(cards: DataFrame, today: str, calendar_days: float = 365 / 252) -> DataFrame:
    """Dates and progress of cards (trade_id, issue_date, horizon_td, entry, target, stop, price) as of a day."""
    now = F.lit(today).cast("date")
    made = cards.withColumn("target_date", F.date_add("issue_date", F.round(F.col("horizon_td") * calendar_days).cast("int")))
    over = lambda a: F.try_divide(F.col(a), F.col("entry")) - 1
    return made.select(
        "trade_id", "issue_date", "target_date", F.datediff("target_date", now).alias("days_left"), F.datediff(now, "issue_date").alias("days_held"),
        over("target").alias("profit_target"), over("stop").alias("stop_risk"), over("price").alias("pl"),
        F.try_divide(F.col("price") - F.col("entry"), F.col("target") - F.col("entry")).alias("progress"),
    )


def weekly_stats(trades: DataFrame, high: float = 70.0, waiting_days: int = 63) -> DataFrame:
    """Per week of (exit_date, realized, entry_price, stop, confidence, in_book): closed, hit, expectancy in R, confident losers, and the waitlist.

    The waitlist counts cards outside the book in the `waiting_days` before the week's end.
    """
    week = F.date_trunc("week", "exit_date").cast("date")
    risk = F.when((F.col("entry_price") > F.col("stop")) & (F.col("stop") > 0), F.col("realized") / ((F.col("entry_price") - F.col("stop")) / F.col("entry_price")))
    g = trades.groupBy(week.alias("week")).agg(
        F.count(F.lit(1)).alias("closed"), F.avg((F.col("realized") > 0).cast("double")).alias("hit"), F.avg(risk).alias("expectancy_r"),
        F.count(F.when((F.col("confidence") >= high) & (F.col("realized") < 0), 1)).alias("confident_losers"), F.count(F.when(~F.col("in_book"), 1)).alias("_out"),
    )
    recent = Window.orderBy(F.unix_date("week")).rangeBetween(-waiting_days, 0)  # a row per week
    return g.withColumn("waitlist", F.sum("_out").over(recent)).drop("_out")


def context_tags(cards: DataFrame, events: DataFrame, days: int = 63) -> DataFrame:
    """(rebal_date, symbol, context): JSON of each card's regime and sector and the kinds of events active before its date.

    `events` is (symbol, event_date, kind); an event is active from the day after
    it for `days` days. Cards and events share one sorted pass per symbol.
    """
    both = cards.select("symbol", F.col("rebal_date").alias("_d"), "regime", "sector", F.lit(None).cast("string").alias("kind")).unionByName(
        events.select("symbol", F.col("event_date").alias("_d"), "kind"), allowMissingColumns=True
    )
    before = Window.partitionBy("symbol").orderBy(F.unix_date("_d")).rangeBetween(-days, -1)
    tagged = both.withColumn("events", F.array_sort(F.collect_set("kind").over(before))).where("regime IS NOT NULL")
    return tagged.select(F.col("_d").alias("rebal_date"), "symbol", F.to_json(F.struct("regime", "sector", "events")).alias("context"))
