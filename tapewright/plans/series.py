"""Queries over rolling windows and cross-section ranks."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.core import by_symbol, clip, median, qcut_decile, rank_pct, roll
from ..operators import composites as C
from ..operators import series as S
from .base import query


def win(cols: str) -> str:
    """SQL over bars with a window per symbol; ROLL(f, c, n) is guarded by its count."""
    import re

    def guarded(m):
        f, c, n = m[1], m[2].strip(), int(m[3])
        frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
        return f"CASE WHEN count({c}) {frame} >= {n} THEN {f}({c}) {frame} END"

    return re.sub(r"ROLL\((\w+), ([^,]+?), (\d+)\)", guarded, cols)


W = "OVER (PARTITION BY symbol ORDER BY date)"
R1 = f"r AS (SELECT *, close / lag(close) {W} - 1 AS ret_1d FROM bars)"


def bars_sql(cols: str, extra: str = "") -> str:
    return ("WITH " + extra if extra else "") + win(f"SELECT symbol, date, {cols} FROM {'r' if extra else 'bars'}")


query("win_returns", "bars", bars_sql(
    f"close / lag(close, 1) {W} - 1 AS ret_1d, close / lag(close, 21) {W} - 1 AS ret_1m, close / lag(close, 63) {W} - 1 AS ret_3m, "
    f"close / lag(close, 126) {W} - 1 AS ret_6m, close / lag(close, 252) {W} - 1 AS ret_12m, lag(close, 21) {W} / lag(close, 252) {W} - 1 AS mom_12_1, "
    f"lag(close, 21) {W} / lag(close, 126) {W} - 1 AS mom_6_1"), "ret_1d ret_1m ret_3m ret_6m ret_12m mom_12_1 mom_6_1")(
    lambda t: S.returns(t.bars).drop("open", "high", "low", "close", "volume"))
query("win_forward_labels", "bars", bars_sql(f"lead(close, 21) {W} / close - 1 AS fwd_ret_1m, lead(close, 63) {W} / close - 1 AS fwd_ret_3m"),
      "fwd_ret_1m fwd_ret_3m")(lambda t: S.forward_labels(t.bars, {"fwd_ret_1m": 21, "fwd_ret_3m": 63}).select("symbol", "date", "fwd_ret_1m", "fwd_ret_3m"))
query("win_realized_vol", "bars", bars_sql("ROLL(stddev_samp, ret_1d, 63) * sqrt(252) AS vol_3m, ROLL(stddev_samp, ret_1d, 126) * sqrt(252) AS vol_6m", R1),
      "vol_3m vol_6m")(lambda t: S.realized_vol(t.bars).select("symbol", "date", "vol_3m", "vol_6m"))
SMA = "a AS (" + win("SELECT *, ROLL(avg, close, 50) AS s50, ROLL(avg, close, 200) AS s200 FROM bars") + ")"
query("win_sma_distance", "bars", f"WITH {SMA} SELECT symbol, date, close / s50 - 1 AS dist_sma50, close / s200 - 1 AS dist_sma200, CAST(coalesce(close > s200, false) AS INTEGER) AS above_200 FROM a",
      "dist_sma50 dist_sma200")(lambda t: S.sma_distance(t.bars).select("symbol", "date", "dist_sma50", "dist_sma200", "above_200"))
query("win_prox_high", "bars", bars_sql("close / ROLL(max, close, 252) AS prox_52w_high"), "prox_52w_high")(
    lambda t: S.prox_high(t.bars).select("symbol", "date", "prox_52w_high"))
query("win_amihud", "bars", bars_sql("ROLL(avg, ill, 21) * 1e7 AS amihud", f"r AS (SELECT *, abs(close / lag(close) {W} - 1) / nullif(close * volume, 0) AS ill FROM bars)"),
      "amihud")(lambda t: S.amihud(t.bars).select("symbol", "date", "amihud"))
query("win_delivery_trend", "delivery", win("SELECT symbol, date, a AS deliv_1m, b AS deliv_3m, a - b AS deliv_trend FROM (SELECT symbol, date, ROLL(avg, delivery_percent, 21) AS a, ROLL(avg, delivery_percent, 63) AS b FROM delivery)"),
      "deliv_1m deliv_3m deliv_trend")(lambda t: S.delivery_trend(t.delivery).select("symbol", "date", "deliv_1m", "deliv_3m", "deliv_trend"))
query("win_pct_change", "bars", bars_sql(f"(close / lag(close) {W} - 1) * 100 AS pct_change"), "pct_change", 4)(
    lambda t: t.bars.select("symbol", "date", ((F.col("close") / F.lag("close").over(by_symbol()) - 1) * 100).alias("pct_change")))
query("win_trend_vote", "bars", bars_sql("CAST(coalesce(close > ROLL(avg, close, 200), false) AS INTEGER) AS vote"))(
    lambda t: t.bars.select("symbol", "date", F.coalesce(F.col("close") > roll(F.avg, "close", 200), F.lit(False)).cast("int").alias("vote")))
query("win_median_vote", "bars", bars_sql("CAST(coalesce(close < ROLL(median, close, 252), false) AS INTEGER) AS vote"))(
    lambda t: S.median_vote(t.bars.select("symbol", "date", "close")).select("symbol", "date", "vote"))
query("win_dist200_clipped", "bars", f"WITH {SMA} SELECT symbol, date, greatest(least(close / s200 - 1, 0.15), -0.15) / 0.15 * 100 AS score FROM a WHERE s200 IS NOT NULL", "score")(
    lambda t: S.sma_distance(t.bars).where("sma200 IS NOT NULL").select("symbol", "date", (clip(F.col("dist_sma200"), -0.15, 0.15) / 0.15 * 100).alias("score")))
query("win_trailing_pctile", "bars", "SELECT symbol, date, CASE WHEN len(l) >= 252 THEN len(list_filter(l, lambda v: v <= close)) / 252.0 END AS pctile FROM (SELECT symbol, date, close, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS l FROM bars)",
      "pctile")(lambda t: S.trailing_percentile(t.bars).select("symbol", "date", "pctile"))
query("win_median_trend_12", "bars", "SELECT symbol, date, close / CASE WHEN count(close) OVER w >= 6 THEN median(close) OVER w END AS trend FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 11 PRECEDING)",
      "trend")(lambda t: t.bars.select("symbol", "date", (F.col("close") / roll(median, "close", 12, 6)).alias("trend")))
query("win_regime_label", "bars", f"WITH {SMA} SELECT symbol, date, CASE WHEN close > s50 AND s50 > s200 THEN 'bull' WHEN close < s50 AND s50 < s200 THEN 'bear' ELSE 'sideways' END AS regime FROM a")(
    lambda t: S.regime_label(t.bars).select("symbol", "date", "regime"))
SEC = "sr AS (SELECT sector AS symbol, date, avg(r) AS ret, count(r) AS members FROM (SELECT b.symbol, b.date, sector, close / lag(close) OVER (PARTITION BY b.symbol ORDER BY b.date) - 1 AS r FROM bars b JOIN sector_map s ON b.symbol = s.symbol) WHERE r IS NOT NULL GROUP BY 1, 2)"


def sector_returns(t):
    r = S.returns(t.bars).select("symbol", "date", "ret_1d").join(t.sector_map.select("symbol", "sector"), "symbol")
    return r.where("ret_1d IS NOT NULL").groupBy(F.col("sector").alias("symbol"), "date").agg(F.avg("ret_1d").alias("ret"), F.count("ret_1d").alias("members"))


LEVEL = f"WITH {SEC}, lv AS (SELECT symbol, date, ret, product(1 + ret) OVER (PARTITION BY symbol ORDER BY date) AS level FROM sr)"
query("win_sector_index", "bars sector_map", f"{LEVEL} SELECT symbol AS sector, date, ln(level) AS log_level FROM lv", "log_level", 4)(
    lambda t: S.compounded(sector_returns(t)).select(F.col("symbol").alias("sector"), "date", F.log("level").alias("log_level")))
query("win_equity_drawdown", "bars sector_map", f"{LEVEL} SELECT symbol AS sector, date, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS drawdown FROM lv", "drawdown")(
    lambda t: S.drawdown(S.compounded(sector_returns(t))).select(F.col("symbol").alias("sector"), "date", "drawdown"))
query("win_relative_strength", "bars sector_map index_series",
      f"""{LEVEL}, ix AS (SELECT date, close / lag(close, 63) OVER (ORDER BY date) - 1 AS ir FROM index_series),
      rs AS (SELECT lv.symbol, lv.date, level / lag(level, 63) OVER (PARTITION BY symbol ORDER BY lv.date) - 1 - ir AS rs FROM lv LEFT JOIN ix ON lv.date = ix.date)
      SELECT symbol AS sector, date, rs, rs - lag(rs, 21) OVER (PARTITION BY symbol ORDER BY date) AS rs_mom FROM rs""", "rs rs_mom", 5)(
    lambda t: (lambda lv, ix: lv.withColumn("_r", F.col("level") / F.lag("level", 63).over(by_symbol()) - 1).join(ix, "date", "left")
               .withColumn("rs", F.col("_r") - F.col("ir")).select(F.col("symbol").alias("sector"), "date", "rs", (F.col("rs") - F.lag("rs", 21).over(by_symbol())).alias("rs_mom")))(
        S.compounded(sector_returns(t)),
        t.index_series.select("date", (F.col("close") / F.lag("close", 63).over(Window.orderBy("date")) - 1).alias("ir"))))
query("win_vol_target", "bars", "WITH m AS (SELECT symbol, date_trunc('month', date) AS mon, max_by(close, date) AS c FROM bars GROUP BY 1, 2), r AS (SELECT symbol, CAST(mon AS DATE) AS date, c / lag(c) OVER (PARTITION BY symbol ORDER BY mon) - 1 AS ret FROM m), v AS (" + win(
    "SELECT symbol, date, ROLL(stddev_samp, ret, 12) * sqrt(12) AS v FROM r") + ") SELECT symbol, date, lag(CASE WHEN v IS NOT NULL THEN greatest(least(0.12 / v, 1.5), 0) END) OVER (PARTITION BY symbol ORDER BY date) AS exposure FROM v", "exposure")(
    lambda t: S.vol_target(t.bars.groupBy("symbol", F.trunc("date", "MM").alias("date")).agg(F.max_by("close", F.col("date")).alias("c")).withColumn("ret", F.col("c") / F.lag("c").over(by_symbol()) - 1)).select("symbol", "date", "exposure"))
query("win_iv_rank", "bars", "SELECT symbol, date, CASE WHEN len(l) >= 20 THEN (close - list_min(l)) / nullif(list_max(l) - list_min(l), 0) * 100 END AS iv_rank, CASE WHEN len(l) >= 20 THEN len(list_filter(l, lambda v: v < close)) * 100.0 / len(l) END AS iv_percentile FROM (SELECT symbol, date, close, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS l FROM bars)",
      "iv_rank iv_percentile")(lambda t: S.iv_rank(t.bars).select("symbol", "date", "iv_rank", "iv_percentile"))
query("win_np_growth3", "statements", "SELECT symbol, quarter, (net_income - lag(net_income, 3) OVER w) / abs(nullif(lag(net_income, 3) OVER w, 0)) AS growth FROM statements WINDOW w AS (PARTITION BY symbol ORDER BY quarter)", "growth")(
    lambda t: (lambda p: t.statements.select("symbol", "quarter", F.try_divide(F.col("net_income") - p, F.abs(p)).alias("growth")))(F.lag("net_income", 3).over(by_symbol(order="quarter"))))
query("win_yoy_growth", "statements", "SELECT a.symbol, a.quarter, any_value(a.revenue) / max_by(b.revenue, b.quarter) - 1 AS growth FROM statements a JOIN statements b ON a.symbol = b.symbol AND b.quarter <= a.quarter - 350 GROUP BY 1, 2 HAVING max_by(b.revenue, b.quarter) >= 1e5", "growth")(
    lambda t: S.yearly_growth(t.statements))
query("win_z_by_group", "statements", """SELECT symbol, quarter, greatest(least((revenue - m) / CASE WHEN s IS NULL OR s = 0 THEN 1 ELSE s END, 3), -3) AS z, 100 * (rank() OVER (PARTITION BY quarter ORDER BY revenue) + (count(*) OVER (PARTITION BY quarter, revenue) - 1) / 2.0) / count(revenue) OVER (PARTITION BY quarter) AS pct
      FROM statements JOIN (SELECT quarter, median(revenue) AS m, stddev_samp(revenue) AS s FROM statements GROUP BY quarter) USING (quarter)""", "z pct")(
    lambda t: S.z_by_group(t.statements, "revenue", "quarter").select("symbol", "quarter", "z", "pct"))
query("win_oi_mom", "option_chain", """WITH o AS (SELECT symbol, date, sum(open_int) AS oi FROM option_chain GROUP BY 1, 2), m AS (SELECT symbol, date, oi / lag(oi) OVER (PARTITION BY symbol ORDER BY date) - 1 AS oi_chg FROM o)
      SELECT symbol, date, oi_chg, (oi_chg - avg(oi_chg) OVER (PARTITION BY date)) / nullif(stddev_pop(oi_chg) OVER (PARTITION BY date), 0) AS oi_z FROM m""", "oi_chg oi_z")(
    lambda t: (lambda m, w: m.select("symbol", "date", "oi_chg", F.try_divide(F.col("oi_chg") - F.avg("oi_chg").over(w), F.stddev_pop("oi_chg").over(w)).alias("oi_z")))(
        t.option_chain.groupBy("symbol", "date").agg(F.sum("open_int").alias("oi")).withColumn("oi_chg", F.col("oi") / F.lag("oi").over(by_symbol()) - 1), Window.partitionBy("date")))
query("win_rsi", "bars", f"WITH d AS (SELECT symbol, date, close - lag(close) {W} AS d FROM bars), g AS (" + win("SELECT symbol, date, CASE WHEN count(d) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) >= 14 THEN avg(greatest(d, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) END AS u, avg(greatest(-d, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS l FROM d") + ") SELECT symbol, date, CASE WHEN u IS NOT NULL THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + u / l) END END AS rsi FROM g", "rsi")(
    lambda t: S.rsi(t.bars).select("symbol", "date", "rsi"))
TR = f"tr AS (SELECT *, CASE WHEN lag(close) {W} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) END AS tr FROM bars)"
query("win_atr", "bars", f"WITH {TR}, a AS (" + win("SELECT symbol, date, close, ROLL(avg, tr, 14) AS atr FROM tr") + ") SELECT symbol, date, atr, atr / close * 100 AS atr_pct FROM a", "atr atr_pct")(
    lambda t: S.atr(t.bars).select("symbol", "date", "atr", "atr_pct"))
query("win_adx", "bars", f"WITH {TR}, u AS (SELECT *, high - lag(high) {W} AS up, lag(low) {W} - low AS dn FROM tr), p AS (SELECT *, CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END AS p, CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END AS m FROM u), d AS (" + win(
    "SELECT symbol, date, ROLL(avg, p, 14) / ROLL(avg, tr, 14) * 100 AS a, ROLL(avg, m, 14) / ROLL(avg, tr, 14) * 100 AS b FROM p") + ") SELECT symbol, date, abs(a - b) / nullif(a + b, 0) * 100 AS adx FROM d", "adx")(
    lambda t: S.adx(t.bars).select("symbol", "date", "adx"))
query("win_bollinger", "bars", "WITH a AS (" + win("SELECT symbol, date, close, ROLL(avg, close, 20) AS m, ROLL(stddev_samp, close, 20) AS s FROM bars") + ") SELECT symbol, date, (close - (m - 2 * s)) / nullif(4 * s, 0) AS bb_pos, 4 * s / m * 100 AS bb_width FROM a", "bb_pos bb_width")(
    lambda t: S.bollinger(t.bars).select("symbol", "date", "bb_pos", "bb_width"))
query("win_volume_surge", "bars", "WITH a AS (" + win("SELECT symbol, date, ROLL(avg, volume, 20) / ROLL(avg, volume, 252) AS vol_surge, ROLL(avg, close, 50) - ROLL(avg, close, 200) AS x, close / ROLL(max, high, 252) - 1 AS from_high, close / ROLL(min, low, 252) - 1 AS from_low FROM bars") + f"), b AS (SELECT *, lag(x) {W} AS y FROM a) SELECT symbol, date, vol_surge, from_high, from_low, CASE WHEN y <= 0 AND x > 0 THEN 'golden' WHEN y >= 0 AND x < 0 THEN 'death' END AS cross FROM b", "vol_surge from_high from_low")(
    lambda t: S.volume_surge(t.bars).select("symbol", "date", "vol_surge", "from_high", "from_low", "cross"))
query("win_rolling1y_consistency", "bars", f"SELECT symbol, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS consistency FROM (SELECT symbol, close / lag(close, 252) {W} - 1 AS r FROM bars) GROUP BY symbol", "consistency")(
    lambda t: S.returns(t.bars).groupBy("symbol").agg(F.avg(F.when(F.col("ret_12m") > 0, 1.0).otherwise(0.0)).alias("consistency")))
query("win_regime_flip", "bars", f"WITH {SMA}, b AS (SELECT date, 100.0 * avg(CASE WHEN close > s200 THEN 1.0 WHEN s200 IS NOT NULL THEN 0.0 END) AS pct FROM a GROUP BY date) SELECT date, pct, (pct >= 50) IS DISTINCT FROM (lag(pct, 21) OVER (ORDER BY date) >= 50) AND lag(pct, 21) OVER (ORDER BY date) IS NOT NULL AS flipped FROM b WHERE pct IS NOT NULL", "pct")(
    lambda t: (lambda b, p: b.select("date", "pct", (((F.col("pct") >= 50) != (p >= 50)) & p.isNotNull()).alias("flipped")).fillna(False, ["flipped"]))(
        S.sma_distance(t.bars).where("sma200 IS NOT NULL").groupBy("date").agg((F.avg("above_200") * 100).alias("pct")), F.lag("pct", 21).over(Window.orderBy("date"))))
query("win_ema_macd", "bars", """WITH b AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k <= 756),
  s AS (SELECT symbol, avg(close) FILTER (i <= 12) AS f, avg(close) FILTER (i <= 26) AS s, count(*) AS n FROM b GROUP BY 1),
  e AS (SELECT symbol, CAST(12 AS BIGINT) AS i, f, CAST(0 AS DOUBLE) AS g, s AS e, CAST(0 AS DOUBLE) AS t FROM s WHERE n >= 35
    UNION ALL SELECT b.symbol, b.i, e.f + (b.close - e.f) * 2 / 13, CASE WHEN b.i < 26 THEN 0 WHEN b.i <= 34 THEN e.g + ((e.f + (b.close - e.f) * 2 / 13) - CASE WHEN b.i = 26 THEN e.e ELSE e.e + (b.close - e.e) * 2 / 27 END) / 9
      ELSE e.g + (((e.f + (b.close - e.f) * 2 / 13) - (e.e + (b.close - e.e) * 2 / 27)) - e.g) * 2 / 10 END, CASE WHEN b.i <= 26 THEN e.e ELSE e.e + (b.close - e.e) * 2 / 27 END, 0 FROM e JOIN b ON b.symbol = e.symbol AND b.i = e.i + 1)
  SELECT symbol, f - e AS macd, g AS signal, f - e - g AS histogram FROM e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1""", "macd signal histogram", 4)(lambda t: S.macd(t.bars))
query("win_split_adjust", "bars corporate_actions", """WITH f AS (SELECT symbol, date, CASE action_type WHEN 'SPLIT' THEN CAST(split_part(ratio, ':', 2) AS DOUBLE) / CAST(split_part(ratio, ':', 1) AS DOUBLE) ELSE CAST(split_part(ratio, ':', 2) AS DOUBLE) / (CAST(split_part(ratio, ':', 1) AS DOUBLE) + CAST(split_part(ratio, ':', 2) AS DOUBLE)) END AS f FROM corporate_actions WHERE action_type <> 'DIVIDEND')
      SELECT b.symbol, b.date, coalesce(product(f.f), 1) AS adj_factor FROM bars b LEFT JOIN f ON f.symbol = b.symbol AND f.date > b.date GROUP BY 1, 2""", "adj_factor", 9)(
    lambda t: C.suffix_factor(t.bars, t.corporate_actions).select("symbol", "date", "adj_factor"))
query("win_ttm_dividend", "bars corporate_actions", """SELECT b.symbol, b.date, coalesce(sum(a.amount), 0) / any_value(b.close) AS dividend_yield FROM bars b LEFT JOIN corporate_actions a ON a.symbol = b.symbol AND a.action_type = 'DIVIDEND' AND a.date <= b.date AND a.date > b.date - 365 GROUP BY 1, 2""", "dividend_yield")(
    lambda t: C.ttm_dividend(t.bars, t.corporate_actions).select("symbol", "date", "dividend_yield"))

# ranks over a monthly panel: rebalance dates with momentum, volatility and nearness to the high
PANEL = f"""p0 AS (SELECT symbol, date, close, volume, lag(close, 21) {W} / lag(close, 126) {W} - 1 AS mom, close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING) AS prox,
  lead(close, 21) {W} / close - 1 AS fwd FROM bars), panel AS (SELECT date AS rebal_date, symbol, sector, close, close * volume AS turnover, mom, prox, fwd FROM p0 JOIN month_ends ON date = rebal_date JOIN sector_map USING (symbol))"""


def panel(t):
    w = by_symbol()
    b = t.bars.withColumns({"mom": F.lag("close", 21).over(w) / F.lag("close", 126).over(w) - 1, "prox": F.col("close") / F.max("close").over(w.rowsBetween(-62, 0)),
                            "fwd": F.lead("close", 21).over(w) / F.col("close") - 1})
    dates = F.broadcast(t.month_ends)  # a row per month
    return (b.join(dates, b.date == dates.rebal_date).join(t.sector_map.select("symbol", "sector"), "symbol")
            .select("rebal_date", "symbol", "sector", "close", (F.col("close") * F.col("volume")).alias("turnover"), "mom", "prox", "fwd"))


PV = "bars sector_map month_ends"
PCT = lambda c, g="rebal_date": f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {g} ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {g}) END"
query("rank_pct_avg", PV, f"WITH {PANEL} SELECT rebal_date, symbol, {PCT('mom')} AS mom_rank FROM panel", "mom_rank")(
    lambda t: panel(t).select("rebal_date", "symbol", rank_pct("mom", "rebal_date").alias("mom_rank")))
DEC = lambda c: f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY rebal_date) >= 10 THEN CAST(greatest(1, ceil((row_number() OVER (PARTITION BY rebal_date ORDER BY {c} NULLS LAST, symbol) - 1) * 10.0 / (count({c}) OVER (PARTITION BY rebal_date) - 1))) AS INTEGER) END"
query("rank_qcut_decile", PV, f"WITH {PANEL} SELECT rebal_date, symbol, {DEC('mom')} AS decile FROM panel")(
    lambda t: panel(t).select("rebal_date", "symbol", qcut_decile("mom", "rebal_date").alias("decile")))
query("rank_composite", PV, f"WITH {PANEL} SELECT rebal_date, symbol, ({PCT('mom')} + {PCT('prox')} + {PCT('turnover')}) / 3 AS composite FROM panel", "composite")(
    lambda t: S.composite(panel(t), {"mom": 1, "prox": 1, "turnover": 1}).select("rebal_date", "symbol", "composite"))
query("rank_sector_neutral", PV, f"WITH {PANEL}, r AS (SELECT *, {PCT('mom')} AS r FROM panel) SELECT rebal_date, symbol, r - avg(r) OVER (PARTITION BY rebal_date, sector) AS neutral FROM r", "neutral")(
    lambda t: S.sector_neutral(panel(t), "mom").select("rebal_date", "symbol", "neutral"))
query("rank_rs_sector", PV, f"WITH {PANEL} SELECT rebal_date, symbol, mom - avg(mom) OVER (PARTITION BY rebal_date, sector) AS rs_sector FROM panel", "rs_sector")(
    lambda t: panel(t).select("rebal_date", "symbol", (F.col("mom") - F.avg("mom").over(Window.partitionBy("rebal_date", "sector"))).alias("rs_sector")))
query("rank_universe_tiers", PV, f"WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY turnover DESC, symbol) AS k FROM panel) SELECT rebal_date, symbol, CAST(k AS INTEGER) AS adv_rank, CAST(k <= 100 AS INTEGER) AS top100, CAST(k <= 250 AS INTEGER) AS top250, CAST(k <= 500 AS INTEGER) AS top500, CAST(turnover >= 100000 AS INTEGER) AS liquid FROM r")(
    lambda t: S.universe_tiers(panel(t), by="turnover", liquid_from=1e5).select("rebal_date", "symbol", "adv_rank", "top100", "top250", "top500", "liquid"))
query("rank_live_signals", PV, f"""WITH {PANEL}, c AS (SELECT rebal_date, symbol, ({PCT('mom')} + {PCT('prox')}) / 2 AS composite FROM panel WHERE mom IS NOT NULL), d AS (SELECT *, {DEC('composite')} AS decile FROM c)
      SELECT symbol, composite AS score, decile, CAST(row_number() OVER (ORDER BY composite DESC, symbol) AS INTEGER) AS rank, decile = 10 AS in_portfolio FROM d WHERE rebal_date = (SELECT max(rebal_date) FROM d)""", "score")(
    lambda t: (lambda d: (lambda m: d.join(F.broadcast(m), "rebal_date", "left_semi").select("symbol", F.col("composite").alias("score"), "decile", F.row_number().over(Window.orderBy(F.desc("composite"), "symbol")).alias("rank"), (F.col("decile") == 10).alias("in_portfolio")))(
        d.agg(F.max("rebal_date").alias("rebal_date"))))(
        S.composite(panel(t).where("mom IS NOT NULL"), {"mom": 1, "prox": 1}).withColumn("decile", qcut_decile("composite", "rebal_date"))))
query("topk_per_group", PV, f"WITH {PANEL} SELECT rebal_date, symbol, turnover, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY turnover DESC, symbol) AS k FROM panel) WHERE k <= 15", "turnover")(
    lambda t: S.top_k(panel(t), 15, "rebal_date", by=[F.desc("turnover"), F.col("symbol")]).select("rebal_date", "symbol", "turnover", "rank"))
query("topk_global", "bars", "SELECT symbol, sum(close * volume) AS turnover FROM bars GROUP BY symbol ORDER BY round(turnover, 2) DESC, symbol LIMIT 20", "turnover", 2)(
    lambda t: t.bars.groupBy("symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("turnover")).orderBy(F.round("turnover", 2).desc(), "symbol").limit(20))
query("rank_in_category", PV, f"WITH {PANEL}, a AS (SELECT symbol, any_value(sector) AS sector, round(avg(fwd) / stddev_samp(fwd), 9) AS sharpe FROM panel GROUP BY symbol HAVING count(fwd) >= 3) SELECT symbol, sector, CAST(rank() OVER (PARTITION BY sector ORDER BY sharpe DESC) AS INTEGER) AS rank FROM a")(
    lambda t: panel(t).groupBy("symbol").agg(F.first("sector").alias("sector"), F.round(F.avg("fwd") / F.stddev_samp("fwd"), 9).alias("sharpe"), F.count("fwd").alias("n")).where("n >= 3")
    .select("symbol", "sector", F.rank().over(Window.partitionBy("sector").orderBy(F.desc("sharpe"))).alias("rank")))
query("rank_sector_pct", "bars sector_map", f"WITH {SEC} SELECT symbol AS sector, date, 100 * {PCT('ret', 'date')} AS pct, CAST(rank() OVER (PARTITION BY date ORDER BY ret DESC) AS INTEGER) AS rank FROM sr", "pct")(
    lambda t: sector_returns(t).withColumn("ret", F.round("ret", 12)).select(F.col("symbol").alias("sector"), "date", (rank_pct("ret", "date") * 100).alias("pct"), F.rank().over(Window.partitionBy("date").orderBy(F.desc("ret"))).alias("rank")))
query("rank_book_percentile", PV, f"WITH {PANEL} SELECT rebal_date, symbol, 100 * cume_dist() OVER (PARTITION BY rebal_date ORDER BY turnover) AS pct FROM panel", "pct")(
    lambda t: panel(t).select("rebal_date", "symbol", (F.cume_dist().over(Window.partitionBy("rebal_date").orderBy("turnover")) * 100).alias("pct")))
query("quantile_top_decile_mean", PV, f"WITH {PANEL}, q AS (SELECT rebal_date, quantile_cont(mom, 0.9) AS p, count(mom) AS n FROM panel GROUP BY 1) SELECT rebal_date, avg(fwd) AS top_mean FROM panel JOIN q USING (rebal_date) WHERE mom >= p AND n >= 10 GROUP BY 1", "top_mean")(
    lambda t: (lambda p: p.join(F.broadcast(p.groupBy("rebal_date").agg(F.percentile("mom", F.lit(0.9)).alias("p"), F.count("mom").alias("n"))), "rebal_date").where("mom >= p AND n >= 10").groupBy("rebal_date").agg(F.avg("fwd").alias("top_mean")))(panel(t)))
