"""The feature store, the strategies, recommendations, bands and scored cards, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import qcut_decile, round_to
from ..operators import books as B
from ..operators import composites as C
from ..operators import exits as X
from ..operators import scoring as K
from ..operators import series as S
from ..operators import stats as A
from ..operators import strategies as T
from ..operators.asof import asof
from ..sources.fixtures import Tables
from ..sources.scratch import Scratch
from .aggregates import BREADTH, UNI
from .base import query
from .series import DEC, PCT, TR, W, win

DAILY = win(f"""fa AS (SELECT *, close / lag(close) {W} - 1 AS ret_1d, abs(close / lag(close) {W} - 1) / nullif(close * volume, 0) AS ill FROM bars),
  fd AS (SELECT symbol, date, a AS deliv_1m, b AS deliv_3m, a - b AS deliv_trend
         FROM (SELECT symbol, date, ROLL(avg, delivery_percent, 21) AS a, ROLL(avg, delivery_percent, 63) AS b FROM delivery)),
  fb AS (SELECT symbol, date, close, close * volume AS turnover,
    close / lag(close, 21) {W} - 1 AS ret_1m, close / lag(close, 63) {W} - 1 AS ret_3m, close / lag(close, 126) {W} - 1 AS ret_6m,
    close / lag(close, 252) {W} - 1 AS ret_12m, lag(close, 21) {W} / lag(close, 252) {W} - 1 AS mom_12_1, lag(close, 21) {W} / lag(close, 126) {W} - 1 AS mom_6_1,
    ROLL(stddev_samp, ret_1d, 63) * sqrt(252) AS vol_3m, ROLL(stddev_samp, ret_1d, 126) * sqrt(252) AS vol_6m,
    close / ROLL(avg, close, 50) - 1 AS dist_sma50, close / ROLL(avg, close, 200) - 1 AS dist_sma200,
    CAST(coalesce(close > ROLL(avg, close, 200), false) AS INTEGER) AS above_200, close / ROLL(max, close, 252) AS prox_52w_high,
    ROLL(avg, ill, 21) * 1e7 AS amihud, lead(close, 21) {W} / close - 1 AS fwd_ret_1m, lead(close, 63) {W} / close - 1 AS fwd_ret_3m FROM fa),
  daily AS (SELECT fb.*, deliv_1m, deliv_3m, deliv_trend FROM fb LEFT JOIN fd USING (symbol, date))""")
FEATURES = "med_turnover " + " ".join(c for c in T.FEATURES if c != "above_200")

query("feature_store_monthly", "bars delivery month_ends", f"""WITH {UNI}, {DAILY},
  r AS (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY round(med_turnover, 4) DESC, symbol) AS k FROM universe)
  SELECT rebal_date, r.symbol, med_turnover, CAST(k AS INTEGER) AS adv_rank, CAST(k <= 500 AS INTEGER) AS top500, CAST(med_turnover >= 30000 AS INTEGER) AS liquid,
    {', '.join(T.FEATURES)} FROM daily JOIN r ON r.symbol = daily.symbol AND r.rebal_date = daily.date""", FEATURES, 5)(
    lambda t: feature_store(t.stored("bars")))


def feature_store(t: Tables) -> DataFrame:
    return T.monthly_features(T.daily_features(t.bars, t.delivery, month_days(t)), universe(t)).select("rebal_date", "symbol", "med_turnover", "adv_rank", "top500", "liquid", *T.FEATURES)


def universe(t: Tables) -> DataFrame:
    """(rebal_date, symbol, adv_rank, top500, liquid) of every month end."""
    u = A.universe_window(t.bars, t.month_ends, least=10).withColumn("_m", round_to(F.col("med_turnover"), 4))
    return S.universe_tiers(u, by="_m", liquid_from=3e4).select("rebal_date", "symbol", "med_turnover", "adv_rank", "top500", "liquid")


def annual(statements: DataFrame) -> DataFrame:
    """(symbol, pit_date, eps, roe) of each fiscal year: filed with its last quarter; orders stand for shares, revenue for equity."""
    years = statements.groupBy("symbol", F.year("quarter").alias("fy")).agg(
        F.sum("net_income").alias("income"), F.sum("revenue").alias("revenue"), F.sum("n_orders").alias("shares"), F.max("pit_date").alias("pit_date")
    )
    return years.select("symbol", "pit_date", (F.col("income") / F.col("shares")).alias("eps"), F.try_divide("income", "revenue").alias("roe"))


def enriched(t: Tables) -> DataFrame:
    """Features at month ends with sector, earnings yield, return on equity and dividend yield."""
    dates = month_days(t)
    paid = C.ttm_dividend(t.bars.select("symbol", "date", "close"), t.corporate_actions).select("symbol", "date", "dividend_yield")
    daily = T.daily_features(t.bars, t.delivery, dates).join(paid.join(F.broadcast(dates), "date", "left_semi"), ["symbol", "date"])
    panel = daily.withColumnRenamed("date", "rebal_date").join(t.sector_map.select("symbol", "sector"), "symbol")
    panel = asof(panel, annual(t.statements), ["symbol"], "rebal_date", "pit_date", ["eps", "roe"])
    return panel.withColumn("earnings_yield", F.col("eps") / F.col("close")).drop("matched_on")


ENRICHED = f"""{DAILY}, an AS (SELECT symbol, max(pit_date) AS pit_date, sum(net_income) / sum(n_orders) AS eps, sum(net_income) / nullif(sum(revenue), 0) AS roe
    FROM statements GROUP BY symbol, year(quarter)),
  dy AS (SELECT b.symbol, b.date, coalesce(sum(a.amount), 0) / any_value(b.close) AS dividend_yield FROM bars b LEFT JOIN corporate_actions a
    ON a.symbol = b.symbol AND a.action_type = 'DIVIDEND' AND a.date <= b.date AND a.date > b.date - 365 GROUP BY 1, 2),
  pe AS (SELECT daily.date AS rebal_date, daily.*, sector, dividend_yield FROM daily JOIN month_ends ON daily.date = rebal_date JOIN sector_map USING (symbol)
    JOIN dy ON dy.symbol = daily.symbol AND dy.date = daily.date),
  panel AS (SELECT pe.*, eps / close AS earnings_yield, roe FROM pe ASOF LEFT JOIN an ON pe.symbol = an.symbol AND an.pit_date <= pe.rebal_date)"""
VIEWS = "bars delivery month_ends sector_map statements corporate_actions"
RANKED = [(c if s > 0 else f"-{c}") for c, s in T.COMPOSITE.items()]


def mean_rank_sql(source: str) -> str:
    """CTE `cp`: `source` with the composite of the ranks that a name has."""
    cols = ", ".join(f"{c} AS s{i}" for i, c in enumerate(RANKED))
    ranks = ", ".join(f"{PCT(f's{i}')} AS r{i}" for i in range(len(RANKED)))
    total = " + ".join(f"coalesce(r{i}, 0)" for i in range(len(RANKED)))
    held = " + ".join(f"CAST(r{i} IS NOT NULL AS INTEGER)" for i in range(len(RANKED)))
    return f"""ca AS (SELECT *, {cols} FROM {source}), cb AS (SELECT *, {ranks} FROM ca),
      cp AS (SELECT *, round(({total}) / nullif({held}, 0), 9) AS composite FROM cb)"""


IV = "1 / greatest(vol_3m, 0.05)"


def decile_sql(where: str, by: str, which: int, weight: str = IV, source: str = "panel") -> str:
    return f"""dd AS (SELECT *, {DEC(by)} AS decile FROM {source} WHERE {where})
      SELECT rebal_date, symbol, CAST({weight} AS DOUBLE) AS weight FROM dd WHERE decile = {which} AND {weight} IS NOT NULL"""


STRATEGY_SQL = {
    "momentum_delivery_lowvol": f"{mean_rank_sql('panel')}, {decile_sql('true', 'composite', 10, source='cp')}",
    "low_volatility": decile_sql("true", "vol_3m", 1),
    "short_term_reversal": decile_sql("true", "ret_1m", 1, "1.0"),
    "high52_breakout": decile_sql("above_200 = 1", "prox_52w_high", 10),
    "value_earnings_yield": decile_sql("earnings_yield > 0", "earnings_yield", 10),
    "quality_roe": decile_sql("roe IS NOT NULL", "roe", 10),
    "dividend_yield": decile_sql("dividend_yield > 0", "dividend_yield", 10),
    "sector_rotation": f"""sm AS (SELECT rebal_date, sector, round(-avg(mom_12_1), 10) AS m FROM panel WHERE mom_12_1 IS NOT NULL GROUP BY 1, 2),
      sk AS (SELECT rebal_date, sector, rank() OVER (PARTITION BY rebal_date ORDER BY m) + (count(*) OVER (PARTITION BY rebal_date, m) - 1) / 2.0 AS k FROM sm)
      SELECT rebal_date, symbol, CAST({IV} AS DOUBLE) AS weight FROM panel JOIN sk USING (rebal_date, sector) WHERE k <= 3 AND mom_12_1 IS NOT NULL AND vol_3m IS NOT NULL""",
}
for _name, _strategy in T.STRATEGIES.items():
    query(f"strategy_{_name}", VIEWS, f"WITH {ENRICHED}, {STRATEGY_SQL[_name]}", "weight")(lambda t, f=_strategy: f(enriched(t)))

# the strategies' books: returns to the next rebalance, gated by breadth
RETURNS = """mi AS (SELECT rebal_date, row_number() OVER (ORDER BY rebal_date) AS i FROM month_ends),
  rn AS (SELECT rebal_date, symbol, close, i, lead(i) OVER s AS ni, lead(close) OVER s / close - 1 AS r FROM panel JOIN mi USING (rebal_date) WINDOW s AS (PARTITION BY symbol ORDER BY i)),
  rz AS (SELECT rebal_date, symbol, r AS realized FROM rn WHERE ni = i + 1 AND r IS NOT NULL)"""
RUN = f"""hw AS (SELECT strategy, rebal_date, symbol, weight / sum(weight) OVER (PARTITION BY strategy, rebal_date) AS weight, realized FROM sig JOIN rz USING (rebal_date, symbol) WHERE weight > 0),
  hd AS (SELECT strategy, rebal_date, lead(rebal_date) OVER (PARTITION BY strategy ORDER BY rebal_date) AS nxt FROM (SELECT DISTINCT strategy, rebal_date FROM hw)),
  hp AS (SELECT strategy, nxt AS rebal_date, symbol, weight AS was FROM hw JOIN hd USING (strategy, rebal_date) WHERE nxt IS NOT NULL),
  ch AS (SELECT strategy, rebal_date, symbol, coalesce(weight, 0) - coalesce(was, 0) AS delta FROM hw FULL JOIN hp USING (strategy, rebal_date, symbol)),
  pg AS (SELECT strategy, rebal_date, count(*) AS names, sum(weight * realized) AS gross FROM hw GROUP BY 1, 2),
  pt AS (SELECT strategy, rebal_date, sum(abs(delta)) AS turnover FROM ch GROUP BY 1, 2)"""
SIGNALS = "sig AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, rebal_date, symbol, weight FROM (WITH {q})" for n, q in STRATEGY_SQL.items()) + ")"
BOOKS = f"{ENRICHED}, {RETURNS}, {SIGNALS}, {RUN}"


def stored_panel(t: Tables) -> DataFrame:
    """The enriched panel with the return to the next rebalance, written once: eight strategies read it."""
    dates = t.month_ends.withColumn("_i", F.row_number().over(Window.orderBy("rebal_date")))  # a row per month
    w = Window.partitionBy("symbol").orderBy("_i")
    p = enriched(t).join(F.broadcast(dates), "rebal_date")
    follows = F.lead("_i").over(w) == F.col("_i") + 1
    return Scratch(t.spark).written(p.withColumn("realized", F.when(follows, F.lead("close").over(w) / F.col("close") - 1)).drop("_i"), "strategy_panel")


def books(t: Tables) -> DataFrame:
    """The normalised weights of all strategies, with realized returns."""
    p = stored_panel(t)
    signals = [f(p).select(F.lit(n).alias("strategy"), "rebal_date", "symbol", F.col("weight").cast("double").alias("weight")) for n, f in T.STRATEGIES.items()]
    return B.target_weights(reduce(DataFrame.unionByName, signals), p)


def gate_scores(t: Tables) -> DataFrame:
    return A.breadth(t.bars).select(F.col("date").alias("rebal_date"), F.col("pct_above_200dma").alias("score"))


query("bt_portfolio", VIEWS, f"""WITH {BOOKS}, {BREADTH}, gg AS (SELECT pg.*, turnover, gross - turnover * 30 / 1e4 AS net, coalesce(pct_above_200dma >= 50, true) AS "on" FROM pg JOIN pt USING (strategy, rebal_date) LEFT JOIN breadth ON breadth.date = rebal_date),
  gn AS (SELECT *, CASE WHEN "on" THEN net ELSE 0 END AS net_gated FROM gg) SELECT *, product(1 + net_gated) OVER (PARTITION BY strategy ORDER BY rebal_date) AS equity FROM gn""",
      "gross turnover net net_gated equity", 4)(lambda t: B.run_books(books(t), gate_scores(t)))
query("bt_trades", VIEWS, f"WITH {BOOKS} SELECT strategy, rebal_date, symbol, delta, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side FROM ch WHERE abs(delta) > 1e-6", "delta")(lambda t: B.leg_trades(books(t)))
query("bt_holdings", VIEWS, f"WITH {BOOKS} SELECT strategy, rebal_date, symbol, weight FROM hw", "weight")(lambda t: books(t).select("strategy", "rebal_date", "symbol", "weight"))
WEIGHTED = f"""{ENRICHED}, {RETURNS}, {mean_rank_sql('panel')}, de AS (SELECT *, {DEC('composite')} AS decile FROM cp), tp AS (SELECT *, count(*) OVER (PARTITION BY rebal_date) AS n FROM de WHERE decile = 10),
  sig AS (SELECT 'ew' AS strategy, rebal_date, symbol, 1.0::DOUBLE AS weight FROM tp WHERE n >= 2 UNION ALL SELECT 'iv', rebal_date, symbol, {IV} FROM tp WHERE n >= 2 AND vol_3m IS NOT NULL), {RUN}"""


def weighted_books(t: Tables) -> DataFrame:
    p = stored_panel(t)
    signals = B.weighted_deciles(T.mean_rank(p, T.COMPOSITE).withColumn("decile", qcut_decile("composite", "rebal_date")), least=2)  # months of the fixture have few names
    return B.run_books(B.target_weights(signals, p, "kind"), leg="kind").drop("on", "net_gated")


query("bt_weighted_book", VIEWS, f"""WITH {WEIGHTED}, gg AS (SELECT strategy AS kind, rebal_date, names, gross, turnover, gross - turnover * 30 / 1e4 AS net FROM pg JOIN pt USING (strategy, rebal_date))
  SELECT *, product(1 + net) OVER (PARTITION BY kind ORDER BY rebal_date) AS equity FROM gg""", "gross turnover net equity", 4)(weighted_books)

# recommendations, outcomes, bands and scores
KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in [*T.COMPOSITE, "close"])
RECO = f"""kn AS (SELECT date AS rebal_date, * FROM daily JOIN month_ends ON date = rebal_date WHERE {KNOWN}), {mean_rank_sql('kn')},
  rc AS (SELECT rebal_date AS entry_date, symbol, composite * 100 AS score, close AS entry, close * (1 + 1.5 * vol_3m * sqrt(21 / 252.0)) AS target,
    close * (1 - 1.0 * vol_3m * sqrt(21 / 252.0)) AS stop FROM cp QUALIFY row_number() OVER (PARTITION BY rebal_date ORDER BY composite DESC, symbol) <= 15)"""
RECO_VIEWS = "bars delivery month_ends"


def month_days(t: Tables) -> DataFrame:
    return t.month_ends.select(F.col("rebal_date").alias("date"))


def recommendations(t: Tables) -> DataFrame:
    return K.recommend(T.daily_features(t.bars, t.delivery, month_days(t)).withColumnRenamed("date", "rebal_date"))


query("reco_generate", RECO_VIEWS, f"WITH {DAILY}, {RECO} SELECT * FROM rc", "score entry target stop", 3)(recommendations)


def touch_sql(first: str) -> str:
    return f"""bn AS (SELECT *, row_number() {W} AS n FROM bars), pa AS (SELECT r.symbol, r.entry_date, r.entry, r.target, r.stop, b.n, b.date, b.close, {first} AS hit
      FROM rc r JOIN bn e ON e.symbol = r.symbol AND e.date = r.entry_date JOIN bn b ON b.symbol = r.symbol AND b.n > e.n AND b.n <= e.n + 21),
      tc AS (SELECT symbol, entry_date, any_value(entry) AS entry, any_value(target) AS target, any_value(stop) AS stop,
        coalesce(min_by(hit, n) FILTER (hit IS NOT NULL), 'expired') AS outcome, coalesce(min(date) FILTER (hit IS NOT NULL), max(date)) AS exit_date,
        max_by(close, n) AS z FROM pa GROUP BY 1, 2)
      SELECT symbol, entry_date, outcome, exit_date, CASE outcome WHEN 'target' THEN target WHEN 'stop' THEN stop ELSE z END / entry - 1 AS realized FROM tc"""


TOUCH = "CASE WHEN b.high >= r.target THEN 'target' WHEN b.low <= r.stop THEN 'stop' END"
query("reco_first_touch", RECO_VIEWS, f"WITH {DAILY}, {RECO}, {touch_sql(TOUCH)}", "realized", 5)(
    lambda t: B.first_touch(recommendations(t), t.bars, 21, target_first=True))

EXITS = f"""{DAILY}, {RECO}, bn AS (SELECT *, row_number() {W} AS n, lag(close) {W} AS pc FROM bars),
  ba AS (SELECT symbol, date, n, high, low, close, CASE WHEN n >= 16 THEN avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) END AS atr FROM bn),
  rl AS (SELECT * REPLACE (greatest(stop, 0.9 * entry) AS stop, least(target, 1.2 * entry) AS target) FROM rc),
  en AS (SELECT r.*, coalesce(b.n, 0) AS n0, b.atr FROM rl r ASOF LEFT JOIN ba b ON b.symbol = r.symbol AND b.date <= r.entry_date),
  pa AS (SELECT en.symbol, entry_date, entry, stop, target, en.atr, b.n, b.date, b.high, b.low, b.close, max(b.high) OVER p AS up, min(b.low) OVER p AS down, greatest(entry, max(b.close) OVER p) AS peak
    FROM en JOIN ba b ON b.symbol = en.symbol AND b.n BETWEEN n0 + 1 AND n0 + 22 WHERE entry > stop AND stop > 0 WINDOW p AS (PARTITION BY en.symbol, entry_date ORDER BY b.n)),
  lv AS (SELECT *, (entry - stop) * k AS d, CASE variant WHEN 'time_only' THEN NULL WHEN 'trail_atr3' THEN greatest(stop, peak - 3 * coalesce(nullif(atr, 0), entry - stop)) ELSE entry - (entry - stop) * k END AS s,
      CASE WHEN variant NOT IN ('time_only', 'trail_atr3') THEN entry + 2 * (entry - stop) * k END AS t
    FROM pa, (VALUES ('current', 1.0::DOUBLE), ('wide_1.25x', 1.25), ('wide_1.5x', 1.5), ('wide_2x', 2.0), ('trail_atr3', 1.0), ('time_only', 1.0)) v(variant, k)),
  ht AS (SELECT *, CASE WHEN low <= s THEN 'stop' WHEN high >= t THEN 'target' END AS hit FROM lv),
  fx AS (SELECT symbol, entry_date, variant, coalesce(min(n) FILTER (hit IS NOT NULL), max(n)) AS n FROM ht GROUP BY 1, 2, 3),
  ex AS (SELECT symbol, entry_date, variant, coalesce(hit, 'expired') AS outcome, date AS exit_date, CASE hit WHEN 'stop' THEN s WHEN 'target' THEN t ELSE close END / entry - 1 AS realized,
      (CASE hit WHEN 'stop' THEN s WHEN 'target' THEN t ELSE close END - entry) / d AS r, greatest(0, up / entry - 1) AS mfe, least(0, down / entry - 1) AS mae, target / entry - 1 AS aim FROM fx JOIN ht USING (symbol, entry_date, variant, n))"""


def exits(t: Tables) -> DataFrame:
    """Of the recommendations, with stops at most a tenth away: the fixture's prices jump so much that bands of volatility reach below zero."""
    close = {"stop": F.greatest("stop", 0.9 * F.col("entry")), "target": F.least("target", 1.2 * F.col("entry"))}
    return X.exit_variants(recommendations(t).withColumns(close), t.bars)


query("exit_variants", RECO_VIEWS, f"WITH {EXITS} SELECT symbol, entry_date, variant, outcome, exit_date, realized, r, mfe, mae FROM ex", "realized r mfe mae", 5)(
    lambda t: exits(t).drop("entry", "target", "stop"))
query("agg_exit_variants", RECO_VIEWS, f"""WITH {EXITS}, sd AS (SELECT symbol, entry_date, row_number() OVER (ORDER BY entry_date, symbol) <= floor(0.7 * count(*) OVER ()) AS train FROM ex WHERE variant = 'current'),
  st AS (SELECT variant, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test, avg(r) FILTER (train) AS exp_train, avg(r) FILTER (NOT train) AS exp_test, avg(CAST(r > 0 AS DOUBLE)) FILTER (NOT train) AS hit_test,
    avg(CAST(outcome = 'stop' AS DOUBLE)) FILTER (NOT train) AS stop_test, median(realized / mfe) FILTER (NOT train AND mfe > 0.005 AND realized > 0) AS mfe_capture FROM ex JOIN sd USING (symbol, entry_date) GROUP BY 1),
  wi AS (SELECT s.variant, s.exp_test - b.exp_test AS gain FROM st s, st b WHERE b.variant = 'current' AND s.exp_train > b.exp_train AND s.exp_test > b.exp_test AND s.mfe_capture >= 0.6)
  SELECT *, CASE WHEN variant = (SELECT variant FROM wi ORDER BY gain DESC LIMIT 1) THEN 'ADOPT' WHEN variant = 'current' AND (SELECT count(*) FROM wi) = 0 THEN 'KEEP' ELSE 'reject' END AS verdict FROM st""",
      "exp_train exp_test hit_test stop_test mfe_capture", 5)(lambda t: X.calibrated(exits(t)))
query("agg_whipsaw", RECO_VIEWS, f"WITH {EXITS} SELECT count(*) AS stopped, count(*) FILTER (mfe >= aim) AS reversed, count(*) FILTER (mfe >= aim) / greatest(count(*), 1) AS share FROM ex WHERE variant = 'current' AND outcome = 'stop'", "share")(
    lambda t: X.whipsaw(exits(t)))

TECHNICAL = f"""{TR}, tu AS (SELECT *, high - lag(high) {W} AS up, lag(low) {W} - low AS dn FROM tr),
  tp AS (SELECT *, CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END AS p,
    CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END AS m FROM tu),
  td AS (""" + win("SELECT symbol, date, ROLL(avg, tr, 14) / close * 100 AS atr_pct, ROLL(avg, p, 14) / ROLL(avg, tr, 14) * 100 AS a, ROLL(avg, m, 14) / ROLL(avg, tr, 14) * 100 AS b FROM tp") + """),
  tech AS (SELECT symbol, date, atr_pct, abs(a - b) / nullif(a + b, 0) * 100 AS adx FROM td)"""
CARDS = f"""{DAILY}, {TECHNICAL}, cd AS (SELECT date AS rebal_date, daily.*, atr_pct, adx FROM daily JOIN month_ends ON date = rebal_date JOIN tech USING (symbol, date)),
  {mean_rank_sql('cd')}, book AS (SELECT * FROM (SELECT *, {DEC('composite')} AS decile FROM cp) WHERE decile = 10)"""


def cards(t: Tables) -> DataFrame:
    """The top decile of the composite at each month end, with technical columns."""
    technical = S.technical(t.bars.select("symbol", "date", "high", "low", "close")).select("symbol", "date", "atr_pct", "adx")
    technical = technical.join(F.broadcast(month_days(t)), "date", "left_semi")
    daily = T.daily_features(t.bars, t.delivery, month_days(t)).join(technical, ["symbol", "date"]).withColumnRenamed("date", "rebal_date")
    ranked = T.mean_rank(daily, T.COMPOSITE)
    return T._decile(ranked, "composite", 10)


query("idea_bands", RECO_VIEWS, f"""WITH {CARDS}, ia AS (SELECT rebal_date, symbol, close AS entry, atr_pct / 100 AS f, coalesce(adx, 0) >= 25 AND coalesce(dist_sma200, 0) > 0 AS strong FROM book),
  ib AS (SELECT *, CASE WHEN strong THEN 2.75 ELSE 1.75 END AS atr_k FROM ia WHERE entry > 0 AND f > 0 AND f < 0.9),
  ic AS (SELECT *, CAST(round(CAST(entry - least(entry * atr_k * f, entry * 0.10) AS DECIMAL(24, 6)), 2) AS DOUBLE) AS stop FROM ib),
  id AS (SELECT *, CAST(round(CAST(entry + 2 * (entry - stop) AS DECIMAL(24, 6)), 2) AS DOUBLE) AS target, CAST(least(floor(1e4 / (entry - stop)), floor(0.1 * 1e7 / entry)) AS BIGINT) AS size FROM ic WHERE entry - stop > 0)
  SELECT rebal_date, symbol, CASE WHEN strong THEN 'positional' ELSE 'swing' END AS timeframe, CAST(atr_k AS DOUBLE) AS atr_k, entry, stop, target, size FROM id WHERE size >= 1""",
      "atr_k entry stop target", 3)(
    lambda t: K.bands(cards(t).withColumn("entry", F.col("close"))).select("rebal_date", "symbol", "timeframe", "atr_k", "entry", "stop", "target", "size"))

VOTED = """ir AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM index_series),
  iv AS (SELECT *, CASE WHEN count(r) OVER (ORDER BY date ROWS 20 PRECEDING) >= 21 THEN stddev_samp(r) OVER (ORDER BY date ROWS 20 PRECEDING) END AS v,
    CASE WHEN count(close) OVER (ORDER BY date ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS a, close / lag(close, 63) OVER (ORDER BY date) - 1 AS m FROM ir),
  im AS (SELECT *, CASE WHEN count(v) OVER (ORDER BY date ROWS 251 PRECEDING) >= 252 THEN median(v) OVER (ORDER BY date ROWS 251 PRECEDING) END AS md FROM iv),
  votes AS (SELECT im.date, CAST(coalesce(close > a, false) AS INTEGER) + CAST(coalesce(v < md, false) AS INTEGER) + CAST(coalesce(pct_above_200dma >= 50, false) AS INTEGER)
    + CAST(coalesce(m > 0, false) AS INTEGER) AS votes FROM im LEFT JOIN breadth USING (date))"""
#: Corporate actions stand for the event layer: bonus bullish, split bearish, dividend a risk flag for 21 days.
SCORED = f"""{CARDS}, {BREADTH}, {VOTED},
  ev AS (SELECT DISTINCT symbol, date AS event_date, action_type FROM corporate_actions),
  s1 AS (SELECT book.*, votes FROM book LEFT JOIN votes ON votes.date = book.rebal_date),
  s2 AS (SELECT s1.*, e.event_date AS bull FROM s1 ASOF LEFT JOIN (SELECT * FROM ev WHERE action_type = 'BONUS') e ON e.symbol = s1.symbol AND e.event_date < s1.rebal_date),
  s3 AS (SELECT s2.*, e.event_date AS risk FROM s2 ASOF LEFT JOIN (SELECT * FROM ev WHERE action_type = 'DIVIDEND') e ON e.symbol = s2.symbol AND e.event_date < s2.rebal_date),
  pl AS (SELECT rebal_date, symbol, greatest(0, least(100, composite * 100)) AS signal_strength,
    0.5 * greatest(0, least(100, 50 + coalesce(dist_sma200 * 100, 0))) + 0.5 * greatest(0, least(100, coalesce(adx, 0) * 2)) AS trend_align,
    coalesce(votes, 0) / 4.0 * 100 AS regime_align, greatest(0, least(100, coalesce(deliv_1m, 50))) AS confirmation,
    100 * cume_dist() OVER (PARTITION BY rebal_date ORDER BY turnover NULLS LAST) AS liquidity_capacity,
    CASE WHEN rebal_date - bull <= 63 THEN greatest(0, least(100, 50 + 50 * (1 - (rebal_date - bull) / 63.0))) ELSE 50 END AS event_score,
    greatest(0, least(100, coalesce(atr_pct, 0) * 10 + CASE WHEN rebal_date - risk <= 21 THEN 25 ELSE 0 END)) AS risk_penalty FROM s3)"""
SCORE_VIEWS = "bars delivery month_ends index_series corporate_actions"


def scored(t: Tables) -> DataFrame:
    votes = C.regime_votes(t.index_series, A.breadth(t.bars))
    votes = votes.select(F.col("date").alias("rebal_date"), (F.col("trend") + F.col("calm") + F.col("broad") + F.col("momentum")).alias("votes"))
    kind = F.col("action_type")
    events = t.corporate_actions.select(
        "symbol", F.col("date").alias("event_date"), F.when(kind == "DIVIDEND", "risk").otherwise("scored").alias("tier"),
        F.when(kind == "BONUS", "bullish").otherwise("bearish").alias("direction"), kind.alias("event_type"),
    ).distinct()
    return K.pillars(K.event_score(cards(t).join(votes, "rebal_date", "left"), events, {"DIVIDEND": 21}))


query("score_pillars", SCORE_VIEWS, f"WITH {SCORED} SELECT * FROM pl", " ".join(K.WEIGHTS), 4)(scored)
AUDIT = " UNION ALL ".join(
    f"SELECT rebal_date, symbol, '{p}' AS pillar, CAST({p} AS DOUBLE) AS subscore, CAST({w} AS DOUBLE) AS weight FROM pl" for p, w in K.WEIGHTS.items())
KINDS = ("momentum", "value", "quality")
query("score_confidence", SCORE_VIEWS + " statements", f"""WITH {SCORED}, au AS ({AUDIT}), yr AS (SELECT symbol, count(DISTINCT year(quarter)) AS years FROM statements GROUP BY 1),
  ax AS (SELECT *, ['momentum', 'value', 'quality'][CAST(symbol AS INTEGER) % 3 + 1] AS thesis, greatest(0, least(100, sum(weight * subscore) OVER (PARTITION BY rebal_date, symbol))) AS total FROM au)
  SELECT rebal_date, ax.symbol, thesis, pillar, subscore, weight, weight * subscore AS contribution,
    CASE WHEN thesis <> 'momentum' AND coalesce(years, 0) < 8 THEN least(total, 70) ELSE total END AS confidence FROM ax LEFT JOIN yr USING (symbol)""",
      "subscore weight contribution confidence", 4)(
    lambda t: K.confidence(scored(t), K.statement_years(t.statements), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("symbol").cast("int") % 3 + 1).cast("int"))))
