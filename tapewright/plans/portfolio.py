"""Queries over books, back-tests, validation, recommendations and risk."""

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import by_symbol, qcut_decile, rank_pct
from ..operators import books as B
from ..operators import series as S
from ..operators import stats as A
from .aggregates import BREADTH, G
from .joins import NEXT, realized
from .series import DEC, PANEL, PCT, PV, SMA, panel

DR = f"{NEXT}, dr AS (SELECT *, {DEC('mom')} AS decile FROM rz)"
deciled = lambda r: r.withColumn("decile", qcut_decile("mom", "rebal_date"))
book = lambda t: deciled(realized(t))
BOOK = f"""{DR}, en AS (SELECT rebal_date FROM dr GROUP BY 1 HAVING count(decile) >= 10), bk AS (SELECT dr.* FROM dr JOIN en USING (rebal_date) WHERE decile IN (1, 10)), bn AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS nxt FROM (SELECT DISTINCT rebal_date FROM bk)),
  pv AS (SELECT nxt AS rebal_date, symbol, decile, 1 AS held FROM bk JOIN bn USING (rebal_date)), lg AS (SELECT bk.rebal_date, bk.decile, avg(realized) AS ret, 2 * avg(CAST(held IS NULL AS DOUBLE)) * 30 / 1e4 AS cost FROM bk LEFT JOIN pv USING (rebal_date, symbol, decile) GROUP BY 1, 2),
  db AS (SELECT rebal_date, max(ret) FILTER (decile = 10) AS long_gross, max(ret) FILTER (decile = 1) AS short_gross, max(ret - cost) FILTER (decile = 10) AS long_net, max(ret) FILTER (decile = 10) - max(ret) FILTER (decile = 1) - max(cost) FILTER (decile = 10) - max(cost) FILTER (decile = 1) AS ls_net FROM lg GROUP BY 1)"""
G("bt_decile_book", PV, f"WITH {BOOK} SELECT * FROM db", "long_gross short_gross long_net ls_net", lambda t: B.decile_book(book(t)))
SWEEP = "0, 10, 20, 30, 50"
G("bt_cost_sweep", PV, f"WITH {BOOK} SELECT bps, avg(long_gross - (long_gross - long_net) / 30 * bps) AS mean_net, count(*) AS n FROM db, (SELECT unnest([{SWEEP}]) AS bps) GROUP BY 1", "mean_net",
  lambda t: B.decile_book(book(t)).withColumn("bps", F.explode(F.array(*map(F.lit, (0, 10, 20, 30, 50))))).groupBy("bps").agg(F.avg(F.col("long_gross") - (F.col("long_gross") - F.col("long_net")) / 30 * F.col("bps")).alias("mean_net"), F.count("*").alias("n")))
PF = f"""{NEXT}, wb AS (SELECT rebal_date, symbol, realized, 1.0 / count(*) OVER (PARTITION BY rebal_date) AS weight FROM rz WHERE prox > 0.9), wn AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS nxt FROM (SELECT DISTINCT rebal_date FROM wb)), wp AS (SELECT nxt AS rebal_date, symbol, weight AS pw FROM wb JOIN wn USING (rebal_date) WHERE nxt IS NOT NULL),
  df AS (SELECT rebal_date, symbol, coalesce(weight, 0) AS weight, coalesce(weight, 0) - coalesce(pw, 0) AS delta FROM wb FULL JOIN wp USING (rebal_date, symbol)), pf AS (SELECT g.rebal_date, gross, names, turnover, gross - turnover * 30 / 1e4 AS net FROM (SELECT rebal_date, sum(weight * realized) AS gross, count(*) AS names FROM wb GROUP BY 1) g JOIN (SELECT rebal_date, sum(abs(delta)) AS turnover FROM df GROUP BY 1) USING (rebal_date))"""
highs = lambda r: r.where("prox > 0.9").select("rebal_date", "symbol", F.lit(1.0).alias("weight"), "realized", "close", "turnover")
near_high = lambda t: highs(realized(t))
folio = lambda t: B.portfolio(near_high(t))
ADV = f"av AS (SELECT symbol, date AS rebal_date, avg(close * volume) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS adv FROM bars)"


def with_adv(t, book):
    """The book with the mean turnover of the last five bars."""
    adv = F.avg(F.col("close") * F.col("volume")).over(by_symbol().rowsBetween(-4, 0))
    return book.join(t.bars.select("symbol", F.col("date").alias("rebal_date"), adv.alias("adv")), ["symbol", "rebal_date"])


def capacity(t):
    book = near_high(t)
    return B.capacity_curve(with_adv(t, book), B.portfolio(book), (1e4, 1e5, 1e6))


G("bt_capacity_curve", PV, f"""WITH {PF}, {ADV}, ia AS (SELECT aum, rebal_date, sum(weight * 0.025 * sqrt(least(aum * weight / nullif(adv, 0), 10))) AS i
    FROM wb JOIN av USING (rebal_date, symbol), (SELECT unnest([10000.0, 100000.0, 1000000.0]) AS aum) GROUP BY 1, 2)
  SELECT CAST(aum AS DOUBLE) AS aum, avg(i) AS impact, avg(i) * (SELECT avg(turnover) FROM pf) AS cost FROM ia GROUP BY 1""", "aum impact cost", capacity)
GATE = f"{PF}, {BREADTH}, gt AS (SELECT rebal_date, net AS ret, pct_above_200dma AS score FROM pf LEFT JOIN breadth ON date = rebal_date)"
breadth_scores = lambda t: A.share_above(t.bars).withColumnRenamed("date", "rebal_date")
gate_in = lambda t: (folio(t).select("rebal_date", F.col("net").alias("ret")), breadth_scores(t))
G("bt_gate_threshold", PV, f"WITH {GATE} SELECT rebal_date, CASE WHEN coalesce(score >= 50, true) THEN ret ELSE 0 END AS ret FROM gt", "ret",
  lambda t: (lambda r, s: r.join(s, "rebal_date", "left").select("rebal_date", F.when(F.coalesce(F.col("score") >= 50, F.lit(True)), F.col("ret")).otherwise(0.0).alias("ret")))(*gate_in(t)))
WF = f"""{GATE}, tg AS (SELECT rebal_date, th, CASE WHEN coalesce(score >= th, true) THEN ret ELSE 0 END AS g FROM gt, (SELECT unnest([40.0, 50.0, 60.0]) AS th)), tp AS (SELECT *, count(g) OVER w AS n, coalesce(round(avg(g) OVER w / nullif(stddev_samp(g) OVER w, 0), 9), -1e9) AS s FROM tg WINDOW w AS (PARTITION BY th ORDER BY rebal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  wf AS (SELECT rebal_date, CAST(th AS DOUBLE) AS threshold, g AS ret FROM tp WHERE n >= 24 QUALIFY row_number() OVER (PARTITION BY rebal_date ORDER BY s DESC, th) = 1)"""
wf = lambda t: B.walkforward_gate(*gate_in(t), [40, 50, 60])
G("bt_walkforward_gate", PV, f"WITH {WF} SELECT * FROM wf", "threshold ret", wf)
G("bt_gate_compare", PV, f"WITH {WF}, c AS (SELECT wf.ret AS a, gt.ret AS b FROM wf JOIN gt USING (rebal_date)) SELECT count(*) AS n, avg(a) / stddev_samp(a) * sqrt(12) AS challenger, avg(b) / stddev_samp(b) * sqrt(12) AS incumbent, avg(a) / stddev_samp(a) > avg(b) / stddev_samp(b) AS ship FROM c", "challenger incumbent",
  lambda t: B.gate_compare(wf(t), gate_in(t)[0]), 5)
IW = """ul AS (SELECT rebal_date, symbol, fwd, 'mom' AS signal, mom AS v FROM panel UNION ALL SELECT rebal_date, symbol, fwd, 'prox', prox FROM panel), uf AS (SELECT * FROM ul WHERE v IS NOT NULL AND fwd IS NOT NULL), ur AS (SELECT rebal_date, signal, rank() OVER (PARTITION BY rebal_date, signal ORDER BY v) + (count(*) OVER (PARTITION BY rebal_date, signal, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY rebal_date, signal ORDER BY fwd) + (count(*) OVER (PARTITION BY rebal_date, signal, fwd) - 1) / 2.0 AS b FROM uf),
  ui AS (SELECT rebal_date, signal, corr(a, b) AS ic FROM ur GROUP BY 1, 2 HAVING count(*) >= 5), up AS (SELECT *, avg(ic) OVER w AS m, count(ic) OVER w AS n FROM ui WINDOW w AS (PARTITION BY signal ORDER BY rebal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), iw AS (SELECT rebal_date, signal, coalesce(greatest(m, 0) / nullif(sum(greatest(m, 0)) OVER (PARTITION BY rebal_date), 0), 0) AS weight FROM up WHERE n >= 12)"""
G("bt_ic_weighted", PV, f"WITH {NEXT}, {IW} SELECT * FROM iw", "weight", lambda t: B.ic_weighted(panel(t), ["mom", "prox"], "fwd"), 5)
GRID = f"""{DR}, {BREADTH}, cg AS (SELECT dr.*, cut FROM dr, (SELECT unnest([10, 9, 8]) AS cut) WHERE decile >= cut),
  cn AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS nxt FROM (SELECT DISTINCT rebal_date FROM cg)),
  ch AS (SELECT nxt AS rebal_date, symbol, cut, 1 AS held FROM cg JOIN cn USING (rebal_date)),
  cr AS (SELECT rebal_date, cut, avg(realized) - 2 * avg(CAST(held IS NULL AS DOUBLE)) * 30 / 1e4 AS net FROM cg LEFT JOIN ch USING (rebal_date, symbol, cut) GROUP BY 1, 2),
  cc AS (SELECT cut, th, rebal_date, CASE WHEN coalesce(pct_above_200dma >= th, true) THEN net ELSE 0 END AS ret FROM cr LEFT JOIN breadth ON date = rebal_date,
    (SELECT unnest([40.0, 50.0, 60.0]) AS th)),
  grid AS (SELECT cut, CAST(th AS DOUBLE) AS threshold, count(*) AS months, avg(ret) * sqrt(12) / nullif(stddev_samp(ret), 0) AS sharpe,
    CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 12.0 / count(*)) - 1 END AS cagr FROM cc GROUP BY 1, 2 HAVING count(*) >= 12)"""
grid = lambda t: B.cut_grid(book(t), breadth_scores(t))
G("bt_param_grid", PV, f"WITH {GRID} SELECT * FROM grid", "threshold sharpe cagr", grid, 5)


def psr_dsr(t):
    """The book and the grid of its trials over one stored panel."""
    r = realized(t)
    return B.deflated_sharpe(B.portfolio(highs(r)).select(F.col("net").alias("ret")), B.cut_grid(deciled(r), breadth_scores(t)))


NC = "(0.5 * (1 + sign(Z) * (1 - ((((1.061405429 / (1 + 0.3275911 * abs(Z)) - 1.453152027) / (1 + 0.3275911 * abs(Z)) + 1.421413741) / (1 + 0.3275911 * abs(Z)) - 0.284496736) / (1 + 0.3275911 * abs(Z)) + 0.254829592) / (1 + 0.3275911 * abs(Z)) * exp(-Z * Z))))"
PPF = {n: NormalDist().inv_cdf(p) for n, p in (("a", 1 - 1 / 9), ("b", 1 - 1 / (9 * math.e)))}
PSR_Z = lambda b: f"(sr - {b}) * sqrt(n - 1) / sqrt(greatest(1e-9, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)) / sqrt(2)"
G("bt_psr_dsr", PV, f"""WITH {PF}, {GRID[len(NEXT) + 2:]}, m AS (SELECT count(net) AS n, avg(net) / stddev_samp(net) AS sr, skewness(net) AS skew, kurtosis(net) + 3 AS kurt FROM pf),
  tv AS (SELECT var_samp(sharpe / sqrt(12)) AS v, count(sharpe) AS trials FROM grid), eb AS (SELECT m.*, trials, sqrt(v) * ((1 - 0.5772156649015329) * {PPF["a"]!r} + 0.5772156649015329 * {PPF["b"]!r}) AS best FROM m, tv),
  z AS (SELECT *, {PSR_Z("0")} AS z0, {PSR_Z("best")} AS z1 FROM eb)
  SELECT n, sr, skew, kurt, {NC.replace('Z', 'z0')} AS psr, trials, {NC.replace('Z', 'z1')} AS dsr, best * sqrt(12) AS expected_best FROM z""", "sr skew kurt psr dsr expected_best",
  psr_dsr, 5)
G("bt_block_bootstrap", PV, None, "", lambda t: B.block_bootstrap(folio(t).select("rebal_date", F.col("net").alias("ret"))))
G("bt_drift_corr", PV, f"WITH {PF} SELECT corr(net, p) AS drift_corr, count(p) AS n FROM (SELECT net, lag(net) OVER (ORDER BY rebal_date) AS p FROM pf)", "drift_corr", lambda t: folio(t).withColumn("p", F.lag("net").over(Window.orderBy("rebal_date"))).agg(F.corr("net", "p").alias("drift_corr"), F.count("p").alias("n")))
G("cpcv_paths", "bars month_ends", """WITH d AS (SELECT rebal_date, row_number() OVER (ORDER BY rebal_date) - 1 AS i, count(*) OVER () AS n FROM month_ends), g AS (SELECT rebal_date, i, CAST(floor(i * 6 / n) AS INTEGER) AS g FROM d), p AS (SELECT rebal_date, i, CAST(a.x AS INTEGER) AS g1, CAST(b.x AS INTEGER) AS g2, g = a.x OR g = b.x AS test FROM g, range(6) a(x), range(6) b(x) WHERE a.x < b.x)
  SELECT rebal_date, g1, g2, CASE WHEN test THEN 'test' WHEN coalesce(lag(test) OVER w, false) OR coalesce(lead(test) OVER w, false) THEN 'purged' ELSE 'train' END AS role FROM p WINDOW w AS (PARTITION BY g1, g2 ORDER BY i)""", "", lambda t: B.cpcv_paths(t.month_ends))
FNO = """fo AS (SELECT date AS d, symbol, coalesce(sum(open_int) FILTER (option_typ = 'PE'), 0) / sum(open_int) FILTER (option_typ = 'CE') AS pcr, sum(open_int) AS oi FROM option_chain GROUP BY 1, 2),
  fm AS (SELECT *, oi / lag(oi) OVER (PARTITION BY symbol ORDER BY d) - 1 AS oi_chg FROM fo), fz AS (SELECT *, (oi_chg - avg(oi_chg) OVER (PARTITION BY d)) / nullif(stddev_pop(oi_chg) OVER (PARTITION BY d), 0) AS oi_z FROM fm),
  fl AS (SELECT last_day(rebal_date) AS d, symbol, fwd FROM panel), fv AS (SELECT d, symbol, fwd, 'pcr_oi' AS feature, pcr AS v FROM fz JOIN fl USING (d, symbol) UNION ALL SELECT d, symbol, fwd, 'oi_chg', oi_chg FROM fz JOIN fl USING (d, symbol)
    UNION ALL SELECT d, symbol, fwd, 'oi_z', round(oi_z, 9) FROM fz JOIN fl USING (d, symbol)),
  fr AS (SELECT feature, d, rank() OVER (PARTITION BY feature, d ORDER BY v) + (count(*) OVER (PARTITION BY feature, d, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, d ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, d, fwd) - 1) / 2.0 AS b
    FROM fv WHERE v IS NOT NULL AND fwd IS NOT NULL)"""


def option_features(t):
    """Put-call ratio, change of open interest and its z-score against the forward return, per month end."""
    oi = A.pcr(t.option_chain).withColumn("oi", F.col("call_oi") + F.col("put_oi")).withColumn("oi_chg", F.col("oi") / F.lag("oi").over(by_symbol()) - 1)
    w = Window.partitionBy("date")
    oi = oi.withColumn("oi_z", F.round(F.try_divide(F.col("oi_chg") - F.avg("oi_chg").over(w), F.stddev_pop("oi_chg").over(w)), 9))
    labels = panel(t).select(F.last_day("rebal_date").alias("date"), "symbol", "fwd")
    return oi.join(labels, ["date", "symbol"]).unpivot(["date", "symbol", "fwd"], ["pcr_oi", "oi_chg", "oi_z"], "feature", "v")


def option_ic(t):
    keyed = option_features(t).withColumn("_k", F.struct("feature", F.col("date").alias("d")))
    return A.rank_ic(keyed, "v", "fwd", "_k", 8).select("_k.*", "ic", "n")


G("fno_feature_ic", PV + " option_chain", f"WITH {NEXT}, {FNO} SELECT feature, d, corr(a, b) AS ic, count(*) AS n FROM fr GROUP BY 1, 2 HAVING count(*) >= 8", "ic", option_ic, 5)

# cards, risk
G("idea_book_greedy", "", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS VARCHAR) AS symbol, o_totalprice AS notional, CAST(o_custkey % 97 AS DOUBLE) AS confidence FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY confidence DESC, symbol, notional) AS i FROM c),
  f AS (SELECT date, i, symbol, notional <= 5e5 AS taken, 5e5 - CASE WHEN notional <= 5e5 THEN notional ELSE 0 END AS capital FROM k WHERE i = 1
    UNION ALL SELECT k.date, k.i, k.symbol, k.notional <= f.capital, f.capital - CASE WHEN k.notional <= f.capital THEN k.notional ELSE 0 END FROM f JOIN k ON k.date = f.date AND k.i = f.i + 1)
  SELECT date, CAST(row_number() OVER (PARTITION BY date ORDER BY i) AS INTEGER) AS rank, symbol FROM f WHERE taken""", "",
  lambda t: B.greedy_book(t.orders.select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").cast("string").alias("symbol"), F.col("o_totalprice").alias("notional"), (F.col("o_custkey") % 97).cast("double").alias("confidence")), 5e5))
G("idea_context_tags", PV + " corporate_actions", f"""WITH {PANEL}, {SMA}, rg AS (SELECT symbol, date, CASE WHEN close > s50 AND s50 > s200 THEN 'bull' WHEN close < s50 AND s50 < s200 THEN 'bear' ELSE 'sideways' END AS regime FROM a)
  SELECT p.rebal_date, p.symbol, CAST(to_json({{'regime': any_value(regime), 'sector': any_value(sector), 'events': coalesce(list_sort(list(DISTINCT action_type) FILTER (action_type IS NOT NULL)), [])}}) AS VARCHAR) AS context
  FROM panel p JOIN rg ON rg.symbol = p.symbol AND rg.date = p.rebal_date LEFT JOIN corporate_actions c ON c.symbol = p.symbol AND c.date < p.rebal_date AND c.date >= p.rebal_date - 63 GROUP BY 1, 2""", "",
  lambda t: B.context_tags(panel(t).join(S.regime_label(t.bars).select("symbol", F.col("date").alias("rebal_date"), "regime"), ["symbol", "rebal_date"]),
                           t.corporate_actions.select("symbol", F.col("date").alias("event_date"), F.col("action_type").alias("kind"))))
HORIZON = "CASE WHEN CAST(strategy AS INTEGER) % 2 = 0 THEN 21 ELSE 63 END"
G("idea_lifecycle", "trades", f"""WITH c AS (SELECT trade_id, exit_date AS issue_date, exit_date + CAST(round({HORIZON} * 365 / 252.0) AS INTEGER) AS target_date, entry_price AS entry, entry_price * 1.09 AS target, stop, entry_price * (1 + realized) AS price FROM trades)
  SELECT trade_id, issue_date, target_date, CAST(target_date - DATE '2000-06-30' AS INTEGER) AS days_left, CAST(DATE '2000-06-30' - issue_date AS INTEGER) AS days_held, target / entry - 1 AS profit_target, stop / entry - 1 AS stop_risk, price / entry - 1 AS pl,
    (price - entry) / (target - entry) AS progress FROM c""", "profit_target stop_risk pl progress",
  lambda t: B.lifecycle(t.trades.select("trade_id", F.col("exit_date").alias("issue_date"), F.expr(HORIZON).alias("horizon_td"), F.col("entry_price").alias("entry"), (F.col("entry_price") * 1.09).alias("target"), "stop",
                                        (F.col("entry_price") * (1 + F.col("realized"))).alias("price")), "2000-06-30"))
G("score_weight_shrink", "trades", "WITH e AS (SELECT strategy, count(*) AS n, 0.1 AS prior, avg(CAST(realized > 0 AS DOUBLE)) AS estimate FROM trades GROUP BY 1), s AS (SELECT strategy, CASE WHEN n >= 30 THEN prior + greatest(least((100 * prior + n * estimate) / (100 + n) - prior, 0.02), -0.02) ELSE prior END AS raw FROM e) SELECT strategy, raw / sum(raw) OVER () AS weight FROM s", "weight",
  lambda t: B.shrink_weights(t.trades.groupBy("strategy").agg(F.count("*").alias("n"), F.avg((F.col("realized") > 0).cast("double")).alias("estimate")).withColumns({"prior": F.lit(0.1), "group": F.lit(0)})).select("strategy", "weight"))
#: Trades stand for recommendations; those of the last month of 1997 and later are still open.
RECS = """rc AS (SELECT trade_id AS rec_id, ['momentum_delivery_lowvol', 'Value_ey', 'macro rates', 'reversal'][CAST(strategy AS INTEGER) % 4 + 1] AS strategy, CASE WHEN trade_id % 3 = 0 THEN 63 ELSE 21 END AS horizon, entry_price AS entry, entry_price * 1.09 AS target, stop,
  CASE WHEN exit_date < DATE '1997-12-01' THEN exit_date END AS close_date, CASE WHEN exit_date < DATE '1997-12-01' THEN entry_price * (1 + realized) END AS exit_price, CASE WHEN exit_date < DATE '1997-12-01' THEN realized END AS realized,
  CASE WHEN exit_date < DATE '1997-12-01' THEN CASE outcome WHEN 'target' THEN 'TARGET' WHEN 'stop' THEN 'STOP' ELSE CASE WHEN realized > 0 THEN 'EXPIRED_WIN' ELSE 'EXPIRED_LOSS' END END END AS outcome FROM trades)"""


def recorded(t):
    names = F.array(*map(F.lit, ("momentum_delivery_lowvol", "Value_ey", "macro rates", "reversal")))
    shut = F.col("exit_date") < F.lit("1997-12-01").cast("date")
    ended = F.when(F.col("outcome") == "target", "TARGET").when(F.col("outcome") == "stop", "STOP").when(F.col("realized") > 0, "EXPIRED_WIN").otherwise("EXPIRED_LOSS")
    return t.trades.select(
        F.col("trade_id").alias("rec_id"), F.element_at(names, (F.col("strategy").cast("int") % 4 + 1).cast("int")).alias("strategy"), F.when(F.col("trade_id") % 3 == 0, 63).otherwise(21).alias("horizon"),
        F.col("entry_price").alias("entry"), (F.col("entry_price") * 1.09).alias("target"), "stop", F.when(shut, F.col("exit_date")).alias("close_date"),
        F.when(shut, F.col("entry_price") * (1 + F.col("realized"))).alias("exit_price"), F.when(shut, F.col("realized")).alias("realized"), F.when(shut, ended).alias("outcome"))


G("reco_to_trades", "trades", f"""WITH {RECS}, pa AS (SELECT avg(realized) AS m FROM rc) SELECT rec_id AS thesis_id, CASE WHEN strategy LIKE '%momentum%' THEN 'momentum' WHEN strategy LIKE 'Value%' THEN 'value' WHEN strategy LIKE 'macro%' THEN 'macro_overlay' ELSE 'momentum' END AS thesis_type,
  CASE WHEN horizon <= 21 THEN 'swing' ELSE 'positional' END AS timeframe, CASE WHEN close_date IS NULL THEN 'active' ELSE 'closed' END AS status, entry AS entry_price, stop, target, close_date AS exit_date, exit_price,
  CASE WHEN outcome LIKE 'EXPIRED%' THEN 'expired' ELSE lower(outcome) END AS exit_reason, realized AS realized_return, m AS rec_mean, m AS trade_mean, true AS parity FROM rc, pa""", "entry_price stop target exit_price realized_return rec_mean trade_mean",
  lambda t: (lambda r: B.trades_of(r).crossJoin(F.broadcast(B.trade_parity(r, B.trades_of(r)))))(recorded(t)), 4)  # one row
CURVE = """a AS (SELECT *, realized / ((entry_price - stop) / entry_price) AS r FROM trades), b AS (SELECT *, r * 10000 AS pnl, sum(r * 10000) OVER w AS equity, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY strategy ORDER BY exit_date, trade_id ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT *, greatest(max(equity) OVER w, 0) AS hwm, n - coalesce(max(CASE WHEN r > 0 THEN n END) OVER w, 0) AS streak FROM b WINDOW w AS (PARTITION BY strategy ORDER BY exit_date, trade_id ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, (hwm - equity) / (hwm + 1e6) AS drawdown FROM c), vo AS (SELECT date AS exit_date, CAST(pct_above_200dma >= 50 AS INTEGER) + CAST(advances >= greatest(declines, 1) AS INTEGER) AS votes FROM breadth),
  co AS (SELECT strategy, corr(realized, p) AS k FROM (SELECT strategy, realized, lag(realized) OVER (PARTITION BY strategy ORDER BY exit_date, trade_id) AS p FROM trades) GROUP BY 1)"""


def risk_state(t):
    """With two votes of breadth for the regime's four, and each strategy's serial correlation, ten times, for that of the names of its book."""
    breadth = A.breadth(t.bars)
    votes = breadth.select(F.col("date").alias("exit_date"), ((F.col("pct_above_200dma") >= 50).cast("int") + (F.col("ad_ratio") >= 1).cast("int")).alias("votes"))
    before = F.lag("realized").over(Window.partitionBy("strategy").orderBy("exit_date", "trade_id"))
    serial = t.trades.withColumn("_p", before).groupBy("strategy").agg((10 * F.corr("realized", "_p")).alias("correlation"))
    return B.max_cards(B.risk_curve(t.trades), votes, serial).drop("exit_date")


G("risk_equity_curve", "trades bars", f"""WITH {BREADTH}, {CURVE} SELECT d.strategy, trade_id, r, pnl, equity, drawdown, CAST(streak AS INTEGER) AS streak,
    least(CASE WHEN drawdown >= 0.22 THEN 0.25 WHEN drawdown >= 0.15 THEN 0.5 WHEN drawdown >= 0.10 THEN 0.75 ELSE 1.0 END, CASE WHEN streak >= 3 THEN 0.75 ELSE 1.0 END) AS multiplier, drawdown >= 0.22 AS halt,
    CAST(floor(CASE WHEN coalesce(votes, 0) >= 2 THEN 50 ELSE 25 END / CASE WHEN 10 * k > 0.6 THEN 2.0 ELSE 1.0 END) AS INTEGER) AS max_cards FROM d LEFT JOIN vo USING (exit_date) LEFT JOIN co ON co.strategy = d.strategy""",
  "r pnl equity drawdown multiplier", risk_state, 3)
ORDERS = """os AS (SELECT rebal_date, symbol, floor(1e6 * least(weight, 0.06) / close) AS shares FROM wb JOIN rz USING (rebal_date, symbol)),
  oc AS (SELECT rebal_date, symbol, shares FROM os UNION ALL SELECT nxt, symbol, -shares FROM os JOIN wn USING (rebal_date) WHERE nxt IS NOT NULL),
  od AS (SELECT rebal_date, symbol, sum(shares) AS delta FROM oc GROUP BY 1, 2 HAVING sum(shares) <> 0), oo AS (SELECT od.*, abs(delta) * close AS notional, turnover FROM od JOIN panel USING (rebal_date, symbol))"""
G("order_risk_check", PV, f"""WITH {PF}, {ORDERS} SELECT rebal_date, symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(abs(delta) AS BIGINT) AS shares, notional,
  CASE WHEN notional < 5000 THEN 'ticket' WHEN notional > 0.06 * 1e6 * 1.05 THEN 'cap' WHEN turnover > 0 AND notional > 0.1 * turnover THEN 'adv' ELSE 'ok' END AS verdict FROM oo""", "notional",
  lambda t: B.checked_orders(B.normalized(near_high(t)), panel(t).select("rebal_date", "symbol", "close", F.col("turnover").alias("adv")), 1e6).withColumn("shares", F.col("shares").cast("long")), 4)
CONFIDENT = "(trade_id * 37) % 101"
G("weekly_stats", "trades", f"""WITH g AS (SELECT CAST(date_trunc('week', exit_date) AS DATE) AS week, count(*) AS closed, avg(CAST(realized > 0 AS DOUBLE)) AS hit, avg(CASE WHEN entry_price > stop AND stop > 0 THEN realized / ((entry_price - stop) / entry_price) END) AS expectancy_r,
    count(*) FILTER ({CONFIDENT} >= 70 AND realized < 0) AS confident_losers, count(*) FILTER (outcome = 'expired') AS o FROM trades GROUP BY 1)
  SELECT week, closed, hit, expectancy_r, confident_losers, CAST(sum(o) OVER (ORDER BY week RANGE BETWEEN INTERVAL 63 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS waitlist FROM g""", "hit expectancy_r",
  lambda t: B.weekly_stats(t.trades.withColumns({"confidence": F.expr(CONFIDENT).cast("double"), "in_book": F.col("outcome") != "expired"})))
