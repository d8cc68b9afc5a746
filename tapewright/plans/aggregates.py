"""Queries over grouped aggregations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import by_symbol, median, qcut_decile
from ..operators import series as S
from ..operators import stats as A
from ..operators.scoring import statement_years
from .base import query
from .series import DEC, PANEL, PV, SEC, SMA, W, panel, sector_returns

G = lambda key, views, sql, doubles, f, digits=6: query(key, views, sql, doubles, digits)(f)

FRAME = lambda f, c, n, k: f"CASE WHEN count({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) >= {k} THEN {f}({c}) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) END"
BREADTH = f"""bq AS (SELECT *, close / lag(close) {W} - 1 AS r, {FRAME('max', 'high', 252, 60)} AS h, {FRAME('min', 'low', 252, 60)} AS l, {FRAME('avg', 'close', 50, 20)} AS a50, {FRAME('avg', 'close', 200, 50)} AS a200 FROM bars),
  breadth AS (SELECT date, count(*) FILTER (r > 0) AS advances, count(*) FILTER (r < 0) AS declines, count(*) FILTER (r = 0) AS unchanged, count(*) FILTER (high >= h) AS new_highs_52w, count(*) FILTER (low <= l) AS new_lows_52w,
  100 * avg(CASE WHEN a50 IS NOT NULL THEN CAST(close > a50 AS DOUBLE) END) AS pct_above_50dma, 100 * avg(CASE WHEN a200 IS NOT NULL THEN CAST(close > a200 AS DOUBLE) END) AS pct_above_200dma, count(*) AS total_traded FROM bq GROUP BY date)"""
G("agg_breadth_daily", "bars", f"WITH {BREADTH} SELECT *, advances / greatest(declines, 1) AS ad_ratio FROM breadth", "pct_above_50dma pct_above_200dma ad_ratio", lambda t: A.breadth(t.bars))
G("agg_pcr", "option_chain", """SELECT *, put_oi / nullif(call_oi, 0) AS pcr_oi, put_vol / nullif(call_vol, 0) AS pcr_vol FROM (SELECT date, symbol, sum(CASE WHEN option_typ = 'CE' THEN open_int ELSE 0 END) AS call_oi, sum(CASE WHEN option_typ = 'PE' THEN open_int ELSE 0 END) AS put_oi,
  CAST(sum(CASE WHEN option_typ = 'CE' THEN contracts ELSE 0 END) AS BIGINT) AS call_vol, CAST(sum(CASE WHEN option_typ = 'PE' THEN contracts ELSE 0 END) AS BIGINT) AS put_vol FROM option_chain GROUP BY 1, 2)""", "call_oi put_oi pcr_oi pcr_vol", lambda t: A.pcr(t.option_chain))
G("agg_fo_oi", "option_chain", "SELECT date, option_typ, sum(open_int) AS open_int, CAST(sum(contracts) AS BIGINT) AS contracts FROM option_chain GROUP BY 1, 2", "open_int",
  lambda t: t.option_chain.groupBy("date", "option_typ").agg(F.sum("open_int").alias("open_int"), F.sum("contracts").alias("contracts")))
G("agg_fut_oi_live", "option_chain", "WITH o AS (SELECT symbol, date, sum(open_int) AS oi FROM option_chain WHERE expiry >= date + 31 GROUP BY 1, 2) SELECT symbol, date, oi, oi - lag(oi) OVER (PARTITION BY symbol ORDER BY date) AS chg_oi FROM o", "oi chg_oi",
  lambda t: t.option_chain.where("expiry >= date_add(date, 31)").groupBy("symbol", "date").agg(F.sum("open_int").alias("oi")).withColumn("chg_oi", F.col("oi") - F.lag("oi").over(by_symbol())))
G("agg_deals_net", "insider_trades", "SELECT symbol, sum(CASE WHEN transaction_type = 'Buy' THEN value ELSE -value END) AS net FROM insider_trades WHERE transaction_type IN ('Buy', 'Sell') AND filing_date > (SELECT max(filing_date) FROM insider_trades) - 30 GROUP BY symbol HAVING net > 0 ORDER BY round(net, 2) DESC, symbol LIMIT 10", "net",
  lambda t: (lambda d, m: d.crossJoin(F.broadcast(m)).where("transaction_type IN ('Buy', 'Sell') AND filing_date > date_sub(m, 30)").groupBy("symbol").agg(F.sum(F.when(F.col("transaction_type") == "Buy", F.col("value")).otherwise(-F.col("value"))).alias("net")).where("net > 0").orderBy(F.round("net", 2).desc(), "symbol").limit(10))(
      t.insider_trades, t.insider_trades.agg(F.max("filing_date").alias("m"))), 2)
G("agg_insider_cluster_120d", "insider_trades", "SELECT symbol, count(DISTINCT name) AS insiders, sum(value) AS value FROM insider_trades WHERE transaction_type = 'Buy' AND filing_date > (SELECT max(filing_date) FROM insider_trades) - 120 GROUP BY symbol HAVING count(DISTINCT name) >= 3 ORDER BY insiders DESC, symbol LIMIT 12", "value",
  lambda t: (lambda d, m: d.crossJoin(F.broadcast(m)).where("transaction_type = 'Buy' AND filing_date > date_sub(m, 120)").groupBy("symbol").agg(F.count_distinct("name").alias("insiders"), F.sum("value").alias("value")).where("insiders >= 3").orderBy(F.desc("insiders"), "symbol").limit(12))(
      t.insider_trades, t.insider_trades.agg(F.max("filing_date").alias("m"))), 2)
G("agg_fii_pivot", "insider_trades", "SELECT filing_date, sum(value) FILTER (category = 'Promoters') AS promoters, sum(value) FILTER (category = 'Director') AS director, sum(value) FILTER (category = 'Employee') AS employee FROM insider_trades GROUP BY 1", "promoters director employee",
  lambda t: t.insider_trades.groupBy("filing_date").pivot("category", ["Promoters", "Director", "Employee"]).agg(F.sum("value")).toDF("filing_date", "promoters", "director", "employee"), 2)
G("agg_statement_pivot", "", "SELECT CAST(o_custkey AS VARCHAR) AS symbol, year(o_orderdate) AS fy, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS opm, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS margin, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), sum(o_totalprice) FILTER (o_orderstatus = 'O')) AS used FROM orders GROUP BY 1, 2", "opm margin used",
  lambda t: t.orders.groupBy(F.col("o_custkey").cast("string").alias("symbol"), F.year("o_orderdate").cast("long").alias("fy")).pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice")).toDF("symbol", "fy", "opm", "margin").withColumn("used", F.coalesce("opm", "margin")), 2)
G("agg_isin_span", "", "SELECT l_partkey AS isin, CAST(l_suppkey AS VARCHAR) AS symbol, CAST(min(l_shipdate) AS DATE) AS first_date, CAST(max(l_shipdate) AS DATE) AS last_date, count(*) AS n_obs FROM lineitem GROUP BY 1, 2", "",
  lambda t: t.lineitem.groupBy(F.col("l_partkey").alias("isin"), F.col("l_suppkey").cast("string").alias("symbol")).agg(F.min("l_shipdate").cast("date").alias("first_date"), F.max("l_shipdate").cast("date").alias("last_date"), F.count(F.lit(1)).alias("n_obs")))
G("agg_isin_renames", "", "SELECT l_partkey AS isin, count(DISTINCT l_suppkey) AS n, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS symbols FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1", "",
  lambda t: t.lineitem.groupBy(F.col("l_partkey").alias("isin")).agg(F.count_distinct("l_suppkey").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("symbols")).where("n > 1"))
G("isin_master_union", "", """WITH o AS (SELECT l_partkey AS isin, CAST(max(l_suppkey) AS VARCHAR) AS symbol, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1) SELECT isin, symbol, n, p_partkey IS NOT NULL AS is_active, 'observed' AS source FROM o LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON p_partkey = isin
  UNION ALL SELECT p_partkey, NULL, 0, true, 'listing' FROM part WHERE p_size <= 25 AND p_partkey NOT IN (SELECT isin FROM o)""", "",
  lambda t: (lambda o, a: o.join(a.withColumn("a", F.lit(True)), "isin", "left").select("isin", "symbol", "n", F.coalesce("a", F.lit(False)).alias("is_active"), F.lit("observed").alias("source")).unionByName(
      a.join(o, "isin", "left_anti").select("isin", F.lit(None).cast("string").alias("symbol"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_active"), F.lit("listing").alias("source"))))(
      t.lineitem.where("l_shipdate < timestamp'2000-01-01'").groupBy(F.col("l_partkey").alias("isin")).agg(F.max("l_suppkey").cast("string").alias("symbol"), F.count(F.lit(1)).alias("n")), t.part.where("p_size <= 25").select(F.col("p_partkey").alias("isin"))))
UNI = """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)), bi AS (SELECT symbol, i, close * volume AS tn FROM bars JOIN cal USING (date)),
  universe AS (SELECT rebal_date, symbol, CAST(count(*) AS INTEGER) AS n_days, median(tn) AS med_turnover FROM (SELECT rebal_date, i AS ri FROM month_ends JOIN cal ON date = rebal_date) JOIN bi ON i <= ri AND i > ri - 63 GROUP BY 1, 2 HAVING count(*) >= 10)"""
G("agg_universe_window", "bars month_ends", f"WITH {UNI} SELECT * FROM universe", "med_turnover", lambda t: A.universe_window(t.bars, t.month_ends, least=10))
G("agg_quarter_membership", "bars", "SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS quarter, count(*) AS days FROM bars GROUP BY 1, 2 HAVING count(*) >= 10 AND max(date) >= last_day(quarter + INTERVAL 2 MONTH) - 21", "",
  lambda t: t.bars.groupBy("symbol", F.date_trunc("quarter", "date").cast("date").alias("quarter")).agg(F.count(F.lit(1)).alias("days"), F.max("date").alias("m")).where("days >= 10 AND m >= date_sub(last_day(add_months(quarter, 2)), 21)").drop("m"))
G("agg_delisted_flag", "bars", "SELECT symbol, max(date) AS last_date, max(date) < (SELECT max(date) FROM bars) - 20 AS delisted FROM bars GROUP BY 1", "",
  lambda t: (lambda l: l.crossJoin(F.broadcast(l.agg(F.max("last_date").alias("m")))).select("symbol", "last_date", F.expr("last_date < date_sub(m, 20)").alias("delisted")))(t.bars.groupBy("symbol").agg(F.max("date").alias("last_date"))))
G("agg_sector_returns", "bars sector_map", f"WITH {SEC} SELECT symbol AS sector, date, ret, members FROM sr WHERE members >= 2", "ret", lambda t: sector_returns(t).where("members >= 2").withColumnRenamed("symbol", "sector"))
G("agg_sector_breadth", "bars sector_map", f"WITH {SMA} SELECT sector, date, CASE WHEN count(s200) >= 2 THEN 100 * avg(CASE WHEN s200 IS NOT NULL THEN CAST(close > s200 AS DOUBLE) END) END AS pct FROM a JOIN sector_map USING (symbol) GROUP BY 1, 2", "pct",
  lambda t: S.sma_distance(t.bars).join(t.sector_map, "symbol").groupBy("sector", "date").agg(F.when(F.count("sma200") >= 2, 100 * F.avg(F.when(F.col("sma200").isNotNull(), (F.col("close") > F.col("sma200")).cast("double")))).alias("pct")))
G("agg_sector_momentum_topk", PV, f"WITH {PANEL}, m AS (SELECT rebal_date, sector, round(avg(mom), 10) AS mom FROM panel GROUP BY 1, 2 HAVING count(mom) > 0) SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY rebal_date ORDER BY mom DESC) AS INTEGER) AS rank FROM m) WHERE rank <= 3", "mom",
  lambda t: panel(t).groupBy("rebal_date", "sector").agg(F.round(F.avg("mom"), 10).alias("mom")).where("mom IS NOT NULL").withColumn("rank", F.rank().over(Window.partitionBy("rebal_date").orderBy(F.desc("mom")))).where("rank <= 3"))
D10 = f"WITH {PANEL}, d AS (SELECT *, {DEC('mom')} AS decile FROM panel)"
deciled = lambda t: panel(t).withColumn("decile", qcut_decile("mom", "rebal_date"))
G("agg_decile_returns", PV, f"{D10} SELECT decile, avg(fwd) AS mean_ret, count(fwd) AS n FROM d WHERE decile IS NOT NULL GROUP BY 1", "mean_ret", lambda t: deciled(t).where("decile IS NOT NULL").groupBy("decile").agg(F.avg("fwd").alias("mean_ret"), F.count("fwd").alias("n")))
G("agg_benchmark_ew", PV, f"WITH {PANEL} SELECT rebal_date, avg(fwd) AS ret, count(fwd) AS n FROM panel GROUP BY 1", "ret", lambda t: panel(t).groupBy("rebal_date").agg(F.avg("fwd").alias("ret"), F.count("fwd").alias("n")))
AVGR = lambda c: f"rank() OVER (PARTITION BY rebal_date ORDER BY {c}) + (count(*) OVER (PARTITION BY rebal_date, {c}) - 1) / 2.0"
IC = f"{PANEL}, rk AS (SELECT rebal_date, {AVGR('mom')} AS f, {AVGR('fwd')} AS l FROM panel WHERE mom IS NOT NULL AND fwd IS NOT NULL), ic AS (SELECT rebal_date, corr(f, l) AS ic, count(*) AS n FROM rk GROUP BY 1 HAVING count(*) >= 8)"
G("agg_rank_ic", PV, f"WITH {IC} SELECT * FROM ic", "ic", lambda t: A.rank_ic(panel(t), "mom", "fwd", least=8))
G("agg_ic_tstat_gate", PV, f"""WITH {IC}, h AS (SELECT *, row_number() OVER (ORDER BY rebal_date) <= floor(count(*) OVER () / 2) AS f FROM ic), s AS (SELECT avg(ic) AS mean_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t_stat, avg(CAST(round(ic, 9) > 0 AS DOUBLE)) AS pct_positive, count(ic) AS n_dates, avg(ic) FILTER (f) AS h1, avg(ic) FILTER (NOT f) AS h2 FROM h) SELECT *, CASE WHEN abs(t_stat) >= 3 THEN 'scored' ELSE 'context' END AS verdict FROM s""", "mean_ic t_stat pct_positive h1 h2",
  lambda t: A.ic_summary(A.rank_ic(panel(t), "mom", "fwd", least=8)))
G("agg_decile_spread", PV, f"WITH {PANEL}, p AS (SELECT rebal_date, quantile_cont(mom, 0.9) AS q FROM panel WHERE fwd IS NOT NULL GROUP BY 1) SELECT rebal_date, avg(fwd) FILTER (mom >= q) - avg(fwd) AS spread FROM panel JOIN p USING (rebal_date) WHERE fwd IS NOT NULL GROUP BY 1", "spread",
  lambda t: (lambda p: p.join(F.broadcast(p.groupBy("rebal_date").agg(F.percentile("mom", F.lit(0.9)).alias("q"))), "rebal_date").groupBy("rebal_date").agg((F.avg(F.when(F.col("mom") >= F.col("q"), F.col("fwd"))) - F.avg("fwd")).alias("spread")))(panel(t).where("fwd IS NOT NULL")))
MRET = "mr AS (SELECT symbol, CAST(mon AS DATE) AS date, c / lag(c) OVER (PARTITION BY symbol ORDER BY mon) - 1 AS ret FROM (SELECT symbol, date_trunc('month', date) AS mon, max_by(close, date) AS c FROM bars GROUP BY 1, 2))"
METRICS = lambda keys, src: f"""eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date) AS e FROM {src} WHERE ret IS NOT NULL), dd AS (SELECT *, e / max(e) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS d FROM eq), g AS (SELECT {keys}, count(*) AS months, max_by(e, date) AS z, avg(ret) AS m, stddev_samp(ret) AS s, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS ds, min(d) AS max_dd, avg(CAST(ret > 0 AS DOUBLE)) AS hit_rate FROM dd GROUP BY {keys} HAVING count(*) >= 12),
  metrics AS (SELECT {keys}, months, CASE WHEN z > 0 THEN pow(z, 12.0 / months) - 1 END AS cagr, s * sqrt(12) AS vol, m * sqrt(12) / nullif(s, 0) AS sharpe, m * sqrt(12) / nullif(ds, 0) AS sortino, max_dd, CASE WHEN z > 0 THEN pow(z, 12.0 / months) - 1 END / nullif(abs(max_dd), 0) AS calmar, hit_rate FROM g)"""  # noqa: E731
MC = "cagr vol sharpe sortino max_dd calmar hit_rate"


def monthly(t):
    m = t.bars.groupBy("symbol", F.trunc("date", "MM").alias("date")).agg(F.max_by("close", F.col("date")).alias("c"))
    return m.select("symbol", "date", (F.col("c") / F.lag("c").over(by_symbol()) - 1).alias("ret"))


G("agg_metrics", "bars", f"WITH {MRET}, {METRICS('symbol', 'mr')} SELECT * FROM metrics", MC, lambda t: A.metrics(monthly(t), ["symbol"]), 5)
G("agg_metrics_long", "bars", f"WITH {MRET}, {METRICS('symbol', 'mr')} SELECT symbol AS strategy, metric, value FROM (SELECT symbol, cagr, sharpe, max_dd FROM metrics) UNPIVOT INCLUDE NULLS (value FOR metric IN (cagr, sharpe, max_dd))", "value",
  lambda t: A.metrics(monthly(t), ["symbol"]).unpivot(["symbol"], ["cagr", "sharpe", "max_dd"], "metric", "value").withColumnRenamed("symbol", "strategy"), 5)
ERA = "CASE WHEN year(date) < 1998 THEN '1995-97' WHEN year(date) < 2000 THEN '1998-99' ELSE '2000-01' END"
G("agg_subperiod_metrics", "bars", f"WITH {MRET}, er AS (SELECT *, {ERA} AS era FROM mr), {METRICS('symbol, era', 'er')} SELECT * FROM metrics", MC, lambda t: A.metrics(monthly(t).withColumn("era", F.expr(ERA)), ["symbol", "era"]), 5)
G("agg_regime_split", PV, f"WITH {PANEL}, {BREADTH}, {D10[len(f'WITH {PANEL}, '):]} SELECT pct_above_200dma >= 50 AS healthy, avg(fwd) AS mean_ret, avg(CAST(fwd > 0 AS DOUBLE)) AS hit, count(*) AS n FROM d JOIN breadth ON date = rebal_date WHERE decile = 10 AND fwd IS NOT NULL AND pct_above_200dma IS NOT NULL GROUP BY 1", "mean_ret hit",
  lambda t: (lambda b: deciled(t).where("decile = 10 AND fwd IS NOT NULL").join(b, F.col("rebal_date") == b.date).where("pct_above_200dma IS NOT NULL").groupBy((F.col("pct_above_200dma") >= 50).alias("healthy")).agg(F.avg("fwd").alias("mean_ret"), F.avg((F.col("fwd") > 0).cast("double")).alias("hit"), F.count(F.lit(1)).alias("n")))(A.breadth(t.bars)))
window_sql = lambda horizons: "wr AS (SELECT symbol, date, horizon, ret, end_date FROM (" + " UNION ALL ".join(f"SELECT symbol, date, {h} AS horizon, lead(close, {h}) {W} / close - 1 AS ret, lead(date, {h}) {W} AS end_date FROM bars" for h in horizons) + ") WHERE ret IS NOT NULL)"
WR = window_sql(A.HORIZONS)
WS = """count(*) AS n, avg(ret) AS mean_return, stddev_samp(ret) AS std_return, min(ret) AS min_return, max(ret) AS max_return, quantile_cont(ret, 0.01) AS p01, quantile_cont(ret, 0.05) AS p05, quantile_cont(ret, 0.25) AS p25, quantile_cont(ret, 0.5) AS median_return, quantile_cont(ret, 0.75) AS p75, quantile_cont(ret, 0.95) AS p95, quantile_cont(ret, 0.99) AS p99,
  avg(CAST(ret > 0 AS DOUBLE)) AS p_gt_0, avg(CAST(ret > 0.1 AS DOUBLE)) AS p_gt_10, avg(CAST(ret > 0.25 AS DOUBLE)) AS p_gt_25, avg(CAST(ret < -0.1 AS DOUBLE)) AS p_lt_m10, avg(CAST(ret < -0.25 AS DOUBLE)) AS p_lt_m25"""
WD = "mean_return std_return min_return max_return p01 p05 p25 median_return p75 p95 p99 p_gt_0 p_gt_10 p_gt_25 p_lt_m10 p_lt_m25"
G("agg_window_stats", "bars", f"WITH {WR} SELECT symbol, horizon, {WS} FROM wr GROUP BY 1, 2", WD, lambda t: A.window_stats(A.window_returns(t.bars), "symbol"))
EXTREMES = " UNION ALL ".join(f"SELECT symbol, horizon, '{d}' AS direction, date, end_date, ret, row_number() OVER (PARTITION BY symbol, horizon ORDER BY round(ret, 10) {o}, date) AS k FROM wr" for d, o in (("up", "DESC"), ("down", "ASC")))
G("agg_window_extremes", "bars", f"WITH {window_sql(A.EXTREME_HORIZONS)} SELECT symbol, horizon, direction, date, end_date, ret, CAST(k AS INTEGER) AS rank FROM ({EXTREMES}) WHERE k <= 10", "ret",
  lambda t: A.window_extremes(t.bars, horizons=A.EXTREME_HORIZONS, directions=("up", "down")))
REG = f"{SMA}, rg AS (SELECT symbol, date, CASE WHEN close > s50 AND s50 > s200 THEN 'bull' WHEN close < s50 AND s50 < s200 THEN 'bear' ELSE 'sideways' END AS regime FROM a)"
G("agg_window_regime", "bars", f"WITH {WR}, {REG}, x AS (SELECT wr.*, regime FROM wr JOIN rg USING (symbol, date) UNION ALL SELECT *, 'all' FROM wr) SELECT regime, horizon, {WS} FROM x GROUP BY 1, 2", WD,
  lambda t: A.pooled_window_stats(A.window_returns(S.regime_label(t.bars), keep=("regime",)), "regime"))
G("agg_seasonality", "bars", "WITH m AS (SELECT symbol, year(date) AS y, CAST(month(date) AS INTEGER) AS month, max_by(close, date) / min_by(close, date) - 1 AS r FROM bars GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT symbol, month, count(*) AS n, avg(r) AS mean_return, median(r) AS median_return, stddev_samp(r) AS std_return, avg(CAST(r > 0 AS DOUBLE)) AS p_positive FROM m GROUP BY 1, 2 HAVING count(*) >= 3", "mean_return median_return std_return p_positive",
  lambda t: A.seasonality(t.bars))
G("agg_series_stats", "bars", f"""WITH a AS (SELECT *, close / lag(close) {W} - 1 AS r, max(close) {W[:-1]} ROWS UNBOUNDED PRECEDING) AS pk FROM bars), b AS (SELECT *, close / pk - 1 AS dd, max(CASE WHEN close = pk THEN date END) {W[:-1]} ROWS UNBOUNDED PRECEDING) AS pd FROM a),
  g AS (SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date, min_by(close, date) AS x, max_by(close, date) AS z, stddev_samp(r) * sqrt(252) AS vol, avg(r) * 252 AS m, count(r) AS k, avg(r) AS mu, avg(CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS DOUBLE) END) AS pct_positive, min(dd) AS max_dd, min((round(dd, 12), date, pd)) AS tr FROM b GROUP BY symbol),
  mo AS (SELECT symbol, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS skew, avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 AS kurt FROM b JOIN g USING (symbol) WHERE r IS NOT NULL GROUP BY symbol)
  SELECT symbol, n, first_date, last_date, z / x - 1 AS total_return, pow(z / x, 1 / ((last_date - first_date) / 365.25)) - 1 AS cagr, vol, m / vol AS sharpe, skew, kurt, pct_positive, max_dd, tr[3] AS dd_start, tr[2] AS dd_trough FROM g JOIN mo USING (symbol)""", "total_return cagr vol sharpe skew kurt pct_positive max_dd", lambda t: A.series_stats(t.bars), 5)
G("agg_corr_beta", "bars index_series", f"""WITH r AS (SELECT symbol, date, close / lag(close) {W} - 1 AS r FROM bars), i AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS i FROM index_series), j AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM r JOIN i USING (date) WHERE r IS NOT NULL AND i IS NOT NULL)
  SELECT symbol, corr(r, i) AS corr_all, corr(r, i) FILTER (k <= 63) AS corr_63, covar_samp(r, i) FILTER (k <= 63) / var_samp(i) FILTER (k <= 63) AS beta_63, corr(r, i) FILTER (k <= 252) AS corr_252, covar_samp(r, i) FILTER (k <= 252) / var_samp(i) FILTER (k <= 252) AS beta_252 FROM j GROUP BY symbol""", "corr_all corr_63 beta_63 corr_252 beta_252",
  lambda t: A.corr_beta(t.bars, t.index_series))
BOOK = "bk AS (SELECT symbol FROM bars GROUP BY symbol ORDER BY round(sum(close * volume), 2) DESC, symbol LIMIT 10)"
G("agg_pairwise_corr", "bars", f"WITH {BOOK}, r AS (SELECT symbol, date, close / lag(close) {W} - 1 AS r FROM bars SEMI JOIN bk USING (symbol)), c AS (SELECT x.symbol AS p, y.symbol AS q, corr(x.r, y.r) AS c FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol GROUP BY 1, 2 HAVING count(*) > 10) SELECT avg(c) AS mean_corr, count(*) AS pairs FROM c", "mean_corr",
  lambda t: (lambda k: (lambda r: r.alias("x").join(r.alias("y"), F.expr("x.date = y.date AND x.symbol < y.symbol")).groupBy("x.symbol", "y.symbol").agg(F.corr("x.r", "y.r").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 10").agg(F.avg("c").alias("mean_corr"), F.count(F.lit(1)).alias("pairs")))(
      t.bars.join(F.broadcast(k), "symbol", "left_semi").select("symbol", "date", (F.col("close") / F.lag("close").over(by_symbol()) - 1).alias("r"))))(
      t.bars.groupBy("symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("v")).orderBy(F.round("v", 2).desc(), "symbol").limit(10).select("symbol")))
G("agg_concentration", "bars sector_map", "SELECT sector, sum(close * volume) / (SELECT sum(close * volume) FROM bars) AS share FROM bars JOIN sector_map USING (symbol) GROUP BY 1", "share",
  lambda t: (lambda s: s.crossJoin(F.broadcast(s.agg(F.sum("v").alias("total")))).select("sector", (F.col("v") / F.col("total")).alias("share")))(t.bars.join(t.sector_map, "symbol").groupBy("sector").agg(F.sum(F.col("close") * F.col("volume")).alias("v"))))
G("agg_scorecard", "trades", "SELECT strategy, count(*) AS n, avg(CAST(realized > 0 AS DOUBLE)) AS hit_rate, avg(realized) AS avg_return, avg(realized) FILTER (realized > 0) AS avg_win, avg(realized) FILTER (realized <= 0) AS avg_loss, avg(CAST(outcome = 'target' AS DOUBLE)) AS target, avg(CAST(outcome = 'stop' AS DOUBLE)) AS stopped, avg(CAST(outcome = 'expired' AS DOUBLE)) AS expired FROM trades GROUP BY 1", "hit_rate avg_return avg_win avg_loss target stopped expired",
  lambda t: (lambda r, o: t.trades.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg(r).alias("avg_return"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r <= 0, r)).alias("avg_loss"), *(F.avg((o == k).cast("double")).alias(a) for k, a in (("target", "target"), ("stop", "stopped"), ("expired", "expired")))))(F.col("realized"), F.col("outcome")))
G("agg_portfolio_summary", "trades", "SELECT count(*) FILTER (exit_date >= DATE '2000-01-01') AS open_positions, count(*) FILTER (entry_price < 1000) AS unsized, sum(entry_price) FILTER (exit_date >= DATE '2000-01-01') AS deployed, sum(entry_price * realized) AS unrealized, avg(CAST(realized > 0 AS DOUBLE)) AS win_rate FROM trades", "deployed unrealized win_rate",
  lambda t: (lambda o: t.trades.agg(F.count(F.when(o, 1)).alias("open_positions"), F.count(F.when(F.col("entry_price") < 1000, 1)).alias("unsized"), F.sum(F.when(o, F.col("entry_price"))).alias("deployed"), F.sum(F.col("entry_price") * F.col("realized")).alias("unrealized"), F.avg((F.col("realized") > 0).cast("double")).alias("win_rate")))(F.col("exit_date") >= F.lit("2000-01-01").cast("date")), 2)
G("agg_tag_counts", "", "SELECT event_type AS tag, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1", "share",
  lambda t: (lambda g: g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).select("tag", "n", (F.col("n") / F.col("all")).alias("share")))(t.events.groupBy(F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"))))
G("agg_fill_matrix", "filings", "SELECT quarter, segment, count(*) AS enumerated, count(*) FILTER (status = 'F') AS parsed, 100.0 * count(*) FILTER (status = 'F') / count(*) AS pct FROM filings GROUP BY 1, 2", "pct",
  lambda t: t.filings.groupBy("quarter", "segment").agg(F.count(F.lit(1)).alias("enumerated"), F.count(F.when(F.col("status") == "F", 1)).alias("parsed")).withColumn("pct", F.col("parsed") * 100 / F.col("enumerated")))
G("agg_revision_prevalence", "filings", "SELECT segment, avg(CAST(n > 1 AS DOUBLE)) AS share, count(*) AS keys FROM (SELECT segment, scrip, quarter, count(*) AS n FROM filings GROUP BY 1, 2, 3) GROUP BY 1", "share",
  lambda t: t.filings.groupBy("segment", "scrip", "quarter").agg(F.count(F.lit(1)).alias("n")).groupBy("segment").agg(F.avg((F.col("n") > 1).cast("double")).alias("share"), F.count(F.lit(1)).alias("keys")))
G("agg_subtotal_reconcile", "", "SELECT l_orderkey, any_value(o_totalprice) AS subtotal, sum(l_extendedprice) AS parts, abs(sum(l_extendedprice) - any_value(o_totalprice)) > 0.5 AS excess FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", "subtotal parts",
  lambda t: t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.first("o_totalprice").alias("subtotal"), F.sum("l_extendedprice").alias("parts")).withColumn("excess", F.abs(F.col("parts") - F.col("subtotal")) > 0.5), 2)
G("agg_institutional_availability", "filings", "SELECT quarter, count(*) AS filings, count(DISTINCT CASE WHEN status = 'F' THEN scrip END) AS with_subtotal, 100.0 * count(DISTINCT CASE WHEN status = 'F' THEN scrip END) / count(DISTINCT scrip) AS pct FROM filings GROUP BY 1", "pct",
  lambda t: t.filings.groupBy("quarter").agg(F.count(F.lit(1)).alias("filings"), F.count_distinct(F.when(F.col("status") == "F", F.col("scrip"))).alias("with_subtotal"), F.count_distinct("scrip").alias("s")).withColumn("pct", F.col("with_subtotal") * 100 / F.col("s")).drop("s"))
G("agg_survivor_ratio", "filings", "WITH q AS (SELECT quarter, count(DISTINCT scrip) AS n FROM filings GROUP BY 1) SELECT quarter, n, n / (SELECT max_by(n, quarter) FROM q) AS ratio FROM q", "ratio",
  lambda t: (lambda q: q.crossJoin(F.broadcast(q.agg(F.max_by("n", "quarter").alias("m")))).select("quarter", "n", (F.col("n") / F.col("m")).alias("ratio")))(t.filings.groupBy("quarter").agg(F.count_distinct("scrip").alias("n"))))
G("agg_usable_quarters", "filings", "SELECT count(*) AS quarters FROM (SELECT quarter FROM filings WHERE status = 'F' GROUP BY 1 HAVING count(DISTINCT scrip) >= 200)", "",
  lambda t: t.filings.where("status = 'F'").groupBy("quarter").agg(F.count_distinct("scrip").alias("n")).where("n >= 200").agg(F.count(F.lit(1)).alias("quarters")))
G("agg_statement_depth", "filings", """WITH d AS (SELECT scrip, count(DISTINCT year(quarter)) AS depth FROM filings GROUP BY 1), v AS (SELECT CAST(c_custkey AS VARCHAR) AS scrip, 9 AS depth FROM customer WHERE c_acctbal > 5000)
  SELECT d.scrip AS symbol, greatest(d.depth, coalesce(v.depth, 0)) AS years FROM d LEFT JOIN v ON v.scrip = d.scrip""", "",
  lambda t: statement_years(t.filings.withColumnRenamed("scrip", "symbol"), t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("symbol"), F.lit(9).alias("depth"))))
G("agg_tier_coverage", "filings", "WITH m AS (SELECT scrip, sum(amount) AS a FROM filings GROUP BY 1), r AS (SELECT scrip, row_number() OVER (ORDER BY round(a, 2) DESC, scrip) AS k FROM m) SELECT quarter, count(DISTINCT scrip) FILTER (k <= 100) AS top100, count(DISTINCT scrip) FILTER (k <= 250) AS top250, count(DISTINCT scrip) FILTER (k <= 500) AS top500 FROM filings LEFT JOIN r USING (scrip) GROUP BY 1", "", lambda t: A.tier_coverage(t.filings))
G("agg_fund_scorecard", "bars", f"""WITH l AS (SELECT symbol, max(date) AS last, max_by(close, date) AS z, min(date) AS first, count(*) AS n FROM bars GROUP BY 1),
  y AS (SELECT symbol, max_by(close, b.date) FILTER (b.date <= last - 365) AS a1, max_by(close, b.date) FILTER (b.date <= last - 1095) AS a3, max_by(close, b.date) FILTER (b.date <= last - 1825) AS a5 FROM bars b JOIN l USING (symbol) GROUP BY symbol),
  d AS (SELECT symbol, close / lag(close) {W} - 1 AS r, close / max(close) {W} - 1 AS dd, close / lag(close, 252) {W} - 1 AS r1 FROM bars),
  v AS (SELECT symbol, stddev_samp(r) * sqrt(252) AS ann_vol, min(dd) AS max_dd, avg(CASE WHEN r1 > 0 THEN 1.0 ELSE 0.0 END) AS consistency FROM d GROUP BY 1)
  SELECT symbol, last AS last_date, z AS last_nav, (last - first) / 365.0 AS years, z / a1 - 1 AS cagr_1y, pow(z / a3, 1.0 / 3) - 1 AS cagr_3y, pow(z / a5, 1.0 / 5) - 1 AS cagr_5y, ann_vol, max_dd,
    CASE WHEN ann_vol > 0 THEN (pow(z / a3, 1.0 / 3) - 1 - 0.06) / ann_vol END AS sharpe_3y, consistency FROM l JOIN y USING (symbol) JOIN v USING (symbol) WHERE n >= 252 AND z > 0""",
  "last_nav years cagr_1y cagr_3y cagr_5y ann_vol max_dd sharpe_3y consistency", lambda t: A.fund_scorecard(t.bars), 7)
G("agg_kendall_w", PV, f"""WITH {PANEL}, r AS (SELECT rebal_date, symbol, rank() OVER (PARTITION BY rebal_date ORDER BY mom, symbol) AS r FROM panel WHERE mom IS NOT NULL), m AS (SELECT count(DISTINCT rebal_date) AS m FROM r), s AS (SELECT symbol, sum(r) AS s, count(*) AS c FROM r GROUP BY 1), x AS (SELECT count(*) AS k, var_pop(s / c) * count(*) AS ss FROM s WHERE c >= 5)
  SELECT k, 12 * ss / (pow(k, 3) - k) AS w FROM x""", "w",
  lambda t: panel(t).where("mom IS NOT NULL").withColumn("r", F.rank().over(Window.partitionBy("rebal_date").orderBy("mom", "symbol"))).groupBy("symbol").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("c")).where("c >= 5").agg(F.count(F.lit(1)).alias("k"), (F.var_pop(F.col("s") / F.col("c")) * F.count(F.lit(1))).alias("ss")).select("k", (12 * F.col("ss") / (F.pow("k", F.lit(3)) - F.col("k"))).alias("w")))
HEALTH = {"bars": ("bars", "date"), "orders": ("orders", "CAST(o_orderdate AS DATE)"), "events": ("events", "CAST(ts AS DATE)")}
G("agg_health_freshness", "bars", "WITH c AS (SELECT CAST(unnest(generate_series(DATE '2001-11-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d), w AS (SELECT d FROM c WHERE dayofweek(d) NOT IN (0, 6)) " + " UNION ALL ".join(
    f"""SELECT '{k}' AS source, count(*) AS n, max({c}) AS last_date, CAST(DATE '2002-01-01' - max({c}) AS INTEGER) AS age, CASE WHEN DATE '2002-01-01' - max({c}) <= 5 THEN 'fresh' WHEN DATE '2002-01-01' - max({c}) <= 60 THEN 'late' ELSE 'stale' END AS status,
    (SELECT count(*) FROM w WHERE d NOT IN (SELECT {c} FROM {v})) AS missing_days FROM {v}""" for k, (v, c) in HEALTH.items()), "",
  lambda t: A.freshness({"bars": t.bars.select("date"), "orders": t.orders.select(F.col("o_orderdate").cast("date").alias("date")), "events": t.events.select(F.col("ts").cast("date").alias("date"))}, "2002-01-01", "2001-11-01"))
G("agg_quality_counts", "bars sector_map month_ends", f"""WITH {BREADTH}, p AS (SELECT date, pct_above_200dma AS p, row_number() OVER (ORDER BY date DESC) AS k FROM breadth),
  u AS (SELECT count(DISTINCT symbol) AS n, count(DISTINCT symbol) FILTER (sector IS NOT NULL) AS s FROM bars LEFT JOIN sector_map USING (symbol) WHERE date = (SELECT max(rebal_date) FROM month_ends))
  SELECT (SELECT count(*) FROM bars WHERE close <= 0 OR close IS NULL) AS bad_prices, (SELECT count(*) FROM bars WHERE high < low) AS crossed, u.n AS universe, u.n BETWEEN 400 AND 500 AS universe_ok, u.s / u.n AS sector_coverage,
    CASE WHEN a.p >= 50 THEN 'risk_on' ELSE 'risk_off' END AS regime, (a.p >= 50) IS DISTINCT FROM (coalesce(b.p, a.p) >= 50) AS flipped FROM u, (SELECT p FROM p WHERE k = 1) a LEFT JOIN (SELECT p FROM p WHERE k = 22) b ON true""", "sector_coverage",
  lambda t: A.quality_counts(t.bars, t.bars.join(t.month_ends.agg(F.max("rebal_date").alias("date")), "date").select("symbol").distinct().join(t.sector_map.select("symbol", "sector"), "symbol", "left"), A.breadth(t.bars)))
#: A log of run times: the second of an event's day for its seconds, its value for the cap; one line in seven is broken.
RUNS = "SELECT event_type AS phase, ts, event_id, CASE WHEN event_id % 7 = 0 THEN 'killed' ELSE CAST(user_id % 600 AS VARCHAR) || 's / cap ' || CAST(600 + user_id % 5 * 300 AS VARCHAR) || 's' END AS detail FROM events"
G("agg_phase_headroom", "", rf"""WITH l AS ({RUNS}), p AS (SELECT phase, ts, event_id, CAST(nullif(regexp_extract(detail, '^(\d+)s / cap (\d+)s$', 1), '') AS DOUBLE) AS o, CAST(nullif(regexp_extract(detail, '^(\d+)s / cap (\d+)s$', 2), '') AS DOUBLE) AS c FROM l)
  SELECT phase, max(o) AS observed, max_by(c, (ts, event_id)) AS cap, max(o) > max_by(c, (ts, event_id)) / 3 AS tight FROM p WHERE o IS NOT NULL GROUP BY 1""", "",
  lambda t: A.phase_headroom(t.events.select(
      F.col("event_type").alias("phase"), "ts", "event_id", F.expr("CASE WHEN event_id % 7 = 0 THEN 'killed' ELSE CAST(user_id % 600 AS STRING) || 's / cap ' || CAST(600 + user_id % 5 * 300 AS STRING) || 's' END").alias("detail")), ["ts", "event_id"]))
G("agg_green_streak", "", "SELECT user_id, coalesce(min(k) FILTER (event_type = 'error'), count(*) + 1) - 1 AS streak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY 1", "",
  lambda t: A.leading_run(t.events, F.col("event_type") != "error", [F.desc("ts"), F.desc("event_id")], "user_id"))
G("agg_pillar_ic", PV, f"""WITH {PANEL}, u AS (SELECT 'mom' AS pillar, mom AS s, fwd FROM panel UNION ALL SELECT 'prox', prox, fwd FROM panel UNION ALL SELECT 'turnover', turnover, fwd FROM panel), f AS (SELECT * FROM u WHERE s IS NOT NULL AND fwd IS NOT NULL),
  r AS (SELECT pillar, rank() OVER (PARTITION BY pillar ORDER BY s) + (count(*) OVER (PARTITION BY pillar, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pillar ORDER BY fwd) + (count(*) OVER (PARTITION BY pillar, fwd) - 1) / 2.0 AS b FROM f) SELECT pillar, count(*) AS n, corr(a, b) AS ic FROM r GROUP BY 1""", "ic",
  lambda t: A.pooled_rank_ic(panel(t).unpivot(["fwd"], ["mom", "prox", "turnover"], "pillar", "s"), "s", "fwd", "pillar"))
