"""Queries over composite tables and the event layer."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import by_symbol, clip, round_to
from ..operators import composites as C
from ..operators import series as S
from ..operators import stats as A
from ..operators.asof import asof
from ..sources.scratch import Scratch
from .aggregates import BREADTH, UNI, G
from .joins import ERF, RATIO
from .series import W, panel, PANEL, PV, SMA

FEV = f"""fev AS (SELECT symbol, date AS ex_date, product({RATIO}) AS factor FROM corporate_actions WHERE action_type <> 'DIVIDEND' GROUP BY 1, 2),
  bp AS (SELECT symbol, date, close, lag(close) {W} AS prev_close FROM bars), sev AS (SELECT f.symbol, f.ex_date, f.factor, CASE WHEN b.close IS NULL OR b.prev_close IS NULL THEN 'unverifiable' WHEN abs(ln(b.close / b.prev_close) - ln(f.factor)) < abs(ln(b.close / b.prev_close)) THEN 'applied' ELSE 'skipped' END AS status FROM fev f ASOF LEFT JOIN bp b ON f.symbol = b.symbol AND f.ex_date <= b.date)"""
G("price_split_events", "bars corporate_actions", f"WITH {FEV} SELECT * FROM sev", "factor", lambda t: C.split_events(t.bars, t.corporate_actions))
G("price_split_adjust", "bars corporate_actions", f"WITH {FEV}, a AS (SELECT b.symbol, b.date, any_value(b.close) AS c, any_value(b.volume) AS v, coalesce(product(factor), 1) AS adj_factor FROM bars b LEFT JOIN sev s ON s.symbol = b.symbol AND s.ex_date > b.date AND s.status = 'applied' GROUP BY 1, 2) SELECT symbol, date, adj_factor, c * adj_factor AS close, v / adj_factor AS volume FROM a", "adj_factor close volume",
  lambda t: C.split_adjust(t.bars, t.corporate_actions).select("symbol", "date", "adj_factor", "close", "volume"))
G("price_total_return", "bars corporate_actions", """WITH p AS (SELECT symbol, date AS ex_date, sum(amount) AS amount FROM corporate_actions WHERE action_type = 'DIVIDEND' GROUP BY 1, 2), y AS (SELECT p.symbol, p.ex_date, 1 - least(p.amount / b.close, 0.5) AS f FROM p ASOF JOIN bars b ON p.symbol = b.symbol AND p.ex_date > b.date)
  SELECT b.symbol, b.date, coalesce(product(f), 1) AS tr_factor, any_value(b.close) * coalesce(product(f), 1) AS close_tr FROM bars b LEFT JOIN y ON y.symbol = b.symbol AND y.ex_date > b.date GROUP BY 1, 2""", "tr_factor close_tr", lambda t: C.total_return(t.bars, t.corporate_actions), 4)


def pit_universe(window):
    """Ranks go by the rounded median turnover, the least of liquid names by the exact one."""
    ranked = S.universe_tiers(window.withColumn("_m", round_to(F.col("med_turnover"), 4)), by="_m")
    return ranked.select("rebal_date", "symbol", "n_days", "adv_rank", "top100", (F.col("med_turnover") >= 3e4).cast("int").alias("liquid"))


G("pit_universe", "bars month_ends", f"WITH {UNI}, r AS (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY round(med_turnover, 4) DESC, symbol) AS k FROM universe) SELECT rebal_date, symbol, n_days, CAST(k AS INTEGER) AS adv_rank, CAST(k <= 100 AS INTEGER) AS top100, CAST(med_turnover >= 30000 AS INTEGER) AS liquid FROM r", "",
  lambda t: pit_universe(A.universe_window(t.bars, t.month_ends, least=10)))
TIER = "CASE WHEN k <= 10 THEN 'top10' WHEN k <= 50 THEN 'top50' ELSE 'rest' END"
G("shp_pit_universe", "filings bars month_ends sector_map", f"""WITH {PANEL}, q AS (SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS quarter, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, count(*) AS days FROM bars GROUP BY 1, 2, 3 HAVING count(*) >= 10),
  sp AS (SELECT l_partkey AS isin, CAST(l_suppkey AS VARCHAR) AS symbol, CAST(min(l_shipdate) AS DATE) AS fd, CAST(max(l_shipdate) AS DATE) AS ld FROM lineitem GROUP BY 1, 2),
  kn AS (SELECT q.symbol, q.quarter, max((fd <= quarter_end AND ld >= quarter_end, ld, isin)) AS b FROM q JOIN sp USING (symbol) GROUP BY 1, 2),
  tr AS (SELECT rebal_date, symbol, {TIER} AS tier FROM (SELECT *, row_number() OVER (PARTITION BY rebal_date ORDER BY turnover DESC, symbol) AS k FROM panel)),
  f AS (SELECT scrip AS symbol, quarter, count(*) AS n FROM filings GROUP BY 1, 2), a AS (SELECT q.*, tier FROM q ASOF LEFT JOIN tr ON tr.symbol = q.symbol AND tr.rebal_date <= q.quarter_end)
  SELECT a.symbol, a.quarter, days, b[3] AS isin, CASE WHEN b[1] THEN 'as_of' WHEN b IS NOT NULL THEN 'latest_known' ELSE 'none' END AS isin_basis, coalesce(tier, 'untiered') AS tier, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'revised' ELSE 'filed' END AS status
  FROM a LEFT JOIN kn ON kn.symbol = a.symbol AND kn.quarter = a.quarter LEFT JOIN f ON f.symbol = a.symbol AND f.quarter = a.quarter""", "",
  lambda t: C.filing_universe(
      t.bars.groupBy("symbol", F.date_trunc("quarter", "date").cast("date").alias("quarter")).agg(F.count("*").alias("days")).where("days >= 10").withColumn("quarter_end", F.date_sub(F.add_months("quarter", 3), 1)),
      t.lineitem.groupBy(F.col("l_partkey").alias("isin"), F.col("l_suppkey").cast("string").alias("symbol")).agg(F.min("l_shipdate").cast("date").alias("first_date"), F.max("l_shipdate").cast("date").alias("last_date")),
      panel(t).withColumn("k", F.row_number().over(Window.partitionBy("rebal_date").orderBy(F.desc("turnover"), "symbol"))).select("rebal_date", "symbol", F.expr(TIER).alias("tier")),
      t.filings.select(F.col("scrip").alias("symbol"), "quarter")))
KINDS = [("quarterly_income", "quarterly", 0), ("quarterly_balance", "quarterly", 1), ("quarterly_cashflow", "quarterly", 2), ("annual_income", "annual", 0), ("annual_balance", "annual", 1), ("annual_cashflow", "annual", 2)]


def six_statements(t):
    """Statement headers of six kinds: each quarter is an income, balance and cash-flow statement, its report a day apart, and each year's last the annual ones."""
    q = t.statements.select("symbol", "quarter", "report_date")
    y = q.groupBy("symbol", F.year("quarter").alias("fy")).agg(F.max("report_date").alias("report_date")).select("symbol", "report_date")
    kinds = lambda p: F.inline(F.array(*(F.struct(F.lit(name).alias("statement"), F.lit(period).alias("period_type"), F.date_add("report_date", shift).alias("reported")) for name, period, shift in KINDS if period == p)))
    both = q.select("symbol", kinds("quarterly")).unionByName(y.select("symbol", kinds("annual")))  # each row is read once for its three kinds
    return both.select("statement", "symbol", "period_type", F.col("reported").alias("report_date"))


G("fundamentals_pit", "statements filings", "WITH y AS (SELECT symbol, max(report_date) AS report_date FROM statements GROUP BY symbol, year(quarter)), s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS statement, symbol, '{p}' AS period_type, CAST(report_date + {d} AS DATE) AS report_date FROM {'y' if p == 'annual' else 'statements'}" for n, p, d in KINDS) + """), m AS (SELECT s.*, f.broadcast FROM s ASOF LEFT JOIN filings f ON f.scrip = s.symbol AND f.broadcast >= s.report_date)
  SELECT statement, symbol, period_type, report_date, CASE WHEN broadcast <= report_date + 120 THEN broadcast ELSE CAST(report_date + CASE period_type WHEN 'annual' THEN 60 ELSE 45 END AS DATE) END AS pit_date,
    CASE WHEN broadcast <= report_date + 120 THEN 'filing' ELSE 'lag_estimate' END AS dated_by FROM m""", "", lambda t: C.fundamentals_pit(six_statements(t), t.filings.withColumnRenamed("scrip", "symbol")))
TOP = f"{PANEL}, tk AS (SELECT rebal_date, symbol FROM panel QUALIFY row_number() OVER (PARTITION BY rebal_date ORDER BY turnover DESC, symbol) <= 8), mi AS (SELECT rebal_date, row_number() OVER (ORDER BY rebal_date) AS i, lead(rebal_date) OVER (ORDER BY rebal_date) AS nx FROM month_ends), g AS (SELECT symbol, rebal_date, i, nx, i - row_number() OVER (PARTITION BY symbol ORDER BY i) AS g FROM tk JOIN mi USING (rebal_date)), isl AS (SELECT symbol, min(rebal_date) AS effective_from, list(nx ORDER BY i)[-1] AS effective_to, count(*) AS months FROM g GROUP BY symbol, g)"
top8 = lambda t: S.top_k(panel(t), 8, "rebal_date", by=[F.desc("turnover"), F.col("symbol")]).select("rebal_date", "symbol")
G("membership_islands", PV, f"WITH {TOP} SELECT * FROM isl", "", lambda t: C.membership_islands(top8(t), t.month_ends))
G("filing_revision_chain", "filings", "SELECT filing_id, scrip, quarter, lag(filing_id) OVER w AS is_revision_of, CAST(row_number() OVER w AS INTEGER) AS version, lead(filing_id) OVER w IS NULL AS is_current, sha256(segment || status) AS content_hash FROM filings WINDOW w AS (PARTITION BY scrip, quarter ORDER BY broadcast, filing_id)", "",
  lambda t: C.revision_chain(t.filings.withColumn("c", F.concat("segment", "status")), ["scrip", "quarter"], ["broadcast", "filing_id"], "c").select("filing_id", "scrip", "quarter", "is_revision_of", "version", "is_current", "content_hash"))
#: Scrips whose last filing is before 2000 are not active; members of every quarter; every seventh was tried before.
G("recovery_targets", "filings", """WITH l AS (SELECT CAST(c_custkey AS VARCHAR) AS scrip, coalesce(max(broadcast) >= DATE '2000-01-01', false) AS active FROM customer LEFT JOIN filings ON scrip = CAST(c_custkey AS VARCHAR) GROUP BY 1),
  q AS (SELECT DISTINCT quarter FROM filings WHERE broadcast < DATE '1999-01-01'), m AS (SELECT l.scrip, count(*) AS missing FROM l, q WHERE (l.scrip, q.quarter) NOT IN (SELECT (scrip, quarter) FROM filings) GROUP BY 1), u AS (SELECT scrip, count(*) FILTER (broadcast - quarter <= 60) AS usable FROM filings GROUP BY 1)
  SELECT scrip, missing, coalesce(usable, 0) AS usable, CASE WHEN usable IS NULL THEN 'never_filed' WHEN usable > 0 THEN 'recovered' ELSE 'nothing_usable' END AS outcome FROM l JOIN m USING (scrip) LEFT JOIN u USING (scrip) WHERE NOT active AND CAST(scrip AS INTEGER) % 7 <> 0""", "",
  lambda t: (lambda scrips, quarters: C.recovery_targets(
      scrips.join(t.filings.groupBy("scrip").agg(F.max("broadcast").alias("b")), "scrip", "left").select("scrip", F.coalesce(F.col("b") >= F.lit("2000-01-01").cast("date"), F.lit(False)).alias("active")),
      scrips.crossJoin(F.broadcast(quarters)), t.filings, scrips.where("CAST(scrip AS INT) % 7 = 0"), 60))(  # quarters: a bounded calendar
      t.customer.select(F.col("c_custkey").cast("string").alias("scrip")), t.filings.where("broadcast < date'1999-01-01'").select("quarter").distinct()))
VOTES = f"""{BREADTH}, ir AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM index_series), iv AS (SELECT *, CASE WHEN count(r) OVER (ORDER BY date ROWS 20 PRECEDING) >= 21 THEN stddev_samp(r) OVER (ORDER BY date ROWS 20 PRECEDING) END AS v, CASE WHEN count(close) OVER (ORDER BY date ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS a, close / lag(close, 63) OVER (ORDER BY date) - 1 AS m FROM ir),
  im AS (SELECT *, CASE WHEN count(v) OVER (ORDER BY date ROWS 251 PRECEDING) >= 252 THEN median(v) OVER (ORDER BY date ROWS 251 PRECEDING) END AS md FROM iv), votes AS (SELECT im.date, CAST(coalesce(close > a, false) AS INTEGER) AS trend, CAST(coalesce(v < md, false) AS INTEGER) AS calm, CAST(coalesce(pct_above_200dma >= 50, false) AS INTEGER) AS broad, CAST(coalesce(m > 0, false) AS INTEGER) AS momentum FROM im LEFT JOIN breadth USING (date))"""
G("regime_votes", "bars index_series", f"WITH {VOTES} SELECT *, trend + calm + broad + momentum AS score FROM votes", "", lambda t: C.regime_votes(t.index_series, A.breadth(t.bars)))
#: Nations stand for the global series: (axis, component, series, kind, cap or sign).
SERIES = [
    ("risk", "index", "index", "trend", 0.15), ("risk", "world", "NATION_0", "trend", 0.15), ("risk", "breadth", "breadth", "level", 1.0),
    ("vol", "home", "NATION_1", "pctile", -1.0), ("vol", "world", "NATION_2", "pctile", -1.0), ("fx", "pair", "NATION_3", "trend", -0.05),
    ("fx", "dollar", "NATION_4", "trend", -0.05), ("commodity", "oil", "NATION_5", "trend", -0.20), ("commodity", "copper", "NATION_6", "trend", 0.20),
    ("commodity", "gold", "NATION_7", "trend", -0.20), ("rates", "long", "NATION_8", "trend", -0.15), ("flow", "net", "NATION_9", "pctile", 1.0),
]


def spine_scores(t):
    """Component scores of all axes: trends and trailing percentiles of the stand-in series, and breadth."""
    nations = t.bars.join(t.sector_map.select("symbol", F.col("sector").alias("nation")), "symbol").groupBy(F.upper("nation").alias("symbol"), "date").agg(F.avg("close").alias("close"))
    series = nations.where(F.col("symbol").isin([x for _, _, x, _, _ in SERIES])).unionByName(t.index_series.select(F.lit("index").alias("symbol"), "date", "close"))
    series = Scratch(t.spark).written(series, "series")  # a row per series and market date
    level = A.breadth(t.bars).select(F.lit("risk").alias("axis"), F.lit("breadth").alias("component"), "date", clip((F.col("pct_above_200dma") - 50) * 2, -100, 100).alias("score"))
    found = level
    for cap in sorted({abs(c) for _, _, _, kind, c in SERIES if kind == "trend"}):
        which = [(a, k, x, c) for a, k, x, kind, c in SERIES if kind == "trend" and abs(c) == cap]
        scores = C.trend_score(series.where(F.col("symbol").isin([x for _, _, x, _ in which])), cap)
        names = t.spark.createDataFrame([(a, k, x, 1.0 if c > 0 else -1.0) for a, k, x, c in which], "axis string, component string, symbol string, sign double")
        found = found.unionByName(scores.join(F.broadcast(names), "symbol").select("axis", "component", "date", (F.col("score") * F.col("sign")).alias("score")))
    ranked = [(a, k, x, c) for a, k, x, kind, c in SERIES if kind == "pctile"]
    names = t.spark.createDataFrame(ranked, "axis string, component string, symbol string, sign double")
    pct = S.trailing_percentile(series).where("pctile IS NOT NULL").join(F.broadcast(names), "symbol")
    return found.unionByName(pct.select("axis", "component", "date", ((200 * F.col("pctile") - 100) * F.col("sign")).alias("score")))


def spine_sql():
    trends = " UNION ALL ".join(f"SELECT '{a}/{k}' AS series, date, {'' if c > 0 else '-'}greatest(least(close / m - 1, {abs(c)}), {-abs(c)}) / {abs(c)} * 100 AS score FROM sm WHERE symbol = '{x}' AND m IS NOT NULL" for a, k, x, kind, c in SERIES if kind == "trend")
    ranks = " UNION ALL ".join(f"SELECT '{a}/{k}', date, (200 * p - 100) * {c} FROM sp2 WHERE symbol = '{x}' AND p IS NOT NULL" for a, k, x, kind, c in SERIES if kind == "pctile")
    axes = ", ".join(f"avg(score) FILTER (split_part(series, '/', 1) = '{a}') AS {a}_axis" for a in C.AXES)
    total, weight = (" + ".join(f"{f.format(a=a)} * {w}" for a, w in C.AXES.items()) for f in ("coalesce({a}_axis, 0)", "CAST({a}_axis IS NOT NULL AS INTEGER)"))
    return f"""{BREADTH}, na AS (SELECT upper(sector) AS symbol, date, avg(close) AS close FROM bars JOIN sector_map USING (symbol) GROUP BY 1, 2 UNION ALL SELECT 'index', date, close FROM index_series),
      sm AS (SELECT *, CASE WHEN count(*) OVER w >= 200 THEN avg(close) OVER w END AS m FROM na WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)),
      sp2 AS (SELECT symbol, date, CASE WHEN len(l) >= 252 THEN len(list_filter(l, lambda v: v <= close)) / 252.0 END AS p FROM (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS l FROM na)),
      sc AS ({trends} UNION ALL {ranks} UNION ALL SELECT 'risk/breadth', date, greatest(least((pct_above_200dma - 50) * 2, 100), -100) FROM breadth WHERE pct_above_200dma IS NOT NULL),
      gr AS (SELECT date, series FROM index_series, (SELECT DISTINCT series FROM sc)), al AS (SELECT gr.date, gr.series, score FROM gr ASOF LEFT JOIN sc ON gr.series = sc.series AND sc.date <= gr.date),
      ax AS (SELECT date, {axes} FROM al GROUP BY 1), rs AS (SELECT *, greatest(0, least(100, (({total}) / nullif({weight}, 0) + 100) / 2)) AS regime_score FROM ax)
      SELECT *, CASE WHEN regime_score <= 40 THEN 'risk_off' WHEN regime_score <= 60 THEN 'neutral' ELSE 'risk_on' END AS label FROM rs WHERE risk_axis IS NOT NULL AND regime_score IS NOT NULL"""


G("market_regime_spine", "bars index_series sector_map", f"WITH {spine_sql()}", " ".join(f"{a}_axis" for a in C.AXES) + " regime_score", lambda t: C.regime_spine(spine_scores(t), t.index_series.select("date")), 4)
G("options_max_pain", "option_chain", """WITH n AS (SELECT date, symbol, min(expiry) AS expiry FROM option_chain GROUP BY 1, 2), c AS (SELECT date, symbol, strike, sum(CASE WHEN option_typ = 'CE' THEN open_int ELSE 0 END) AS ce, sum(CASE WHEN option_typ = 'PE' THEN open_int ELSE 0 END) AS pe FROM option_chain JOIN n USING (date, symbol, expiry) GROUP BY 1, 2, 3),
  p AS (SELECT a.date, a.symbol, a.strike, round(sum(b.ce * greatest(0, a.strike - b.strike) + b.pe * greatest(0, b.strike - a.strike)), 6) AS pain FROM c a JOIN c b ON a.date = b.date AND a.symbol = b.symbol GROUP BY 1, 2, 3) SELECT date, symbol, min((pain, strike))[2] AS max_pain, count(*) AS strikes FROM p GROUP BY 1, 2 HAVING count(*) >= 3""", "max_pain", lambda t: C.max_pain(t.option_chain))
CDF = lambda e: "(0.5 * (1 + sign(Z) * (1 - ((((1.061405429 / (1 + 0.3275911 * abs(Z)) - 1.453152027) / (1 + 0.3275911 * abs(Z)) + 1.421413741) / (1 + 0.3275911 * abs(Z)) - 0.284496736) / (1 + 0.3275911 * abs(Z)) + 0.254829592) / (1 + 0.3275911 * abs(Z)) * exp(-Z * Z))))".replace("Z", f"(({e}) / sqrt(2))")
PDF = "(exp(-d1 * d1 / 2) / sqrt(2 * pi()))"
GREEK = f"""sp AS (SELECT last_day(date) AS date, symbol, max_by(close, date) / 1000 AS spot FROM bars GROUP BY 1, 2), j AS (SELECT o.*, spot, greatest((expiry - date) / 365.0, 0.0001) AS t FROM option_chain o JOIN sp USING (date, symbol)), d AS (SELECT *, (ln(spot / strike) + (0.065 - 0.012 + 0.02) * t) / (0.2 * sqrt(t)) AS d1 FROM j), e AS (SELECT *, d1 - 0.2 * sqrt(t) AS d2 FROM d),
  gk AS (SELECT date, symbol, expiry, strike, option_typ, CASE WHEN option_typ = 'CE' THEN exp(-0.012 * t) * {CDF('d1')} ELSE -exp(-0.012 * t) * {CDF('-d1')} END AS delta, exp(-0.012 * t) * {PDF} / (spot * 0.2 * sqrt(t)) AS gamma, spot * exp(-0.012 * t) * {PDF} * sqrt(t) / 100 AS vega,
  CASE WHEN option_typ = 'CE' THEN strike * t * exp(-0.065 * t) * {CDF('d2')} ELSE -strike * t * exp(-0.065 * t) * {CDF('-d2')} END / 100 AS rho, (-exp(-0.012 * t) * spot * {PDF} * 0.2 / (2 * sqrt(t)) + CASE WHEN option_typ = 'CE' THEN -0.065 * strike * exp(-0.065 * t) * {CDF('d2')} + 0.012 * spot * exp(-0.012 * t) * {CDF('d1')} ELSE 0.065 * strike * exp(-0.065 * t) * {CDF('-d2')} - 0.012 * spot * exp(-0.012 * t) * {CDF('-d1')} END) / 365 AS theta, exp(-0.012 * t) * {PDF} / (spot * 0.2 * sqrt(t)) * spot * open_int AS gex FROM e)"""
spot = lambda t: t.bars.groupBy(F.last_day("date").alias("d"), "symbol").agg((F.max_by("close", "date") / 1000).alias("spot")).withColumnRenamed("d", "date")
G("fn_black_scholes_greeks", "bars option_chain", f"WITH {GREEK} SELECT * EXCLUDE (gex) FROM gk", "strike delta gamma vega rho theta", lambda t: C.greeks(t.option_chain, spot(t)).drop("gex"), 5)
G("fn_gex", "bars option_chain", f"WITH {GREEK} SELECT date, symbol, expiry, strike, option_typ, gex FROM gk", "strike gex", lambda t: C.greeks(t.option_chain, spot(t)).select("date", "symbol", "expiry", "strike", "option_typ", "gex"), 5)
G("greeks_gex_daily", "bars option_chain", f"WITH {GREEK} SELECT date, symbol, sum(CASE WHEN option_typ = 'CE' THEN gex ELSE -gex END) AS net_gex FROM gk GROUP BY 1, 2", "net_gex", lambda t: C.greeks(t.option_chain, spot(t)).groupBy("date", "symbol").agg(F.sum(F.when(F.col("option_typ") == "CE", F.col("gex")).otherwise(-F.col("gex"))).alias("net_gex")), 4)
ATM = """sp AS (SELECT last_day(date) AS date, symbol, max_by(close, date) / 100 AS spot FROM bars GROUP BY 1, 2), ne AS (SELECT date, symbol, min(expiry) AS expiry FROM option_chain GROUP BY 1, 2),
  atm AS (SELECT o.date, o.symbol, any_value(spot) AS spot, any_value(o.expiry) AS expiry, min_by(close, (abs(strike - spot), strike)) FILTER (option_typ = 'CE') AS ce, min_by(close, (abs(strike - spot), strike)) FILTER (option_typ = 'PE') AS pe,
    coalesce(sum(open_int) FILTER (option_typ = 'PE'), 0) / nullif(coalesce(sum(open_int) FILTER (option_typ = 'CE'), 0), 0) AS pcr_oi FROM option_chain o JOIN ne USING (date, symbol, expiry) JOIN sp USING (date, symbol) GROUP BY 1, 2),
  im AS (SELECT *, sqrt(2 * pi() / ((expiry - date) / 365.0)) * 100 / spot AS f FROM atm), iw AS (SELECT symbol, date, CASE WHEN ce IS NOT NULL THEN least(ce * f, 200) END AS iv_ce, CASE WHEN pe IS NOT NULL THEN least(pe * f, 200) END AS iv_pe, pcr_oi FROM im),
  iv AS (SELECT symbol, date, iv_ce, iv_pe, (coalesce(iv_ce, iv_pe) + coalesce(iv_pe, iv_ce)) / 2 AS iv, pcr_oi FROM iw WHERE coalesce(iv_ce, iv_pe) IS NOT NULL)"""
scaled_spot = lambda t: t.bars.groupBy(F.last_day("date").alias("d"), "symbol").agg((F.max_by("close", "date") / 100).alias("spot")).withColumnRenamed("d", "date")
atm_iv = lambda t: C.atm_volatility(t.option_chain, scaled_spot(t))
G("fn_atm_iv", "bars option_chain", f"WITH {ATM} SELECT symbol, date, iv_ce, iv_pe, iv FROM iv", "iv_ce iv_pe iv", lambda t: atm_iv(t).drop("pcr_oi"), 4)
G("options_iv_history", "bars option_chain", f"""WITH {ATM}, ih AS (SELECT *, list(round(iv, 8)) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS l FROM iv)
  SELECT symbol, date, iv_ce, iv_pe, iv, pcr_oi, (round(iv, 8) - list_min(l)) / nullif(list_max(l) - list_min(l), 0) * 100 AS iv_rank, len(list_filter(l, lambda v: v <= round(iv, 8))) * 100.0 / len(l) AS iv_percentile FROM ih""",
  "iv_ce iv_pe iv pcr_oi iv_rank iv_percentile", lambda t: C.volatility_history(atm_iv(t).withColumn("iv", F.round("iv", 8))), 4)
G("option_chain_slice", "option_chain", "SELECT symbol, strike, option_typ, expiry, open_int FROM option_chain WHERE date = DATE '1998-06-30' AND option_typ IN ('CE', 'PE') AND symbol = '1'", "strike open_int", lambda t: t.option_chain.where("date = date'1998-06-30' AND option_typ IN ('CE', 'PE') AND symbol = '1'").orderBy("strike").select("symbol", "strike", "option_typ", "expiry", "open_int"))

# events
G("event_insider_clusters", "insider_trades", """WITH b AS (SELECT symbol, filing_date, name, value FROM insider_trades WHERE transaction_type = 'Buy' AND category LIKE 'Promoter%' AND value >= 30000000), n AS (SELECT x.symbol, x.filing_date, count(DISTINCT y.name) AS n FROM (SELECT DISTINCT symbol, filing_date FROM b) x JOIN b y ON x.symbol = y.symbol AND y.filing_date <= x.filing_date AND y.filing_date >= x.filing_date - 7 GROUP BY 1, 2),
  d AS (SELECT n.symbol, n.filing_date, n.n, v.value FROM n JOIN (SELECT symbol, filing_date, sum(value) AS value FROM b GROUP BY 1, 2) v USING (symbol, filing_date) WHERE n.n >= 2),
  f AS (SELECT symbol, min(filing_date) AS event_date FROM d GROUP BY 1 UNION ALL SELECT f.symbol, (SELECT min(filing_date) FROM d WHERE d.symbol = f.symbol AND d.filing_date > f.event_date + 7) FROM f WHERE f.event_date IS NOT NULL)
  SELECT f.symbol, event_date, CAST(n AS INTEGER) AS insiders, value / 1e7 AS value_cr FROM f JOIN d ON d.symbol = f.symbol AND d.filing_date = f.event_date""", "value_cr",
  lambda t: C.cluster_events(t.insider_trades.where("transaction_type = 'Buy' AND category LIKE 'Promoter%' AND value >= 30000000"), days=7))
G("event_pead_proxy", "statements", """WITH g AS (SELECT symbol, quarter, pit_date, revenue / lag(revenue, 4) OVER (PARTITION BY symbol ORDER BY quarter) - 1 AS growth FROM statements), f AS (SELECT * FROM g WHERE growth IS NOT NULL), s AS (SELECT quarter, median(growth) AS m, stddev_samp(growth) AS s FROM f GROUP BY 1)
  SELECT symbol, pit_date AS event_date, greatest(least((growth - m) / CASE WHEN s IS NULL OR s = 0 THEN 1 ELSE s END, 3), -3) AS surprise,
    100 * (rank() OVER (PARTITION BY quarter ORDER BY growth) + (count(*) OVER (PARTITION BY quarter, growth) - 1) / 2.0) / count(*) OVER (PARTITION BY quarter) AS pct FROM f JOIN s USING (quarter)""", "surprise pct",
  lambda t: S.z_by_group(t.statements.withColumn("growth", F.col("revenue") / F.lag("revenue", 4).over(by_symbol(order="quarter")) - 1).where("growth IS NOT NULL"), "growth", "quarter").select("symbol", F.col("pit_date").alias("event_date"), F.col("z").alias("surprise"), "pct"))
G("event_buyback", "", "SELECT event_id, user_id, ts FROM events WHERE event_type LIKE '%purch%' AND value > 50", "", lambda t: t.events.where("event_type LIKE '%purch%' AND value > 50").select("event_id", "user_id", "ts"))
G("event_index_inclusion", PV, f"WITH {TOP} SELECT symbol, effective_from AS event_date FROM isl WHERE effective_from > DATE '1996-01-31'", "", lambda t: C.membership_islands(top8(t), t.month_ends).where("effective_from > date'1996-01-31'").select("symbol", F.col("effective_from").alias("event_date")))
EVS = f"""l AS (SELECT symbol, date, lead(close, 21) {W} / close - 1 AS fwd, lead(close, 63) {W} / close - 1 AS fwd63 FROM bars), ix AS (SELECT date, lead(close, 21) OVER (ORDER BY date) / close - 1 AS bench FROM index_series), ev AS (SELECT a.symbol, a.event_date, l.date AS entry_date, l.fwd, l.fwd63 FROM (SELECT DISTINCT symbol, date AS event_date FROM corporate_actions) a ASOF JOIN l ON a.symbol = l.symbol AND a.event_date < l.date), ab AS (SELECT ev.symbol, ev.event_date, fwd - bench AS abnormal FROM ev ASOF JOIN ix ON ev.entry_date <= ix.date WHERE fwd IS NOT NULL AND bench IS NOT NULL)"""


def abnormal(t):
    ev = asof(t.corporate_actions.select("symbol", F.col("date").alias("event_date")).distinct(), S.forward_labels(t.bars, {"fwd": 21}).select("symbol", "date", "fwd"), ["symbol"], "event_date", "date", ["fwd"], forward=True, strict=True)
    ix = t.index_series.select("date", (F.lead("close", 21).over(Window.orderBy("date")) / F.col("close") - 1).alias("bench"), F.lit(0).alias("k"))
    j = asof(ev.withColumnRenamed("matched_on", "entry_date").where("entry_date IS NOT NULL").withColumn("k", F.lit(0)), ix, ["k"], "entry_date", "date", ["bench"], forward=True)
    return j.where("fwd IS NOT NULL AND bench IS NOT NULL").select("symbol", "event_date", (F.col("fwd") - F.col("bench")).alias("abnormal"))


G("event_study_abnormal", "bars index_series corporate_actions", f"WITH {EVS} SELECT * FROM ab", "abnormal", abnormal)
G("agg_event_study", "bars index_series corporate_actions", f"WITH {EVS}, m AS (SELECT quantile_disc(event_date, 0.5) AS mid FROM ab) SELECT count(*) AS n, avg(abnormal) AS mean, avg(abnormal) / (stddev_samp(abnormal) / sqrt(count(*))) AS t_stat, avg(CAST(abnormal > 0 AS DOUBLE)) AS hit, avg(abnormal) FILTER (event_date < (SELECT mid FROM m)) AS h1, avg(abnormal) FILTER (event_date >= (SELECT mid FROM m)) AS h2 FROM ab", "mean t_stat hit h1 h2",
  lambda t: C.event_study(abnormal(t)))
