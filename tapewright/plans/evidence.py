"""Queries over membership between snapshots, the sector engine, market intelligence, registered claims and shadow events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import composites as C
from ..operators import evidence as E
from ..operators import market as M
from ..operators import membership as I
from ..operators import series as S
from ..sources.fixtures import Tables
from .aggregates import UNI, G
from .composites import TOP, top8
from .series import PANEL, PCT, PV, SMA, W, panel
from .strategies import universe

# membership: the data end with 1996, and the log says what became of the eight most traded names since
END = "1996-12-31"
ISLANDS = f"{TOP}, de AS (SELECT max(rebal_date) AS e FROM month_ends WHERE rebal_date <= DATE '{END}'), co AS (SELECT max(rebal_date) AS z FROM month_ends)"


def bridge(t: Tables) -> DataFrame:
    top, months = top8(t), t.month_ends
    known = C.membership_islands(top.where(F.col("rebal_date") <= END), months.where(F.col("rebal_date") <= END)).withColumn("confidence", F.lit(1.0))
    later = C.membership_islands(top, months)
    log = later.select("symbol", F.col("effective_from").alias("date"), F.lit("add").alias("change")).unionByName(
        later.where("effective_to IS NOT NULL").select("symbol", F.col("effective_to").alias("date"), F.lit("remove").alias("change")))
    ends = months.agg(F.max(F.when(F.col("rebal_date") <= END, F.col("rebal_date"))).cast("string"), F.max("rebal_date").cast("string")).first()  # two dates
    return I.bridged(known, log, *ends)


G("membership_bridge", PV, f"""WITH {ISLANDS}, ol AS (SELECT symbol, effective_from, CASE WHEN effective_to <= e THEN effective_to END AS shut, e, z FROM isl, de, co WHERE effective_from <= e),
  rm AS (SELECT symbol, effective_to AS d FROM isl WHERE effective_to IS NOT NULL), ad AS (SELECT symbol, effective_from AS d FROM isl, de WHERE effective_from > e),
  b AS (SELECT symbol, effective_from, shut, z, 1.0::DOUBLE AS c, 'snapshot' AS k, (SELECT min(d) FROM rm WHERE rm.symbol = ol.symbol AND rm.d > ol.e) AS gone FROM ol
    UNION ALL SELECT symbol, d, NULL, z, 0.95::DOUBLE, 'change_log', (SELECT min(d) FROM rm WHERE rm.symbol = ad.symbol AND rm.d > ad.d) FROM ad, co)
  SELECT symbol, effective_from, coalesce(shut, gone, z) AS effective_to, CASE WHEN k = 'snapshot' AND shut IS NULL AND gone IS NULL THEN 'snapshot_bridged' ELSE k END AS method,
    CAST(CASE WHEN shut IS NULL AND gone IS NULL THEN least(c, 0.95) ELSE c END AS DOUBLE) AS confidence FROM b WHERE effective_from < coalesce(shut, gone, z)""", "confidence", bridge)

#: Segments: so many names of the highest median turnover. They are rebuilt from the month before the last; official is the last month.
SEGMENTS = (4, 8, 16, 32)


def segments(t: Tables) -> DataFrame:
    """(rebal_date, symbol, segment) of the most traded names."""
    sizes = F.filter(F.array(*map(F.lit, SEGMENTS)), lambda n: n >= F.col("adv_rank"))
    return universe(t).where(F.col("adv_rank") <= max(SEGMENTS)).select("rebal_date", "symbol", F.explode(sizes).alias("segment"))


def measured(t: Tables) -> DataFrame:
    every = segments(t)
    last = t.month_ends.select("rebal_date", F.row_number().over(Window.orderBy(F.desc("rebal_date"))).alias("_r"))  # the calendar
    at = lambda n: every.join(F.broadcast(last.where(F.col("_r") == n).select("rebal_date")), "rebal_date").select("segment", "symbol")
    members = every.withColumn("symbol", F.concat_ws(":", "segment", "symbol"))
    spans = C.membership_islands(members.select("rebal_date", "symbol"), t.month_ends)
    named = F.split("symbol", ":")
    spans = spans.select(named[0].cast("int").alias("segment"), named[1].alias("symbol"), "effective_from", "effective_to", "months", F.lit(None).alias("confidence"))
    return I.consumable(spans, at(2), at(1), least=0.75)


G("membership_consumable", "bars month_ends", f"""WITH {UNI}, rk AS (SELECT rebal_date, symbol, row_number() OVER (PARTITION BY rebal_date ORDER BY round(med_turnover, 4) DESC, symbol) AS k FROM universe),
  sg AS (SELECT rebal_date, symbol, segment FROM rk, (VALUES {', '.join(f'({n})' for n in SEGMENTS)}) v(segment) WHERE k <= segment),
  mi AS (SELECT rebal_date, row_number() OVER (ORDER BY rebal_date) AS i, row_number() OVER (ORDER BY rebal_date DESC) AS r, lead(rebal_date) OVER (ORDER BY rebal_date) AS nx FROM month_ends),
  g AS (SELECT segment, symbol, rebal_date, i, nx, i - row_number() OVER (PARTITION BY segment, symbol ORDER BY i) AS g FROM sg JOIN mi USING (rebal_date)),
  isl AS (SELECT segment, symbol, min(rebal_date) AS effective_from, list(nx ORDER BY i)[-1] AS effective_to, count(*) AS months FROM g GROUP BY segment, symbol, g),
  nw AS (SELECT segment, symbol FROM sg JOIN mi USING (rebal_date) WHERE r = 1), ol AS (SELECT segment, symbol FROM sg JOIN mi USING (rebal_date) WHERE r = 2),
  cf AS (SELECT segment, round(count(ol.symbol) / CAST(count(*) AS DOUBLE), 2) AS confidence FROM nw LEFT JOIN ol USING (segment, symbol) GROUP BY 1)
  SELECT isl.segment, symbol, effective_from, effective_to, months, confidence FROM isl JOIN cf USING (segment) WHERE confidence >= 0.75""", "confidence", measured)

# the sector engine; a nation has few names
ENGINE = f"""{SMA}, lg AS (SELECT sector FROM sector_map GROUP BY 1 HAVING count(DISTINCT symbol) >= 2),
  dy AS (SELECT sector, date, avg(r) AS ret, count(r) AS members, 100 * avg(CAST(coalesce(close > s200, false) AS DOUBLE)) AS above
    FROM (SELECT a.*, close / lag(close) {W} - 1 AS r FROM a) JOIN sector_map USING (symbol) JOIN lg USING (sector) GROUP BY 1, 2),
  le AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (PARTITION BY sector ORDER BY date) AS level FROM dy),
  ix AS (SELECT date, close / lag(close, 63) OVER (ORDER BY date) - 1 AS ir FROM index_series),
  r1 AS (SELECT le.*, level / lag(level, 63) OVER (PARTITION BY sector ORDER BY date) - 1 - ir AS rs FROM le LEFT JOIN ix USING (date)),
  r2 AS (SELECT *, rs - lag(rs, 21) OVER (PARTITION BY sector ORDER BY date) AS rs_mom FROM r1),
  en AS (SELECT sector, date, rs, rs_mom, CAST(rank() OVER (PARTITION BY date ORDER BY rs DESC) + floor((count(*) OVER (PARTITION BY date, rs) - 1) / 2.0) AS INTEGER) AS rank, 100 * {PCT('rs', 'date')} AS score,
    CASE WHEN rs_mom > 0 THEN CASE WHEN rs > 0 THEN 'leading' ELSE 'improving' END WHEN rs_mom <= 0 THEN CASE WHEN rs > 0 THEN 'weakening' ELSE 'lagging' END END AS quadrant,
    CASE WHEN members >= 2 THEN above END AS breadth, members FROM r2 WHERE rs IS NOT NULL AND date >= DATE '1993-01-01')"""


def engine(t: Tables) -> DataFrame:
    return M.sector_engine(t.bars, t.sector_map, t.index_series, least=2, start="1993-01-01")


SECTORS = "bars sector_map index_series"
G("sector_regime_daily", SECTORS, f"WITH {ENGINE} SELECT * FROM en", "rs rs_mom score breadth", engine, 4)
G("rrg_quadrant", SECTORS, f"WITH {ENGINE} SELECT sector, date, quadrant FROM en WHERE quadrant IS NOT NULL", "", lambda t: engine(t).where("quadrant IS NOT NULL").select("sector", "date", "quadrant"))
G("sector_gap_tag", PV, f"""WITH {PANEL}, l AS (SELECT DISTINCT symbol FROM (SELECT symbol, row_number() OVER (PARTITION BY rebal_date ORDER BY turnover DESC, symbol) AS k FROM panel) WHERE k <= 50),
  m AS (SELECT symbol FROM sector_map WHERE sector NOT LIKE '%_1%') SELECT symbol, CASE WHEN CAST(symbol AS INTEGER) % 5 = 0 THEN 'ETF' ELSE 'UNKNOWN' END AS tag FROM l WHERE symbol NOT IN (SELECT symbol FROM m)""", "",
  lambda t: sector_gaps(S.top_k(panel(t), 50, "rebal_date", by=[F.desc("turnover"), F.col("symbol")]), t.sector_map.where("sector NOT LIKE '%_1%'"), t.sector_map.where("CAST(symbol AS INT) % 5 = 0")))


def sector_gaps(universe: DataFrame, sectors: DataFrame, funds: DataFrame) -> DataFrame:
    """(symbol, tag): the names of a universe that no sector is known of, tagged as known funds or as unknown."""
    missing = universe.select("symbol").distinct().join(sectors.select("symbol"), "symbol", "left_anti")
    known = funds.select("symbol", F.lit("ETF").alias("_tag")).distinct()
    return missing.join(known, "symbol", "left").select("symbol", F.coalesce("_tag", F.lit("UNKNOWN")).alias("tag"))


# market intelligence: bought and sold by insiders stand for bulk deals, months of the option chain for its days
def intel(t: Tables) -> DataFrame:
    side = F.when(F.col("transaction_type") == "Buy", F.col("value")).otherwise(-F.col("value"))
    deals = t.insider_trades.where("transaction_type IN ('Buy', 'Sell')").select("symbol", F.col("filing_date").alias("date"), side.alias("net"))
    w = Window.partitionBy("symbol").orderBy("date")
    held = t.option_chain.groupBy("symbol", "date").agg(F.sum("open_int").alias("oi"), F.avg("close").alias("px"))
    interest = held.select("symbol", "date", "oi", (F.col("oi") - F.lag("oi").over(w)).alias("doi"), (F.col("px") / F.lag("px").over(w) - 1).alias("ret"))
    sides = t.option_chain.groupBy("symbol", "date").agg(*(F.sum(F.when(F.col("option_typ") == k, F.col("open_int"))).alias(k) for k in ("PE", "CE")))
    return M.market_intel(t.insider_trades.where("transaction_type = 'Buy'"), deals, interest, sides.select("symbol", "date", F.try_divide("PE", "CE").alias("pcr")))


QUADRANTS = "CASE WHEN doi > 0 THEN CASE WHEN ret > 0 THEN 'Long buildup (bullish)' ELSE 'Short buildup (bearish)' END WHEN ret > 0 THEN 'Short covering' ELSE 'Long unwinding' END"
G("market_intel", "insider_trades option_chain", f"""WITH bu AS (SELECT symbol, count(DISTINCT name) AS n, sum(greatest(value, 0)) AS v FROM insider_trades WHERE transaction_type = 'Buy'
    AND filing_date >= (SELECT max(filing_date) FROM insider_trades WHERE transaction_type = 'Buy') - 120 GROUP BY 1 HAVING count(DISTINCT name) >= 3),
  dl AS (SELECT * FROM insider_trades WHERE transaction_type IN ('Buy', 'Sell')),
  ne AS (SELECT symbol, sum(CASE WHEN transaction_type = 'Buy' THEN value ELSE -value END) AS net FROM dl WHERE filing_date >= (SELECT max(filing_date) FROM dl) - 30 GROUP BY 1),
  oi AS (SELECT symbol, date, sum(open_int) AS oi, avg(close) AS px, sum(open_int) FILTER (option_typ = 'PE') / nullif(sum(open_int) FILTER (option_typ = 'CE'), 0) AS pcr FROM option_chain GROUP BY 1, 2),
  mv AS (SELECT *, oi - lag(oi) OVER (PARTITION BY symbol ORDER BY date) AS doi, px / lag(px) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM oi),
  ch AS (SELECT *, 100 * doi / nullif(oi - doi, 0) AS change, {QUADRANTS} AS q FROM mv WHERE date = (SELECT max(date) FROM oi)),
  bq AS (SELECT q AS category, symbol, 'OI ' || CAST(CAST(round(change, 0) AS BIGINT) AS VARCHAR) || '%' AS detail, 100 * ret AS value FROM ch WHERE doi IS NOT NULL AND ret IS NOT NULL AND change IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(abs(change), 9) DESC, symbol) <= 6)
  SELECT * FROM (SELECT 'Insider cluster-buy' AS category, symbol, n || ' insiders' AS detail, CAST(v AS DOUBLE) AS value FROM bu ORDER BY n DESC, symbol LIMIT 12)
  UNION ALL SELECT * FROM (SELECT 'Bulk-deal accumulation', symbol, 'net buy', CAST(net AS DOUBLE) FROM ne WHERE net > 0 ORDER BY round(net, 9) DESC, symbol LIMIT 10) UNION ALL SELECT * FROM bq
  UNION ALL SELECT * FROM (SELECT 'High PCR (puts heavy)', symbol, 'PCR', CAST(pcr AS DOUBLE) FROM ch WHERE pcr IS NOT NULL ORDER BY round(pcr, 9) DESC, symbol LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'Low PCR (calls heavy)', symbol, 'PCR', CAST(pcr AS DOUBLE) FROM ch WHERE pcr > 0 ORDER BY round(pcr, 9), symbol LIMIT 5)""", "value", intel, 3)

# registered claims: strategies of the trade log; 4 and 5 are killed, 9 was never registered
CLAIMS = [(str(k), "scored" if k < 4 else "killed" if k in (4, 5) else "context", 0.0, 3.0, 0.0) for k in range(9)]


def claims(t: Tables) -> DataFrame:
    registry = t.spark.createDataFrame(CLAIMS, "signal string, status string, least_mean double, least_t double, least_late double")
    trades = t.trades.withColumnRenamed("strategy", "signal")
    late = F.avg(F.when(F.col("exit_date") >= F.lit("1995-07-01").cast("date"), F.col("realized")))
    results = trades.groupBy("signal").agg(
        F.avg("realized").alias("mean"), (F.avg("realized") / (F.stddev_samp("realized") / F.sqrt(F.count(F.lit(1))))).alias("t_stat"), late.alias("late"))
    weights = trades.where("signal <> '4'").groupBy("signal").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return E.gate_violations(registry, results.where("signal <> '2'"), weights, trades.where("CAST(signal AS INT) % 3 = 0 OR signal = '4'").select("signal"))


G("gate_registry_check", "trades", f"""WITH rg AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{k}')" for s, k, *_ in CLAIMS)}) v(signal, status)),
  re AS (SELECT strategy AS signal, avg(realized) AS mean, avg(realized) / (stddev_samp(realized) / sqrt(count(*))) AS t_stat, avg(realized) FILTER (exit_date >= DATE '1995-07-01') AS late FROM trades WHERE strategy <> '2' GROUP BY 1),
  us AS (SELECT DISTINCT strategy AS signal FROM trades WHERE CAST(strategy AS INTEGER) % 3 = 0 OR strategy = '4'), sc AS (SELECT * FROM rg LEFT JOIN re USING (signal) WHERE status = 'scored')
  SELECT signal, 'scored without registration' AS rule, CAST(NULL AS DOUBLE) AS observed FROM us LEFT JOIN rg USING (signal) WHERE coalesce(status, 'context') NOT IN ('scored', 'killed')
  UNION ALL SELECT signal, 'no result', NULL FROM sc WHERE mean IS NULL UNION ALL SELECT signal, 'mean too low', mean FROM sc WHERE mean <= 0 UNION ALL SELECT signal, 't too low', t_stat FROM sc WHERE t_stat < 3
  UNION ALL SELECT signal, 'later half too low', late FROM sc WHERE late <= 0 UNION ALL SELECT signal, 'killed but weighted', CAST(count(*) AS DOUBLE) FROM trades JOIN rg ON rg.signal = strategy WHERE status = 'killed' AND signal <> '4' GROUP BY 1
  UNION ALL SELECT signal, 'killed but scored', NULL FROM us JOIN rg USING (signal) WHERE status = 'killed'""", "observed", claims, 4)

# filings arrive up to 540 days after the quarter in which they were ordered, by their number
LAGGED = "SELECT CAST(quarter + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, CAST(broadcast + CAST(filing_id % 13 * 45 AS INTEGER) AS DATE) AS broadcast FROM filings"
G("filing_lag_gate", "filings", f"""WITH f AS ({LAGGED}), q AS (SELECT quarter_end, count(*) AS filings, count(*) FILTER (broadcast - quarter_end > 400) AS retro, count(*) FILTER (broadcast - quarter_end <= 400) AS usable FROM f GROUP BY 1),
  g AS (SELECT quarter_end, year(quarter_end) * 4 + quarter(quarter_end) - row_number() OVER (ORDER BY quarter_end) AS r FROM q WHERE usable >= 3),
  w AS (SELECT r FROM g GROUP BY r ORDER BY count(*) DESC, min(quarter_end) LIMIT 1)
  SELECT *, usable >= 3 AS good, quarter_end IN (SELECT quarter_end FROM g JOIN w USING (r)) AS in_window FROM q""", "",
  lambda t: E.filing_lag_gate(t.filings.select(
      F.last_day(F.add_months("quarter", 2)).alias("quarter_end"), F.date_add("broadcast", (F.col("filing_id") % 13 * 45).cast("int")).alias("broadcast")), least=3))

# shadow events: corporate actions
SHADOW = f"""nb AS (SELECT *, lead(close, 21) {W} / close - 1 AS ret_21, lead(close, 63) {W} / close - 1 AS ret_63, lead(close, 126) {W} / close - 1 AS ret_126 FROM bars WHERE close > 0),
  sh AS (SELECT a.symbol, a.event_date, a.event_type, nb.date AS entry_date, ret_21, ret_63, ret_126 FROM (SELECT DISTINCT symbol, date AS event_date, action_type AS event_type FROM corporate_actions) a ASOF JOIN nb ON a.symbol = nb.symbol AND a.event_date < nb.date)"""


def shadows(t: Tables) -> DataFrame:
    return E.shadow_returns(t.corporate_actions.select("symbol", F.col("date").alias("event_date"), F.col("action_type").alias("event_type")), t.bars)


G("event_shadow_returns", "bars corporate_actions", f"WITH {SHADOW} SELECT *, ret_21 IS NOT NULL AS filled_21, ret_63 IS NOT NULL AS filled_63, ret_126 IS NOT NULL AS filled_126 FROM sh", "ret_21 ret_63 ret_126", shadows)
G("agg_event_shadow_board", "bars corporate_actions", f"WITH {SHADOW} SELECT event_type, count(*) AS n, count(ret_63) AS filled, avg(CAST(ret_63 > 0 AS DOUBLE)) AS hit, avg(ret_63) AS mean, count(ret_63) >= 30 AS enough FROM sh GROUP BY 1", "hit mean",
  lambda t: E.shadow_board(shadows(t)))
G("event_pledge_risk", "insider_trades", "SELECT event_id, symbol, filing_date, value / 1e7 AS value_cr FROM insider_trades WHERE transaction_type = 'Pledge' AND value >= 10000000", "value_cr", lambda t: C.pledge_risk(t.insider_trades))
G("event_recency_score", "insider_trades", "SELECT symbol, greatest(0, least(100, max(50 + CASE WHEN transaction_type = 'Buy' THEN 50 ELSE -50 END * (1 - (DATE '2024-01-28' - filing_date) / 20.0)))) AS score, max(CAST(transaction_type = 'Pledge' AS INTEGER)) AS pledge FROM insider_trades WHERE filing_date < DATE '2024-01-28' AND DATE '2024-01-28' - filing_date <= 20 GROUP BY 1", "score",
  lambda t: C.recency_score(t.insider_trades, "2024-01-28", 20))


# fundamentals: figures under names that differ by symbol; a third of the revenue stands for equity, less losses
def raw_statements(t: Tables) -> tuple[DataFrame, DataFrame]:
    odd = F.col("symbol").cast("int") % 2 == 1
    name = lambda a, b: F.when(odd, a).otherwise(b)
    s = t.statements.withColumn("report_date", F.col("quarter"))
    income = F.create_map(
        name("Diluted EPS", "Basic EPS"), F.col("net_income") / F.col("n_orders"), name("Net Income", "Net Income Common Stockholders"), F.col("net_income"),
        name("Total Revenue", "Operating Revenue"), F.col("revenue"))
    equity = F.create_map(name("Stockholders Equity", "Common Stock Equity"), F.col("net_income") - F.col("revenue") / 3)
    return s.select("symbol", "report_date", F.to_json(income).alias("data_json")), s.where("n_orders > 1").select("symbol", "report_date", F.to_json(equity).alias("data_json"))


G("fundamentals_features", "statements", """WITH s AS (SELECT *, CASE WHEN n_orders > 1 THEN net_income - revenue / 3 END AS q FROM statements WHERE CAST(symbol AS INTEGER) % 7 <> 0)
  SELECT symbol, quarter AS report_date, pit_date, net_income / n_orders AS eps, net_income, revenue, q AS total_equity, CASE WHEN q > 0 THEN net_income / q END AS roe FROM s""", "eps net_income revenue total_equity roe",
  lambda t: E.fundamentals_features(*raw_statements(t), t.statements.where("CAST(symbol AS INT) % 7 <> 0").select("symbol", F.col("quarter").alias("report_date"), "pit_date")), 3)


def annual_lines(t: Tables) -> DataFrame:
    """Lines of annual statements, a year ending in March, in December or in a month that no one knows."""
    month = F.element_at(F.array(*map(F.lit, ("Mar", "Dec", "Foo"))), (F.col("symbol").cast("int") % 3 + 1).cast("int"))
    years = t.statements.groupBy("symbol", F.concat(month, F.lit(" "), F.year("quarter").cast("string")).alias("fiscal_year")).agg(
        F.sum("revenue").alias("Sales"), F.sum("net_income").alias("Net Profit"), F.sum("n_orders").cast("double").alias("Orders"), F.max("revenue").alias("Other Income"))
    return years.unpivot(["symbol", "fiscal_year"], ["Sales", "Net Profit", "Orders", "Other Income"], "field", "value")


G("fundamentals_annual_pit", "statements", """WITH y AS (SELECT symbol, ['Mar', 'Dec', 'Foo'][CAST(symbol AS INTEGER) % 3 + 1] || ' ' || year(quarter) AS fiscal_year, sum(revenue) AS a, sum(net_income) AS b, max(revenue) AS c FROM statements GROUP BY 1, 2),
  l AS (SELECT symbol, fiscal_year, 'Sales' AS metric, a AS value FROM y UNION ALL SELECT symbol, fiscal_year, 'Net Profit', b FROM y UNION ALL SELECT symbol, fiscal_year, 'Other Income', c FROM y),
  d AS (SELECT *, CAST(fiscal_year[-4:] || CASE WHEN fiscal_year LIKE 'Dec%' THEN '-12-31' ELSE '-03-31' END AS DATE) AS report_date FROM l)
  SELECT symbol, fiscal_year, report_date, CAST(report_date + 60 AS DATE) AS pit_date, 1 AS pit_estimated, metric, value FROM d""", "value", lambda t: E.annual_pit(annual_lines(t)), 2)


def two_sources(t: Tables) -> DataFrame:
    """Yearly revenue by the orders' totals against the sum of their lines, of which every fifth order's are missing."""
    booked = t.orders.select(F.col("o_custkey").cast("string").alias("symbol"), F.year("o_orderdate").alias("year"), "o_orderkey", F.col("o_totalprice").alias("value"))
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = t.lineitem.where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(line).alias("value"))
    other = booked.drop("value").join(lines, "o_orderkey").groupBy("symbol", "year").agg(F.sum("value").alias("value"))
    return E.validated_depth(booked.groupBy("symbol", "year").agg(F.sum("value").alias("value")), other, least=5)


G("agg_validate_overlap", "", """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  b AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, year(o_orderdate) AS y, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS o FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2),
  c AS (SELECT symbol, count(*) AS depth, max(CAST(coalesce(abs(o) > 1 AND abs(v - o) <= 0.25 * abs(o), false) AS INTEGER)) AS validated FROM a LEFT JOIN b USING (symbol, y) GROUP BY 1)
  SELECT *, depth >= 5 AND validated = 1 AS eligible FROM c""", "", two_sources)
