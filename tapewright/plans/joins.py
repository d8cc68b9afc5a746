"""Queries over projections, lookups, joins and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import PPF_A, PPF_B, PPF_C, PPF_D, PPF_TAIL, by_symbol, norm_cdf, norm_ppf, parse_date, parse_number, parse_ratio
from ..operators import composites as C
from ..operators import lookups as L
from ..operators.asof import align_ffill, asof
from ..operators.books import weight_diff
from ..operators import series as S
from ..sources.scratch import Scratch
from .aggregates import G
from .series import PANEL, PV, W, panel


# projections, filters, lookups
G("filter_dynamic", "bars", "SELECT symbol, date, close FROM bars WHERE symbol IN ('1', '3', '5') AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "close",
  lambda t: L.filtered(t.bars, ["1", "3", "5"], "1997-01-01", "1998-12-31").select("symbol", "date", "close"))
G("last_n_per_key", "bars", "SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 5", "close",
  lambda t: L.last_n(t.bars, 5).select("symbol", "date", "close"))
G("latest_snapshot", "bars", "SELECT symbol, date, close FROM bars WHERE date = (SELECT max(date) FROM bars)", "close",
  lambda t: L.latest_snapshot(t.bars).select("symbol", "date", "close"))
G("latest_price", "bars", "SELECT symbol, max(date) AS date, max_by(close, date) AS close FROM bars GROUP BY 1", "close",
  lambda t: L.latest_price(t.bars))
G("distinct_keys", "", "SELECT DISTINCT event_type FROM events", "", lambda t: t.events.select("event_type").distinct())
G("case_insensitive_lookup", "sector_map", "SELECT symbol, sector FROM sector_map WHERE lower(sector) = lower('nation_3')", "",
  lambda t: t.sector_map.where(L.same_text("sector", "nation_3")).select("symbol", "sector"))
G("pivot_close_matrix", "bars", "SELECT date, max(close) FILTER (symbol = '1') AS s1, max(close) FILTER (symbol = '2') AS s2, max(close) FILTER (symbol = '3') AS s3 FROM bars WHERE symbol IN ('1', '2', '3') GROUP BY 1", "s1 s2 s3",
  lambda t: L.close_matrix(t.bars, ["1", "2", "3"]))
G("two_day_return", "bars", "WITH d AS (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 2) SELECT symbol, max(close) FILTER (date = (SELECT max(date) FROM d)) / max(close) FILTER (date = (SELECT min(date) FROM d)) - 1 AS ret FROM bars WHERE date IN (SELECT date FROM d) GROUP BY 1", "ret",
  lambda t: L.two_day_return(t.bars))
G("events_active_filter", "insider_trades", "SELECT symbol, transaction_type, max(filing_date) AS last_event FROM insider_trades WHERE filing_date < DATE '2024-01-25' AND DATE '2024-01-25' - filing_date <= 10 GROUP BY 1, 2", "",
  lambda t: L.active_events(t.insider_trades, "2024-01-25", 10).groupBy("symbol", "transaction_type").agg(F.max("filing_date").alias("last_event")))
G("search_symbol", "sector_map", "SELECT symbol, company FROM sector_map WHERE upper(company) LIKE '%0007%' OR upper(symbol) LIKE '%7%' ORDER BY symbol LIMIT 20", "",
  lambda t: L.search(t.sector_map, "0007", "7").select("symbol", "company"))
G("etf_exclude", "", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_type, 'ECONOMY|PROMO') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", "",
  lambda t: L.without_funds(t.part, t.lineitem.where("l_quantity > 49").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "p_type", "ECONOMY|PROMO").select("p_partkey"))
G("sector_normalize", "sector_map", "SELECT symbol, CASE lower(trim(sector)) WHEN 'nation_1' THEN 'Financials' WHEN 'nation_2' THEN 'Energy' WHEN 'nation_3' THEN 'Technology' ELSE trim(sector) END AS sector FROM sector_map", "",
  lambda t: L.mapped(t.sector_map, "sector", {"nation_1": "Financials", "nation_2": "Energy", "nation_3": "Technology"}).select("symbol", "sector"))
G("registry_scd_active", "", "WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT coalesce(o.k, n.k) AS custkey, n.k IS NOT NULL AS is_active, o.k IS NULL AS is_new FROM o FULL JOIN n ON o.k = n.k", "",
  lambda t: (lambda o: L.scd_active(o.where("o_orderdate < timestamp'1998-01-01'"), o.where("o_orderdate >= timestamp'1998-01-01'"), "custkey"))(t.orders.withColumnRenamed("o_custkey", "custkey")))
G("fund_filter_plan", "", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Direct' ELSE 'Regular' END AS plan, regexp_replace(p_name, '^\\w+ ', '') AS name FROM part WHERE p_type LIKE '%ECONOMY%' AND p_name NOT LIKE '%ring%'", "",
  lambda t: t.part.where("p_type LIKE '%ECONOMY%' AND p_name NOT LIKE '%ring%'").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "Direct").otherwise("Regular").alias("plan"), F.regexp_replace("p_name", r"^\w+ ", "").alias("name")))
OI = "WITH o AS (SELECT symbol, date, sum(open_int) AS oi, avg(close) AS px FROM option_chain GROUP BY 1, 2), c AS (SELECT symbol, date, oi - lag(oi) OVER w AS d, px - lag(px) OVER w AS r FROM o WINDOW w AS (PARTITION BY symbol ORDER BY date))"
G("fo_intel_quadrant", "option_chain", f"{OI} SELECT symbol, date, CASE WHEN d > 0 AND r > 0 THEN 'long buildup' WHEN d > 0 AND r <= 0 THEN 'short buildup' WHEN d <= 0 AND r > 0 THEN 'short covering' WHEN d <= 0 AND r <= 0 THEN 'long unwinding' END AS quadrant FROM c", "",
  lambda t: L.open_interest_quadrant(t.option_chain))
TAGS = [("junk", r"[#$%&*]{3}"), ("table", r" \| "), ("shout", r"!!"), ("contact", r"\d{3}-\d{4}"), ("license", r"(?i)license|copyright")]
G("announcement_tag", "", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TAGS) + " ELSE 'other' END AS tag, coalesce(nullif(regexp_extract(text, '[#$%&*]{3}'), ''), nullif(regexp_extract(text, '\\d{3}-\\d{4}'), '')) AS hit FROM documents", "",
  lambda t: t.documents.select("doc_id", L.first_tag("text", TAGS).alias("tag"), F.coalesce(*(F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for p in (r"[#$%&*]{3}", r"\d{3}-\d{4}"))).alias("hit")))
SUBJ = "CASE WHEN event_type = 'purchase' THEN 'Face value split 10:' || CAST(user_id % 5 + 1 AS VARCHAR) WHEN event_type = 'click' THEN 'Bonus issue 1:' || CAST(user_id % 3 + 1 AS VARCHAR) ELSE 'Dividend Rs ' || CAST(user_id % 9 + 1 AS VARCHAR) || '.50 per share' END"
G("corp_action_classify", "", f"WITH s AS (SELECT event_id, {SUBJ} AS s FROM events) SELECT event_id, CASE WHEN regexp_matches(s, '(?i)split') THEN 'SPLIT' WHEN regexp_matches(s, '(?i)bonus') THEN 'BONUS' WHEN regexp_matches(s, '(?i)dividend') THEN 'DIVIDEND' END AS action_type, nullif(regexp_extract(s, '(\\d+:\\d+)', 1), '') AS ratio, TRY_CAST(nullif(regexp_extract(s, 'Rs (\\d+\\.\\d+)', 1), '') AS DOUBLE) AS amount FROM s", "amount",
  lambda t: L.classified_actions(t.events.select("event_id", F.expr(SUBJ.replace("VARCHAR", "STRING")).alias("s")), "s").drop("s"))
G("insider_normalize", "insider_trades", "SELECT event_id, CASE WHEN starts_with(lower(category), 'promoter') THEN 'promoter' WHEN lower(category) = 'director' THEN 'kmp' ELSE 'other' END AS category, upper(transaction_type) AS kind FROM insider_trades", "",
  lambda t: L.insider_categories(t.insider_trades).select("event_id", "category", "kind"))
G("thesis_type_map", "trades", "SELECT trade_id, CASE WHEN CAST(strategy AS INTEGER) < 3 THEN 'momentum' WHEN CAST(strategy AS INTEGER) < 6 THEN 'value' ELSE 'quality' END AS thesis, CASE outcome WHEN 'target' THEN 'target_hit' WHEN 'stop' THEN 'stop_hit' ELSE 'time_exit' END AS exit_reason FROM trades", "",
  lambda t: t.trades.select("trade_id", F.expr("CASE WHEN CAST(strategy AS INT) < 3 THEN 'momentum' WHEN CAST(strategy AS INT) < 6 THEN 'value' ELSE 'quality' END").alias("thesis"), F.expr("CASE outcome WHEN 'target' THEN 'target_hit' WHEN 'stop' THEN 'stop_hit' ELSE 'time_exit' END").alias("exit_reason")))

# joins
G("join_left_eq", "bars delivery", "SELECT b.symbol, b.date, close, delivery_percent FROM bars b LEFT JOIN (SELECT * FROM delivery WHERE delivery_qty > 0) d ON b.symbol = d.symbol AND b.date = d.date", "close delivery_percent",
  lambda t: t.bars.join(t.delivery.where("delivery_qty > 0").select("symbol", "date", "delivery_percent"), ["symbol", "date"], "left").select("symbol", "date", "close", "delivery_percent"))
G("join_inner_universe", "bars month_ends sector_map", f"WITH {PANEL}, u AS (SELECT rebal_date, symbol FROM panel WHERE turnover > 50000) SELECT rebal_date, symbol, mom FROM panel JOIN u USING (rebal_date, symbol)", "mom",
  lambda t: (lambda p: p.join(p.where("turnover > 50000").select("rebal_date", "symbol"), ["rebal_date", "symbol"]).select("rebal_date", "symbol", "mom"))(panel(t)))
NEXT = f"{PANEL}, nx AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS next_date FROM month_ends), rz AS (SELECT p.rebal_date, p.symbol, p.sector, p.mom, p.prox, p.turnover, p.close, q.close / p.close - 1 AS realized FROM panel p JOIN nx USING (rebal_date) JOIN panel q ON q.symbol = p.symbol AND q.rebal_date = nx.next_date)"


def realized(t):
    """The panel with the return to the next rebalance date; rows without it drop out.

    Written once to the shared folder: books refer to it several times.
    """
    dates = t.month_ends.withColumn("_i", F.row_number().over(Window.orderBy("rebal_date")))  # a row per month
    w = Window.partitionBy("symbol").orderBy("_i")
    p = panel(t).join(F.broadcast(dates), "rebal_date")
    follows = F.lead("_i").over(w) == F.col("_i") + 1
    p = p.withColumn("realized", F.when(follows, F.lead("close").over(w) / F.col("close") - 1)).where("realized IS NOT NULL")
    return Scratch(t.spark).written(p.drop("_i"), "panel")


G("join_next_rebalance", PV, f"WITH {NEXT} SELECT rebal_date, symbol, realized FROM rz", "realized", lambda t: realized(t).select("rebal_date", "symbol", "realized"))
ASOF = "SELECT b.symbol, b.date, s.quarter, s.revenue FROM bars b ASOF LEFT JOIN statements s ON b.symbol = s.symbol AND b.date >= s.pit_date"
G("asof_backward", "bars statements", ASOF, "revenue", lambda t: asof(t.bars.select("symbol", "date"), t.statements, ["symbol"], "date", "pit_date", ["quarter", "revenue"]).drop("matched_on"), 2)
G("asof_backward_stale", "bars statements", "SELECT b.symbol, b.date, CASE WHEN b.date - s.pit_date <= 100 THEN s.revenue END AS revenue FROM bars b ASOF LEFT JOIN statements s ON b.symbol = s.symbol AND b.date >= s.pit_date", "revenue",
  lambda t: asof(t.bars.select("symbol", "date"), t.statements, ["symbol"], "date", "pit_date", ["revenue"], max_days=100).drop("matched_on"), 2)
G("asof_calendar", "bars index_series month_ends", "SELECT m.rebal_date, i.close FROM (SELECT rebal_date + 3 AS rebal_date FROM month_ends) m ASOF LEFT JOIN index_series i ON m.rebal_date >= i.date", "close",
  lambda t: asof(t.month_ends.selectExpr("date_add(rebal_date, 3) AS rebal_date", "0 AS k"), t.index_series.selectExpr("date", "close", "0 AS k"), ["k"], "rebal_date", "date", ["close"]).select("rebal_date", "close"))
G("asof_align_ffill", "bars index_series month_ends", "SELECT d.date, i.close FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d ASOF LEFT JOIN index_series i ON d.date >= i.date", "close",
  lambda t: align_ffill(t.index_series.select("date", "close"), t.orders.select(F.col("o_orderdate").cast("date").alias("date")).distinct(), "close").select("date", "close"))
G("asof_interval_isin", "", """WITH i AS (SELECT l_suppkey AS s, l_partkey AS isin, min(l_shipdate) AS fd, max(l_shipdate) AS ld FROM lineitem GROUP BY 1, 2) SELECT s AS symbol, isin FROM i QUALIFY row_number() OVER (PARTITION BY s ORDER BY fd <= TIMESTAMP '1998-06-30' AND ld >= TIMESTAMP '1998-06-30' DESC, ld DESC, isin) = 1""", "",
  lambda t: t.lineitem.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_partkey").alias("isin")).agg(F.min("l_shipdate").alias("fd"), F.max("l_shipdate").alias("ld")).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.expr("fd <= timestamp'1998-06-30' AND ld >= timestamp'1998-06-30'").desc(), F.desc("ld"), "isin"))).where("k = 1").select("symbol", "isin"))
G("interval_first_filing", "statements filings", "SELECT s.symbol, s.quarter, min(f.broadcast) AS real_date, coalesce(min(f.broadcast), CAST(s.quarter + 135 AS DATE)) AS pit_date, CASE WHEN min(f.broadcast) IS NULL THEN 'lag' ELSE 'filing' END AS dated_by FROM statements s LEFT JOIN filings f ON f.scrip = s.symbol AND f.broadcast >= s.quarter + 90 AND f.broadcast <= s.quarter + 210 GROUP BY 1, 2", "",
  lambda t: C.first_filing(t.statements, t.filings.withColumnRenamed("scrip", "symbol")))
FB = f"WITH l AS (SELECT symbol, date, close, lead(close, 21) {W} / close - 1 AS fwd FROM bars)"
G("first_bar_after_event", "bars corporate_actions", f"{FB} SELECT a.symbol, a.date AS event_date, a.action_type, l.date AS entry_date, l.fwd FROM (SELECT DISTINCT symbol, date, action_type FROM corporate_actions) a ASOF LEFT JOIN l ON a.symbol = l.symbol AND a.date < l.date", "fwd",
  lambda t: asof(t.corporate_actions.select("symbol", F.col("date").alias("event_date"), "action_type").distinct(), S.forward_labels(t.bars, {"fwd": 21}).select("symbol", "date", "fwd"), ["symbol"], "event_date", "date", ["fwd"], forward=True, strict=True).withColumnRenamed("matched_on", "entry_date"))
WT = f"{PANEL}, w AS (SELECT rebal_date, symbol, 1.0 / count(*) OVER (PARTITION BY rebal_date) AS weight FROM panel WHERE prox > 0.8), nd AS (SELECT rebal_date, lead(rebal_date) OVER (ORDER BY rebal_date) AS nxt FROM (SELECT DISTINCT rebal_date FROM w))"
G("full_outer_weight_diff", PV, f"WITH {WT}, pv AS (SELECT nxt AS rebal_date, symbol, weight AS pw FROM w JOIN nd USING (rebal_date) WHERE nxt IS NOT NULL) SELECT rebal_date, symbol, coalesce(weight, 0) - coalesce(pw, 0) AS delta FROM w FULL JOIN pv USING (rebal_date, symbol)", "delta",
  lambda t: weight_diff(panel(t).where("prox > 0.8").select("rebal_date", "symbol", (1 / F.count("*").over(Window.partitionBy("rebal_date"))).alias("weight"))).select("rebal_date", "symbol", "delta"))
G("gex_net_outer", "option_chain", "SELECT date, symbol, strike, sum(CASE WHEN option_typ = 'CE' THEN open_int ELSE -open_int END) AS net FROM option_chain GROUP BY 1, 2, 3", "strike net",
  lambda t: t.option_chain.groupBy("date", "symbol", "strike").agg(F.sum(F.when(F.col("option_typ") == "CE", F.col("open_int")).otherwise(-F.col("open_int"))).alias("net")))
G("join_fallback_scrip", "", "SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(p_name, 'supplier ' || s_name) AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey", "l_extendedprice",
  lambda t: t.lineitem.join(t.part.where("p_size < 20"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_extendedprice", F.coalesce("p_name", F.concat(F.lit("supplier "), "s_name")).alias("name")))
G("semi_anti", "", "SELECT c_custkey, 'semi' AS side FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey UNION ALL SELECT c_custkey, 'anti' FROM customer ANTI JOIN orders ON c_custkey = o_custkey", "",
  lambda t: (lambda on: t.customer.join(t.orders.where("o_totalprice > 300000"), on, "left_semi").select("c_custkey", F.lit("semi").alias("side")).unionByName(t.customer.join(t.orders, on, "left_anti").select("c_custkey", F.lit("anti").alias("side"))))(F.col("c_custkey") == F.col("o_custkey")))
G("self_overlap_check", "filings", "SELECT scrip, count(*) AS overlaps FROM (SELECT scrip, broadcast + 60 > lead(broadcast) OVER (PARTITION BY scrip ORDER BY broadcast, filing_id) AS o FROM filings) WHERE o GROUP BY 1", "",
  lambda t: t.filings.withColumn("n", F.lead("broadcast").over(Window.partitionBy("scrip").orderBy("broadcast", "filing_id"))).where("date_add(broadcast, 60) > n").groupBy("scrip").agg(F.count("*").alias("overlaps")))
G("cross_source_agree", "statements filings", "WITH f AS (SELECT scrip AS symbol, quarter, sum(amount) AS a FROM filings WHERE status <> 'P' GROUP BY 1, 2) SELECT year(quarter) AS y, avg(CAST(abs(a - revenue) <= 0.01 * revenue AS DOUBLE)) AS agree, count(*) AS n FROM f JOIN statements USING (symbol, quarter) GROUP BY 1", "agree",
  lambda t: t.filings.where("status <> 'P'").groupBy(F.col("scrip").alias("symbol"), "quarter").agg(F.sum("amount").alias("a")).join(t.statements, ["symbol", "quarter"]).groupBy(F.year("quarter").alias("y")).agg(F.avg((F.abs(F.col("a") - F.col("revenue")) <= 0.01 * F.col("revenue")).cast("double")).alias("agree"), F.count("*").alias("n")))
G("correlated_exists", "", "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1", "",
  lambda t: t.orders.join(t.lineitem.where("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n")))
G("correlated_latest", "bars", "SELECT s_suppkey, (SELECT max_by(close, date) FROM bars WHERE symbol = CAST(s_suppkey AS VARCHAR)) AS close FROM supplier", "close",
  lambda t: t.supplier.select("s_suppkey", F.col("s_suppkey").cast("string").alias("symbol")).join(t.bars.groupBy("symbol").agg(F.max_by("close", "date").alias("close")), "symbol", "left").select("s_suppkey", "close"))

# sets
G("set_union_strategies", PV, f"WITH {PANEL} SELECT 'mom' AS strategy, rebal_date, symbol FROM panel WHERE mom > 0.1 UNION ALL SELECT 'high', rebal_date, symbol FROM panel WHERE prox > 0.95", "",
  lambda t: (lambda p: p.where("mom > 0.1").select(F.lit("mom").alias("strategy"), "rebal_date", "symbol").unionByName(p.where("prox > 0.95").select(F.lit("high").alias("strategy"), "rebal_date", "symbol")))(panel(t)))
G("set_union_layouts", "bars", "SELECT symbol, date, close, NULL::DOUBLE AS volume FROM bars WHERE date < DATE '1998-01-01' UNION ALL SELECT symbol, date, close, volume FROM bars WHERE date >= DATE '1998-01-01'", "close volume",
  lambda t: t.bars.where("date < date'1998-01-01'").select("symbol", "date", "close").unionByName(t.bars.where("date >= date'1998-01-01'").select("symbol", "date", "close", "volume"), allowMissingColumns=True))
G("set_except_missing_dates", "bars", "SELECT date FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS date) WHERE dayofweek(date) BETWEEN 1 AND 5 EXCEPT SELECT date FROM bars WHERE symbol = '1'", "",
  lambda t: t.spark.sql("SELECT explode(sequence(date'1996-01-01', date'1996-12-31')) AS date").where("dayofweek(date) BETWEEN 2 AND 6").join(t.bars.where("symbol = '1'"), "date", "left_anti"))
G("set_intersect_calendar", "bars", "SELECT a.date, a.close - b.close AS spread FROM bars a JOIN bars b ON a.date = b.date AND a.symbol = '1' AND b.symbol = '2'", "spread",
  lambda t: (lambda x, y: x.join(y, "date").select("date", (F.col("a") - F.col("b")).alias("spread")))(t.bars.where("symbol = '1'").select("date", F.col("close").alias("a")), t.bars.where("symbol = '2'").select("date", F.col("close").alias("b"))))
G("fn_term_spread", "bars", "SELECT a.date, a.close - b.close AS term_spread FROM bars a JOIN bars b ON a.date = b.date AND a.symbol = '3' AND b.symbol = '4'", "term_spread",
  lambda t: (lambda x, y: x.join(y, "date").select("date", (F.col("a") - F.col("b")).alias("term_spread")))(t.bars.where("symbol = '3'").select("date", F.col("close").alias("a")), t.bars.where("symbol = '4'").select("date", F.col("close").alias("b"))))
G("set_agreement_ratio", PV, f"WITH {PANEL}, a AS (SELECT rebal_date, symbol FROM panel WHERE prox > 0.9), b AS (SELECT rebal_date, symbol FROM panel WHERE mom > 0) SELECT b.rebal_date, avg(CAST(a.symbol IS NOT NULL AS DOUBLE)) AS ratio FROM b LEFT JOIN a USING (rebal_date, symbol) GROUP BY 1", "ratio",
  lambda t: (lambda p: p.where("mom > 0").select("rebal_date", "symbol").join(p.where("prox > 0.9").select("rebal_date", "symbol", F.lit(1).alias("a")), ["rebal_date", "symbol"], "left").groupBy("rebal_date").agg(F.avg(F.col("a").isNotNull().cast("double")).alias("ratio")))(panel(t)))
for key, d in (("set_dedupe_keep_last", "DESC"), ("set_dedupe_keep_first", "ASC")):
    G(key, "", f"SELECT l_suppkey, l_shipdate, l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey {d}, l_linenumber {d}, l_extendedprice {d}) = 1", "l_extendedprice",
      lambda t, d=d: (lambda o: t.lineitem.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey", "l_shipdate").orderBy(*(F.desc(c) if d == "DESC" else F.asc(c) for c in o)))).where("k = 1").select("l_suppkey", "l_shipdate", "l_orderkey", "l_extendedprice"))(["l_orderkey", "l_linenumber", "l_extendedprice"]))

# scalar functions
SP = "CAST(split_part(ratio, ':', {}) AS DOUBLE)"
RATIO = f"CASE action_type WHEN 'SPLIT' THEN {SP.format(2)} / {SP.format(1)} WHEN 'BONUS' THEN {SP.format(2)} / ({SP.format(1)} + {SP.format(2)}) END"
G("fn_parse_ratio", "corporate_actions", f"SELECT symbol, date, action_type, ratio, {RATIO} AS factor FROM corporate_actions", "factor", lambda t: t.corporate_actions.select("symbol", "date", "action_type", "ratio", parse_ratio(F.col("action_type"), F.col("ratio")).alias("factor")))
G("fn_parse_number", "", "SELECT p_partkey, round(p_retailprice, 2) AS v FROM part", "v", lambda t: t.part.select("p_partkey", parse_number(F.concat(F.lit("₹ "), F.format_number("p_retailprice", 2), F.lit(" Cr"))).alias("v")))
G("fn_parse_date_multi", "", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders", "", lambda t: t.orders.select("o_orderkey", parse_date(F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(o_orderdate, 'dd-MMM-yyyy') WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy') ELSE date_format(o_orderdate, 'dd/MM/yyyy') END")).alias("d")))
G("fn_quarter_end", "", "SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS yq FROM orders", "",
  lambda t: t.orders.select("o_orderkey", F.last_day(F.to_date(F.date_format("o_orderdate", "MMMM yyyy"), "MMMM yyyy")).alias("month_end"), F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("yq")))
G("fn_month_ends", "bars month_ends", "SELECT rebal_date FROM month_ends", "", lambda t: t.month_ends)
G("fn_calendar", "", "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND d NOT IN (SELECT o_orderdate FROM orders WHERE o_totalprice > 400000)", "",
  lambda t: t.spark.sql("SELECT explode(sequence(date'1997-01-01', date'1997-12-31')) AS date").where("dayofweek(date) BETWEEN 2 AND 6").join(t.orders.where("o_totalprice > 400000").select(F.col("o_orderdate").cast("date").alias("date")), "date", "left_anti"))
G("fn_quarter_sequence", "bars", "SELECT symbol, CAST(unnest(generate_series(date_trunc('quarter', min(date)), CAST(max(date) AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS quarter FROM bars GROUP BY symbol", "",
  lambda t: t.bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("symbol", F.expr("explode(sequence(CAST(date_trunc('quarter', a) AS DATE), b, interval 3 months))").alias("quarter")))
G("fn_days_to_expiry", "option_chain", "SELECT date, symbol, strike, option_typ, expiry, greatest((expiry - date) / 365.0, 0.0001) AS t FROM option_chain", "strike t", lambda t: t.option_chain.select("date", "symbol", "strike", "option_typ", "expiry", F.greatest(F.datediff("expiry", "date") / 365.0, F.lit(1e-4)).alias("t")))
G("fn_json_first_key", "", "SELECT event_id, coalesce(props ->> '$.missing', props ->> '$.k') AS v FROM events", "", lambda t: t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("v")))
G("fn_json_build", "", "SELECT o_custkey, '{' || string_agg('\"' || o_orderstatus || '\":' || CAST(n AS VARCHAR), ',' ORDER BY o_orderstatus) || '}' AS j FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1", "",
  lambda t: t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))))).alias("j")))
G("fn_filing_identity", "filings", "SELECT filing_id, 'bse:' || scrip || ':' || CAST(quarter AS VARCHAR) || ':' || substr(sha1(CAST(filing_id AS VARCHAR)), 1, 10) AS ref FROM filings", "", lambda t: t.filings.select("filing_id", F.concat_ws(":", F.lit("bse"), "scrip", F.col("quarter").cast("string"), F.substring(F.sha1(F.col("filing_id").cast("string").cast("binary")), 1, 10)).alias("ref")))
G("fn_clip_round", "bars", f"SELECT symbol, date, greatest(least(round((close / lag(close) {W} - 1) * 10, 4), 3), -3) AS r FROM bars QUALIFY lag(close) {W} IS NOT NULL", "r", lambda t: S.returns(t.bars).where("ret_1d IS NOT NULL").select("symbol", "date", F.greatest(F.least(F.round(F.col("ret_1d") * 10, 4), F.lit(3.0)), F.lit(-3.0)).alias("r")), 4)
ERF = "(0.5 * (1 + sign(x) * (1 - ((((1.061405429 / (1 + 0.3275911 * abs(x)) - 1.453152027) / (1 + 0.3275911 * abs(x)) + 1.421413741) / (1 + 0.3275911 * abs(x)) - 0.284496736) / (1 + 0.3275911 * abs(x)) + 0.254829592) / (1 + 0.3275911 * abs(x)) * exp(-x * x))))"
PPF_SQL = lambda cs, x: "(" * (len(cs) - 1) + f"{cs[0]!r}" + "".join(f" * {x} + {c!r})" for c in cs[1:])
G("fn_norm_cdf_ppf", "", f"""WITH n AS (SELECT event_id, {ERF} AS cdf, (event_id % 997 + 1) / 998.0 AS p FROM (SELECT event_id, (value / 10 - 2) / sqrt(2) AS x FROM events)),
  q AS (SELECT *, CAST(least(p, 1 - p) AS DOUBLE) AS l, CAST(p - 0.5 AS DOUBLE) AS h FROM n), r AS (SELECT *, sqrt(-2 * ln(l)) AS tail, h * h AS s FROM q)
  SELECT event_id, cdf, CASE WHEN l >= {PPF_TAIL} THEN {PPF_SQL(PPF_A, "s")} * h / {PPF_SQL(PPF_B, "s")} ELSE sign(0.5 - p) * {PPF_SQL(PPF_C, "tail")} / {PPF_SQL(PPF_D, "tail")} END AS ppf FROM r""", "cdf ppf",
  lambda t: t.events.select("event_id", norm_cdf(F.col("value") / 10 - 2).alias("cdf"), norm_ppf((F.col("event_id") % 997 + 1) / 998.0).alias("ppf")))
