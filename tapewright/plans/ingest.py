"""Queries over normalisers and sinks. Raw layouts are derived from the tables; the SQL states the typed result."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import parse_date, parse_number
from ..sources import feeds
from ..sources import normalize as N
from .aggregates import G

s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
BARS = "SELECT symbol, date, open, high, low, close, volume FROM bars"
OHLCV = "open high low close volume"


def raw_bars(t, date_name, fmt, names):
    b = t.bars.select("symbol", F.date_format("date", fmt).alias(date_name), *(s(c).alias(n) for c, n in zip(OHLCV.split(), names)), F.lit(" EQ ").alias("series"))
    return b.unionByName(b.where("symbol = '1'").withColumn("series", F.lit("BE")))


G("bars_normalize_bhavcopy", "bars", BARS, OHLCV, lambda t: N.bhavcopy(raw_bars(t, "timestamp", "dd-MMM-yyyy", ["open", "high", "low", "close", "tottrdqty"]).where("symbol < '5'"), raw_bars(t, "date1", "yyyy-MM-dd", ["open_price", "high_price", "low_price", "close_price", "ttl_trd_qnty"]).where("symbol >= '5'")))
G("delivery_normalize", "delivery", "SELECT date, symbol, total_traded_qty, delivery_qty FROM delivery", "total_traded_qty delivery_qty",
  lambda t: N.delivery_lines(t.delivery.select("date", F.concat_ws(",", F.lit("20"), F.lit("1"), "symbol", F.lit("EQ"), s("total_traded_qty"), F.when(F.col("delivery_qty") == 0, "-").otherwise(s("delivery_qty"))).alias("value"))))
G("delivery_pct_derive", "delivery", "SELECT date, symbol, 100 * delivery_qty / total_traded_qty AS delivery_percent FROM delivery", "delivery_percent", lambda t: N.delivery_pct(t.delivery.drop("delivery_percent")).select("date", "symbol", "delivery_percent"))
G("fo_normalize", "option_chain", "SELECT date, symbol, expiry, strike, option_typ, CAST(round(open_int) AS BIGINT) AS open_int FROM option_chain", "strike",
  lambda t: (lambda r: r.select(parse_date(N.pick("timestamp", "trade_date", of=r)).alias("date"), F.upper(N.pick("tckrsymb", "symbol", of=r)).alias("symbol"), parse_date(N.pick("expiry_dt", of=r), "dd-MMM-yyyy").alias("expiry"), N.pick("strike_pr", of=r).cast("double").alias("strike"), F.upper(N.pick("opttype", of=r)).alias("option_typ"), F.round(N.pick("open_int", of=r).cast("double")).cast("long").alias("open_int")))(
      t.option_chain.select(s("date").alias("TIMESTAMP"), F.concat(F.lit(" "), "symbol").alias("TckrSymb"), F.date_format("expiry", "dd-MMM-yyyy").alias("EXPIRY_DT"), s("strike").alias("STRIKE_PR"), F.lower("option_typ").alias("OptType"), s("open_int").alias("OPEN_INT"))))
G("nav_normalize", "bars", "SELECT CAST(symbol AS BIGINT) AS code, 'Fund ' || symbol AS name, close AS nav, date FROM bars", "nav",
  lambda t: N.nav_lines(t.bars.select(F.concat_ws(";", "symbol", F.lit("I"), F.lit("-"), F.concat(F.lit("Fund "), "symbol"), s("close"), F.lit(""), F.lit(""), F.date_format("date", "dd-MMM-yyyy")).alias("value")).unionByName(t.nation.select(F.concat(F.lit("Open Ended "), "n_name").alias("value")))))
G("scheme_master_sections", "", "SELECT r_name AS file, CAST(n_nationkey AS BIGINT) AS code, 'Equity (' || r_name || ')' AS category, 'AMC ' || r_name AS amc FROM nation JOIN region ON n_regionkey = r_regionkey", "",
  lambda t: N.sections(t.region.select(F.col("r_name").alias("file"), F.lit(0).alias("line_no"), F.concat(F.lit("Equity ("), "r_name", F.lit(")")).alias("value")).unionByName(t.region.select(F.col("r_name").alias("file"), F.lit(1).alias("line_no"), F.concat(F.lit("AMC "), "r_name").alias("value"))).unionByName(
      t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("file"), (F.col("n_nationkey") + 2).alias("line_no"), F.concat(s("n_nationkey"), F.lit(";"), "n_name").alias("value")))))
PLACES = {c: i for i, c in enumerate(feeds.PARTICIPANT)}


def participant_lines(t):
    """One file per date: a title, a header, a line per participant whose figures are made of its volumes, and a short line."""
    figure = lambda i: F.when(F.lit(i == 11), F.lit("-")).otherwise(s(F.floor(F.col("total_traded_qty") * (i + 1) - F.col("delivery_qty") * (i % 3))))
    body = t.delivery.select("date", (F.dense_rank().over(Window.partitionBy("date").orderBy("symbol")) + 1).alias("line_no"), F.concat_ws(",", F.concat(F.lit(" "), "symbol"), *(figure(i) for i in range(12)), F.lit("")).alias("value"))
    heads = t.delivery.select("date").distinct().select("date", F.explode(F.array(*(F.struct(F.lit(n).alias("line_no"), F.lit(v).alias("value")) for n, v in ((0, "Title"), (1, "Client Type,Future Index Long"), (9999, "TOTAL,1,2"))))).alias("h"))
    return body.unionByName(heads.select("date", "h.*"))


figure_sql = lambda c: "CAST(NULL AS DOUBLE)" if PLACES[c] == 11 else f"floor(total_traded_qty * {PLACES[c] + 1} - delivery_qty * {PLACES[c] % 3})"
G("participant_oi_normalize", "delivery", f"""SELECT date, symbol AS participant, {', '.join(f'CAST({figure_sql(c)} AS DOUBLE) AS {c}' for c in feeds.PARTICIPANT)},
  {figure_sql('index_fut_long')} - {figure_sql('index_fut_short')} AS index_fut_net, {figure_sql('stock_fut_long')} - {figure_sql('stock_fut_short')} AS stock_fut_net FROM delivery""",
  " ".join(feeds.PARTICIPANT) + " index_fut_net stock_fut_net", lambda t: feeds.participant_oi(participant_lines(t)))
G("deals_normalize", "", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS price FROM orders", "price",
  lambda t: t.orders.select("o_orderkey", parse_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("date"), parse_number(F.format_number("o_totalprice", 2)).alias("price")))
G("industry_flows_normalize", "", "SELECT p_brand AS name, p_size AS schemes, round(p_retailprice, 2) AS aum FROM part WHERE p_size > 5", "aum",
  lambda t: t.part.select(F.trim(F.concat(F.lit(" "), "p_brand")).alias("name"), F.when(F.col("p_size") > 5, s("p_size")).otherwise("n/a").try_cast("int").alias("schemes"), parse_number(F.format_number("p_retailprice", 2)).alias("aum")).where("name <> '' AND schemes IS NOT NULL"))
G("index_valuation_normalize", "index_series", "SELECT date, close AS pe, CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) END AS pb FROM index_series", "pe pb",
  lambda t: t.index_series.select(F.to_json(F.struct(s("date").alias("d"), s("close").alias("pe"), F.when(F.col("n") % 2 == 0, s("n")).otherwise("-").alias("pb"))).alias("j")).withColumn("x", F.from_json("j", "d string, pe string, pb string")).select(parse_date(F.col("x.d")).alias("date"), F.col("x.pe").try_cast("double").alias("pe"), F.col("x.pb").try_cast("double").alias("pb")))
G("macro_series_long", "", "SELECT o_orderpriority AS series_id, make_date(year(o_orderdate), 1, 1) AS date, sum(o_totalprice) AS value, 'A' AS frequency FROM orders GROUP BY 1, 2", "value",
  lambda t: feeds.annual_series(
      t.orders.groupBy(F.col("o_orderpriority").alias("series_id"), s(F.year("o_orderdate")).alias("date")).agg(F.sum("o_totalprice").alias("value"))
      .unionByName(t.orders.select(F.col("o_orderpriority").alias("series_id"), F.lit("1900").alias("date"), F.lit(None).cast("double").alias("value")).distinct())
      .groupBy("series_id").agg(F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list(F.struct("date", "value")), {"ignoreNullFields": "false"}), F.lit("]")).alias("text"))), 2)
NEWS_DATE = "CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS DATE)"
ZONES = ("' +0530'", "' GMT'", "''")


def rss(t):
    """An RSS document per host: an item a page (title `Page n`, dates in three layouts), an item without a link and one without a title."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    zone = F.element_at(F.array(*(F.lit(z.strip("'")) for z in ZONES)), (F.col("page_id") % 3 + 1).cast("int"))
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    when = F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 10:30:00"), zone)
    item = tag("item", F.concat(tag("title", F.concat(F.lit("Page "), s("page_id"))), tag("link", escape(F.col("url"))), tag("pubDate", when)))
    pages = t.pages.where("url <> ''").select((F.col("page_id") % 20).alias("k"), F.struct("page_id", item.alias("x")).alias("i"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda v: v["x"]), "")
    odd = "<item><title>No link</title></item><item><link>http://no.title</link></item>"
    return pages.groupBy("k").agg(text.alias("items")).select(
        F.concat(F.lit("host"), s("k")).alias("source"), F.col("k").alias("fetched"), F.concat(F.lit("<rss><channel>"), "items", F.lit(odd + "</channel></rss>")).alias("xml"))


G("news_feed_extract", "", f"""SELECT url AS link, 'Page ' || page_id AS title, strftime({NEWS_DATE}, '%Y-%m-%d') || ' 10:30:00' AS published, 'host' || page_id % 20 AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id % 20 DESC, page_id DESC) AS k FROM pages WHERE url <> '') WHERE k = 1""", "", lambda t: feeds.news_items(rss(t)))
G("pit_xml_facts", "insider_trades", "SELECT event_id, transaction_type AS kind, category FROM insider_trades", "",
  lambda t: t.insider_trades.select("event_id", F.concat(F.lit("<x><kind>"), "transaction_type", F.lit("</kind><category>"), "category", F.lit("</category></x>")).alias("x")).withColumn("f", F.from_xml("x", "kind string, category string")).select("event_id", "f.kind", "f.category"))
G("fo_ban_parse", "", """SELECT day AS date, symbol FROM (SELECT CAST(o_orderdate AS DATE) AS day, 'S' || chr(CAST(65 + o_custkey % 26 AS INTEGER)) AS symbol FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1, 2)""", "",
  lambda t: feeds.ban_list(
      t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.array_join(F.collect_set(F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("S"), F.char(65 + F.col("o_custkey") % 26)))), ",\n ").alias("l"))
      .select(F.concat(F.lit("Securities in Ban For Trade Date "), F.upper(F.date_format("day", "dd-MMM-yyyy")), F.lit(": "), F.when(F.col("l") == "", "NIL").otherwise(F.concat(F.lit("1\n"), F.col("l"), F.lit(", x1")))).alias("text"))))
G("statement_json_scan", "statements", "SELECT symbol, quarter, revenue, net_income FROM statements", "revenue net_income",
  lambda t: t.statements.select("symbol", "quarter", F.to_json(F.struct("revenue", "net_income")).alias("j")).withColumn("m", F.from_json("j", "map<string,double>")).select("symbol", "quarter", F.col("m")["revenue"].alias("revenue"), F.col("m")["net_income"].alias("net_income")), 2)
G("holding_json_tables", "", "SELECT o_custkey, o_orderkey, o_totalprice AS pct, o_orderstatus = 'P' AS is_aggregate FROM orders", "pct",
  lambda t: t.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").alias("pct"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("holder")))).alias("j")).select("o_custkey", F.explode(F.from_json("j", "array<struct<o_orderkey:bigint,pct:double,holder:string>>")).alias("x")).select("o_custkey", "x.o_orderkey", "x.pct", F.nullif(F.trim("x.holder"), F.lit("")).isNull().alias("is_aggregate")), 2)
G("option_chain_flatten", "option_chain", "SELECT date, symbol, expiry, strike, sum(open_int) FILTER (option_typ = 'CE') AS ce_oi, sum(open_int) FILTER (option_typ = 'PE') AS pe_oi, sum(open_int) FILTER (option_typ = 'PE') / sum(open_int) FILTER (option_typ = 'CE') AS pcr_strike FROM option_chain GROUP BY 1, 2, 3, 4", "strike ce_oi pe_oi pcr_strike",
  lambda t: N.chain_sides(t.option_chain).withColumn("pcr_strike", F.try_divide("pe_oi", "ce_oi")))
G("corporate_calendar_normalize", "", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, substr(o_orderpriority, 1, 3) AS description FROM orders", "",
  lambda t: t.orders.select(F.to_json(F.struct("o_orderkey", F.date_format("o_orderdate", "dd-MMM-yyyy HH:mm:ss").alias("d"), F.col("o_orderpriority").alias("p"))).alias("j")).withColumn("x", F.from_json("j", "o_orderkey bigint, d string, p string")).select("x.o_orderkey", parse_date(F.col("x.d")).alias("date"), F.substring("x.p", 1, 3).alias("description")))
G("earnings_holdings_normalize", "", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS eps FROM orders", "eps",
  lambda t: t.orders.select("o_orderkey", F.concat_ws(",", s("o_orderkey"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(s("o_totalprice"))).alias("l")).withColumn("c", F.from_csv("l", F.lit("k bigint, eps string"))).select("o_orderkey", F.nullif(F.col("c.eps"), F.lit("n/a")).try_cast("double").alias("eps")))
G("ipo_normalize", "", "SELECT p_partkey, p_name || ' & ' || p_brand AS name FROM part", "", lambda t: t.part.select("p_partkey", F.concat(F.lit("<b>"), "p_name", F.lit("</b> &amp; <i>"), "p_brand", F.lit("</i>")).alias("h")).select("p_partkey", F.replace(F.regexp_replace("h", "<[^>]+>", ""), F.lit("&amp;"), F.lit("&")).alias("name")))
G("constituents_normalize", "sector_map", "SELECT symbol, company, sector AS industry FROM sector_map", "", lambda t: t.sector_map.select(F.concat_ws(",", F.concat(F.lit(" "), "symbol"), "company", "sector").alias("l")).withColumn("c", F.from_csv("l", F.lit("symbol string, company string, industry string"))).select(F.trim("c.symbol").alias("symbol"), F.trim("c.company").alias("company"), F.trim("c.industry").alias("industry")).where("symbol <> ''"))
G("scrip_master_normalize", "", "SELECT p_partkey AS scrip, CASE WHEN p_size > 40 THEN 'sme' ELSE 'mainboard' END AS segment FROM part", "", lambda t: t.part.select(F.to_json(F.struct(F.col("p_partkey").alias("scrip"), F.when(F.col("p_size") > 40, "M").otherwise("A").alias("grp"))).alias("j")).withColumn("x", F.from_json("j", "scrip bigint, grp string")).select("x.scrip", F.when(F.col("x.grp").isin("M", "MT", "MS"), "sme").otherwise("mainboard").alias("segment")))
G("trends_unpivot", "", "SELECT CAST(ts AS DATE) AS date, query, score FROM (SELECT ts, CAST(user_id AS DOUBLE) AS users, value FROM events) UNPIVOT INCLUDE NULLS (score FOR query IN (users, value))", "score", lambda t: t.events.select(F.to_date("ts").alias("date"), F.col("user_id").cast("double").alias("users"), "value").unpivot(["date"], ["users", "value"], "query", "score"))
G("shareholding_quarter_normalize", "filings", "SELECT filing_id, CAST(year(quarter) AS VARCHAR) || '-Q' || CAST(quarter(quarter) AS VARCHAR) AS yq, round(amount / 10000, 2) AS pct FROM filings", "pct",
  lambda t: t.filings.select("filing_id", F.concat(F.year("quarter"), F.lit("-Q"), F.quarter("quarter")).alias("yq"), parse_number(F.concat(F.format_number(F.round(F.col("amount") / 10000, 2), 2), F.lit("%"))).alias("pct")))
SUBJECT = "split_part(text, '.', 1)"
G("announcements_normalize", "", f"""SELECT DISTINCT CASE WHEN doc_id % 3 = 2 THEN DATE '2000-01-01' ELSE DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) END AS date, coalesce(source, '') AS symbol, trim({SUBJECT}, ' ') AS subject
  FROM documents WHERE text IS NOT NULL""", "",
  lambda t: (lambda day: feeds.announcements(
      t.documents.where("text IS NOT NULL").select(F.col("source").alias("symbol"), F.expr("split_part(text, '.', 1)").alias("subject"),
          F.when(F.col("doc_id") % 3 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00:00"))).when(F.col("doc_id") % 3 == 1, F.concat(F.date_format(day, "dd-MMM-yyyy"), F.lit(" 10:00"))).otherwise("soon").alias("dt")),
      F.lit("2000-01-01").cast("date")))(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))))
G("membership_matrix_unpivot", "", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, symbol FROM (SELECT o_orderdate, unnest(['F', 'O', 'P']) AS symbol, o_orderstatus FROM orders) WHERE symbol = o_orderstatus GROUP BY 1, 2", "",
  lambda t: t.orders.groupBy(F.trunc("o_orderdate", "MM").alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).unpivot(["month"], ["F", "O", "P"], "symbol", "w").where("w > 0").select("month", "symbol"))
G("sink_upsert", "", "SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1", "price",
  lambda t: (lambda o: N.upsert(o.where("d < date'1998-01-01'"), o.where("d >= date'1998-01-01'"), ["o_custkey"], "seq").select("o_custkey", "price"))(t.orders.select("o_custkey", F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("d"), F.struct("o_orderdate", "o_orderkey").alias("seq"))))
G("sink_insert_ignore", "", "SELECT o_custkey, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1", "price",
  lambda t: (lambda o: N.insert_ignore(N.insert_ignore(o.where("false"), o.where("d < date'1998-01-01'"), ["o_custkey"], "seq"), o.where("d >= date'1998-01-01'"), ["o_custkey"], "seq").select("o_custkey", "price"))(t.orders.select("o_custkey", F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("d"), F.struct("o_orderdate", "o_orderkey").alias("seq"))))
G("sink_replace_by_key", "", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", "", lambda t: (lambda old, new: old.join(F.broadcast(new.select("event_type").distinct()), "event_type", "left_anti").unionByName(new))(t.events.where("event_type <> 'error'").groupBy("event_type").agg((F.count("*") - 1).alias("n")), t.events.groupBy("event_type").agg(F.count("*").alias("n"))))
G("export_partitioned_parquet", "bars", "SELECT symbol, date, close, CAST(year(date) AS INTEGER) AS year FROM bars", "close", lambda t: N.export_partitioned(t.bars, N.scratch(t.spark, "bars")).select("symbol", "date", "close", "year"))
G("scan_bars_year_pruned", "bars", "SELECT symbol, date, close FROM bars WHERE year(date) BETWEEN 1997 AND 1998 AND symbol = '3'", "close", lambda t: N.export_partitioned(t.bars, N.scratch(t.spark, "bars")).where("year BETWEEN 1997 AND 1998 AND symbol = '3'").select("symbol", "date", "close"))
G("incremental_highwater", "bars", "WITH h AS (SELECT symbol, max(date) AS m FROM bars WHERE date < DATE '2000-01-01' AND symbol <> '5' GROUP BY 1) SELECT b.symbol, b.date, close FROM bars b LEFT JOIN h USING (symbol) WHERE m IS NULL OR b.date > m", "close",
  lambda t: N.after_highwater(t.bars, t.bars.where("date < date'2000-01-01' AND symbol <> '5'"), "symbol", "date").select("symbol", "date", "close"))
