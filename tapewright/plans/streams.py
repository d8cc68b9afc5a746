"""Queries that drain a streaming job over the given tables."""

from pyspark.sql import functions as F

from ..sources.normalize import scratch
from ..streaming import jobs
from .aggregates import G

feed = lambda t: jobs.source(t.spark, t.sf_dir, "events")
G("stream_bars", "", "SELECT user_id, CAST(ts AS DATE) AS date, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2", "open high low close",
  lambda t: jobs.drained(jobs.daily_bars(feed(t)), scratch(t.spark, "stream"), "update", ["user_id", "date"]))
G("stream_dedupe_filings", "", "SELECT user_id, event_type FROM events GROUP BY 1, 2", "", lambda t: jobs.drained(jobs.dedupe(feed(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"]), scratch(t.spark, "stream")).select("user_id", "event_type"))
PURCHASES = """b AS (SELECT CAST(user_id % 20 AS VARCHAR) AS symbol, CAST(ts AS DATE) AS d, props AS name FROM events WHERE event_type = 'purchase' AND user_id % 7 < 2),
  c AS (SELECT symbol, d FROM b WHERE d < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events WHERE event_type = 'purchase' AND user_id % 7 < 2) GROUP BY 1, 2)"""
G("stream_insider_clusters", "", f"""WITH {PURCHASES}, n AS (SELECT c.symbol, c.d, count(DISTINCT b.name) AS n FROM c JOIN b ON b.symbol = c.symbol AND b.d BETWEEN c.d - 7 AND c.d GROUP BY 1, 2 HAVING count(DISTINCT b.name) >= 2),
  f AS (SELECT symbol, min(d) AS d FROM n GROUP BY 1 UNION ALL SELECT f.symbol, (SELECT min(d) FROM n WHERE n.symbol = f.symbol AND n.d > f.d + 7) FROM f WHERE f.d IS NOT NULL)
  SELECT symbol, CAST(f.d - DATE '1970-01-01' AS BIGINT) AS day, n AS insiders FROM f JOIN n USING (symbol, d)""", "",
  lambda t: jobs.drained(jobs.clusters(feed(t).where("event_type = 'purchase' AND user_id % 7 < 2").select(
      (F.col("user_id") % 20).cast("string").alias("symbol"), F.unix_date(F.to_date("ts")).cast("long").alias("day"), F.col("props").alias("name"), "ts"), 7), scratch(t.spark, "stream")))
G("stream_freshness", "", "SELECT event_type AS source, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1", "", lambda t: jobs.drained(feed(t).groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")), scratch(t.spark, "stream"), "update", ["source"]))
