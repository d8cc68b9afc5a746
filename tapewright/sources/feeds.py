"""Readers of raw feed layouts: text lines, ban lists, RSS documents and statistics JSON, as DataFrames of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a participant's line after its name, in file order (fixed values).
PARTICIPANT = [
    "index_fut_long", "index_fut_short", "stock_fut_long", "stock_fut_short", "index_call_long", "index_put_long", "index_call_short",
    "index_put_short", "stock_call_long", "stock_put_long", "stock_call_short", "stock_put_short",
]


def participant_oi(lines: DataFrame) -> DataFrame:
    """(date, participant, twelve figures, index_fut_net, stock_fut_net) from (date, line_no, value).

    A title and a header come first; lines with fewer than 13 fields or without a
    name are left out, and what is no number is null, as is a net of nulls.
    """
    parts = F.transform(F.split("value", ","), lambda v: F.trim(v))
    rows = lines.where("line_no >= 2").withColumn("_p", parts).where((F.size("_p") >= 13) & (F.col("_p")[0] != ""))
    rows = rows.select("date", F.col("_p")[0].alias("participant"), *(F.col("_p")[i + 1].try_cast("double").alias(c) for i, c in enumerate(PARTICIPANT)))
    net = lambda kind: (F.col(f"{kind}_long") - F.col(f"{kind}_short")).alias(f"{kind}_net")
    return rows.select("*", net("index_fut"), net("stock_fut"))


def ban_list(texts: DataFrame) -> DataFrame:
    """(date, symbol) from `text` such as `Securities in Ban For Trade Date 29-JUN-2026: A, B`; `NIL` has no symbols."""
    said = F.split(F.regexp_extract("text", r"Trade Date\s+(\d{1,2}-[A-Za-z]{3}-\d{4})", 1), "-")
    day = F.try_to_date(F.concat_ws("-", F.get(said, F.lit(0)), F.initcap(F.get(said, F.lit(1))), F.get(said, F.lit(2))), "d-MMM-yyyy")
    body = F.regexp_replace("text", r"(?s)^[^:]*:", "")
    tokens = F.transform(F.split(body, r"[\n,]+"), lambda v: F.trim(v))
    found = texts.select(day.alias("date"), F.explode(tokens).alias("symbol"))
    return found.where(F.col("symbol").rlike(r"^[A-Z&\-]{2,}$") & (F.col("symbol") != "NIL"))


def published(text: Column) -> Column:
    """The date and time that an RSS date says, without its zone; other texts stay as they are, to 25 characters."""
    said = F.regexp_extract(F.trim(text), r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})(?: [+-]\d{4}| [A-Z]{1,4})?$", 1)
    return F.coalesce(F.date_format(F.try_to_timestamp(said, F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd HH:mm:ss"), F.substring(F.trim(text), 1, 25))


def news_items(feeds: DataFrame) -> DataFrame:
    """(link, title, published, source) from RSS documents (source, fetched, xml); of a link the item fetched last, later in its feed."""
    read = feeds.withColumn("_x", F.from_xml("xml", "channel struct<item: array<struct<link: string, title: string, pubDate: string>>>"))
    items = read.select("source", "fetched", F.posexplode("_x.channel.item").alias("_at", "_i"))
    rows = items.select(
        F.trim("_i.link").alias("link"), F.trim("_i.title").alias("title"), published(F.col("_i.pubDate")).alias("published"), "source", "fetched", "_at"
    ).where("link <> '' AND title <> ''")
    last = Window.partitionBy("link").orderBy(F.desc("fetched"), F.desc("source"), F.desc("_at"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("link", "title", "published", "source")


def annual_series(replies: DataFrame) -> DataFrame:
    """(series_id, date, value, frequency) from replies (series_id, text) of the form [{...}, [{"date": "1999", "value": 1.0}, ...]]."""
    records = F.from_json(F.get_json_object("text", "$[1]"), "array<struct<date: string, value: double>>")
    rows = replies.select("series_id", F.explode(records).alias("r")).where("r.date IS NOT NULL AND r.value IS NOT NULL")
    return rows.select("series_id", F.make_date(F.col("r.date").cast("int"), F.lit(1), F.lit(1)).alias("date"), F.col("r.value").alias("value"), F.lit("A").alias("frequency"))


def announcements(rows: DataFrame, default: Column) -> DataFrame:
    """(date, symbol, subject) from (symbol, dt, subject): dates of several layouts, else the default; one row per date, symbol and subject."""
    day = F.coalesce(F.try_to_date(F.substring("dt", 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring("dt", 1, 11), "dd-MMM-yyyy"), default)
    fill = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.select(day.alias("date"), fill("symbol").alias("symbol"), fill("subject").alias("subject")).distinct()
