"""Filters, lookups, snapshots and rule-based labels over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import by_symbol


def filtered(bars: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the symbols, from `start` to `end`; what is None doesn't filter. Plain predicates, so they reach the scan."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    return bars if end is None else bars.where(F.col("date") <= F.lit(end).cast("date"))


def last_n(rows: DataFrame, n: int, key: str = "symbol", date: str = "date") -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))).where(F.col("_k") <= n).drop("_k")


def latest_snapshot(rows: DataFrame, date: str = "date") -> DataFrame:
    """All rows of the last date."""
    return rows.join(F.broadcast(rows.agg(F.max(date).alias(date))), date)  # one row


def latest_price(bars: DataFrame) -> DataFrame:
    """(symbol, date, close) of each symbol's last bar."""
    last = F.max(F.struct("date", "close"))
    return bars.groupBy("symbol").agg(last.alias("_l")).select("symbol", "_l.date", "_l.close")


def same_text(column: str, value: str) -> Column:
    """Whether a text equals another but for case."""
    return F.lower(column) == value.lower()


def close_matrix(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """One row per date with a column of closes per symbol, s and its name."""
    wide = bars.where(F.col("symbol").isin(symbols)).groupBy("date").pivot("symbol", symbols).agg(F.first("close"))
    return wide.toDF("date", *(f"s{s}" for s in symbols))


def two_day_return(bars: DataFrame) -> DataFrame:
    """(symbol, ret): change of close from the last market date but one to the last; null where either bar is missing."""
    last = bars.select("date").distinct().orderBy(F.desc("date")).limit(2).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("date"))))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("close")))
    return bars.join(F.broadcast(last), "date").groupBy("symbol").agg((at(1) / at(2) - 1).alias("ret"))  # two rows


def active_events(events: DataFrame, day: str, days: int, date: str = "filing_date") -> DataFrame:
    """Events strictly before a day and at most `days` old."""
    now = F.lit(day).cast("date")
    return events.where((F.col(date) < now) & (F.datediff(now, F.col(date)) <= days))


def search(companies: DataFrame, text: str, code: str, most: int = 20) -> DataFrame:
    """Up to `most` companies, by symbol, whose name holds `text` or whose symbol holds `code`, whatever their case."""
    hit = F.upper("company").contains(text.upper()) | F.upper("symbol").contains(code.upper())
    return companies.where(hit).orderBy("symbol").limit(most)


def without_funds(instruments: DataFrame, held: DataFrame, key: str, kind: str, pattern: str) -> DataFrame:
    """Instruments whose kind doesn't match a pattern and whose key is not among `held`."""
    return instruments.where(~F.col(kind).rlike(pattern)).join(held.select(key).distinct(), key, "left_anti")


def mapped(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """`column` trimmed, and renamed where its lower case is a key of `names`."""
    known = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.lower(), v)])
    return rows.withColumn(column, F.coalesce(F.try_element_at(known, F.lower(F.trim(column))), F.trim(column)))


def scd_active(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, is_active, is_new) of all keys of two snapshots."""
    o, n = (d.select(key).distinct().withColumn(c, F.lit(True)) for d, c in ((old, "_o"), (new, "_n")))
    return o.join(n, key, "full_outer").select(key, F.col("_n").isNotNull().alias("is_active"), F.col("_o").isNull().alias("is_new"))


def quadrant(x: Column, y: Column, names: tuple[str, str, str, str]) -> Column:
    """Names of (x > 0, y > 0), (x > 0, y <= 0), (x <= 0, y > 0) and (x <= 0, y <= 0); null if either is."""
    cases = [((x > 0), (y > 0)), ((x > 0), (y <= 0)), ((x <= 0), (y > 0)), ((x <= 0), (y <= 0))]
    out = F.when(cases[0][0] & cases[0][1], names[0])
    for (a, b), name in zip(cases[1:], names[1:]):
        out = out.when(a & b, name)
    return out


def open_interest_quadrant(chain: DataFrame) -> DataFrame:
    """(symbol, date, quadrant): build-up or unwinding by the changes of open interest and price."""
    o = chain.groupBy("symbol", "date").agg(F.sum("open_int").alias("oi"), F.avg("close").alias("px"))
    change = lambda c: F.col(c) - F.lag(c).over(by_symbol())
    d = o.withColumns({"_d": change("oi"), "_r": change("px")})
    return d.select("symbol", "date", quadrant(F.col("_d"), F.col("_r"), ("long buildup", "short buildup", "short covering", "long unwinding")).alias("quadrant"))


def first_tag(text: str, patterns: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first pattern that a text matches."""
    return F.coalesce(*(F.when(F.col(text).rlike(p), name) for name, p in patterns), F.lit(other))


def classified_actions(rows: DataFrame, subject: str) -> DataFrame:
    """Add action_type, ratio `a:b` and amount `Rs x.y` read from a subject line."""
    said = lambda p, i: F.nullif(F.regexp_extract(subject, p, i), F.lit(""))
    kind = F.coalesce(*(F.when(F.col(subject).rlike(f"(?i){k}"), k.upper()) for k in ("split", "bonus", "dividend")))
    return rows.withColumns({"action_type": kind, "ratio": said(r"(\d+:\d+)", 1), "amount": said(r"Rs (\d+\.\d+)", 1).try_cast("double")})


def insider_categories(trades: DataFrame) -> DataFrame:
    """`category` as promoter, kmp or other, and `kind`, the upper-cased type of the transaction."""
    c = F.lower("category")
    return trades.withColumns(
        {"category": F.when(c.startswith("promoter"), "promoter").when(c == "director", "kmp").otherwise("other"), "kind": F.upper("transaction_type")}
    )
