"""Normalisers from raw feed layouts to typed tables, and sinks with the upsert semantics of a keyed store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import parse_date
from .scratch import scratch_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pick(*names: str, of: DataFrame) -> Column:
    """The first of the alias columns that the frame has and that is not null or blank."""
    have = {c.lower(): c for c in of.columns}
    found = [F.nullif(F.trim(F.col(have[n.lower()])), F.lit("")) for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def chain_sides(chain: DataFrame) -> DataFrame:
    """(date, symbol, expiry, strike, ce_oi, pe_oi): open interest of calls and puts side by side in one grouping; a side without rows is null."""
    side = lambda kind: F.sum(F.when(F.col("option_typ") == kind, F.col("open_int")))
    return chain.groupBy("date", "symbol", "expiry", "strike").agg(side("CE").alias("ce_oi"), side("PE").alias("pe_oi"))


def bhavcopy(legacy: DataFrame, full: DataFrame) -> DataFrame:
    """Two layouts of daily price files into (symbol, date, open, high, low, close, volume); series EQ only."""
    def one(df: DataFrame, date: str, close: tuple[str, ...], volume: tuple[str, ...]) -> DataFrame:
        num = lambda *n: pick(*n, of=df).try_cast("double")
        return df.where(F.trim("series") == "EQ").select(
            F.trim("symbol").alias("symbol"), parse_date(F.col(date)).alias("date"), num("open", "open_price").alias("open"), num("high", "high_price").alias("high"),
            num("low", "low_price").alias("low"), num(*close).alias("close"), num(*volume).alias("volume"))
    both = one(legacy, "timestamp", ("close", "last"), ("tottrdqty",)).unionByName(one(full, "date1", ("close_price", "last_price"), ("ttl_trd_qnty",)))
    return both.where("date IS NOT NULL AND close IS NOT NULL")


def delivery_lines(lines: DataFrame) -> DataFrame:
    """`20,seq,SYMBOL,EQ,traded,delivered` lines; a dash counts as 0."""
    p = F.split("value", ",")
    num = lambda i: F.when(F.trim(p[i]) == "-", 0.0).otherwise(p[i].try_cast("double"))
    return lines.where((F.trim(p[0]) == "20") & (F.trim(p[3]) == "EQ")).select("date", F.trim(p[2]).alias("symbol"), num(4).alias("total_traded_qty"), num(5).alias("delivery_qty"))


def delivery_pct(d: DataFrame) -> DataFrame:
    return d.where("total_traded_qty > 0").withColumn("delivery_percent", F.coalesce(F.try_divide("delivery_qty", "total_traded_qty") * 100, F.lit(0.0)))


def nav_lines(lines: DataFrame) -> DataFrame:
    """`code;isin;isin2;name;nav;repurchase;sale;date` lines with a numeric code."""
    p = F.split("value", ";")
    return lines.where((F.size(p) >= 8) & p[0].rlike(r"^\d+$")).select(p[0].cast("long").alias("code"), F.trim(p[3]).alias("name"), p[4].try_cast("double").alias("nav"), parse_date(p[7], "dd-MMM-yyyy").alias("date")).where("date IS NOT NULL AND nav IS NOT NULL")


def sections(lines: DataFrame) -> DataFrame:
    """Lines of a sectioned file (file, line_no, value): headers end in `)`, names without `;` set the company, data rows inherit both."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    data, head = F.col("value").contains(";"), F.col("value").endswith(")")
    l = lines.withColumns({"category": F.last(F.when(head & ~data, F.col("value")), True).over(w), "amc": F.last(F.when(~head & ~data, F.col("value")), True).over(w)})
    return l.where(data).select("file", F.split("value", ";")[0].cast("long").alias("code"), "category", "amc")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins on the keys: `changes` over `target`, the highest `seq` of a key."""
    both = target.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_src"), F.desc(seq))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_src")


def insert_ignore(target: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First write wins: rows of `changes` whose key is new, the lowest `seq` of a key."""
    w = Window.partitionBy(*keys).orderBy(seq)
    new = changes.join(target, keys, "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return target.unionByName(new)


def export_partitioned(bars: DataFrame, path: str) -> DataFrame:
    """Bars as Parquet by year, sorted by symbol and date within files, read back."""
    b = bars.withColumn("year", F.year("date")).repartition("year").sortWithinPartitions("symbol", "date")
    b.write.mode("overwrite").partitionBy("year").parquet(path)
    return bars.sparkSession.read.parquet(path)


def after_highwater(rows: DataFrame, stored: DataFrame, key: str, date: str) -> DataFrame:
    """Rows later than the last stored date of their key; unknown keys in full."""
    high = stored.groupBy(key).agg(F.max(date).alias("_hw"))
    return rows.join(high, key, "left").where(F.col("_hw").isNull() | (F.col(date) > F.col("_hw"))).drop("_hw")

