"""Index membership between snapshots: replay of a change log, and confidence as measured agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT, BRIDGED, LOGGED = "snapshot", "snapshot_bridged", "change_log"


def bridged(intervals: DataFrame, changes: DataFrame, data_end: str, cutoff: str, confidence: float = 0.95) -> DataFrame:
    """(symbol, effective_from, effective_to, method, confidence): intervals [from, to) carried on from the last snapshot to the cutoff.

    `intervals` (symbol, effective_from, effective_to, confidence) end in null where
    the symbol is a member when the data ends; `changes` (symbol, date, change) say
    `add` or `remove`, and count after `data_end` and up to `cutoff`.

    A symbol's changes are taken by date, a removal before an addition of the same
    day. Adding a member or removing a non-member changes nothing, so repeated
    entries count once. What is open at the end is closed at the cutoff; what begins there is left out. Members
    carried past the data get at most `confidence`, as do intervals the log begins.
    """
    closed = intervals.where("effective_to IS NOT NULL").select("symbol", "effective_from", "effective_to", F.lit(SNAPSHOT).alias("method"), "confidence")
    day = lambda d: F.lit(d).cast("date")
    carried = intervals.where("effective_to IS NULL").select(
        "symbol", day(data_end).alias("date"), F.lit("add").alias("change"), "effective_from", F.col("confidence").cast("double").alias("confidence"), F.lit(True).alias("_carried"))
    logged = changes.where((F.col("date") > day(data_end)) & (F.col("date") <= day(cutoff)) & F.col("change").isin("add", "remove")).select(
        "symbol", "date", "change", F.col("date").alias("effective_from"), F.lit(confidence).alias("confidence"), F.lit(False).alias("_carried"))
    w = Window.partitionBy("symbol").orderBy("date", F.desc("change"))
    turns = carried.unionByName(logged).withColumn("_before", F.coalesce(F.lag("change").over(w), F.lit("remove"))).where("change <> _before")
    spans = turns.withColumn("_until", F.lead("date").over(w)).where("change = 'add'")
    method = F.when(F.col("_carried"), F.when(F.col("_until").isNull(), BRIDGED).otherwise(SNAPSHOT)).otherwise(LOGGED)
    sure = F.when(F.col("_until").isNull(), F.least("confidence", F.lit(confidence))).otherwise(F.col("confidence"))
    carried_on = spans.select("symbol", "effective_from", F.coalesce("_until", day(cutoff)).alias("effective_to"), method.alias("method"), sure.alias("confidence"))
    return closed.unionByName(carried_on.where("effective_from < effective_to"))


def agreement(rebuilt: DataFrame, official: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, confidence): the share of a segment's official members that were rebuilt, to two digits; 0 for a segment without official members."""
    both = rebuilt.select(segment, "symbol").distinct().withColumn("_r", F.lit(1)).join(
        official.select(segment, "symbol").distinct().withColumn("_o", F.lit(1)), [segment, "symbol"], "full")
    share = F.try_divide(F.count(F.when(F.col("_r") == F.col("_o"), 1)), F.count("_o"))
    return both.groupBy(segment).agg(F.round(F.coalesce(share, F.lit(0.0)), 2).alias("confidence"))


def consumable(intervals: DataFrame, rebuilt: DataFrame, official: DataFrame, least: float = 0.75, segment: str = "segment") -> DataFrame:
    """The intervals of the segments whose rebuilt members agree well enough with the official ones, with that confidence."""
    sure = agreement(rebuilt, official, segment).where(F.col("confidence") >= least)
    return intervals.drop("confidence").join(sure, segment)
