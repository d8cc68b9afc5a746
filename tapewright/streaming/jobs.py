"""Structured Streaming jobs over file feeds: OHLC bars, de-duplicated filings, insider clusters and freshness.

Each job takes a streaming DataFrame and a folder; `drained` runs one to the end
of what the source holds (availableNow) and returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The Parquet files of one table as a feed; times become timestamps of the session's zone."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def daily_bars(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily OHLCV per user with a watermark for late ticks."""
    k = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(
        F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.count(F.lit(1)).alias("n")
    ).select("user_id", F.col("window.start").cast("date").alias("date"), "open", "high", "low", "close", "n")


def dedupe(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


DAY_MS = 86_400_000


def clusters(trades: DataFrame, days: int = 28, least: int = 2, late: str = "1 day") -> DataFrame:
    """Alerts when `least` names trade a symbol within `days`; none again within `days` of the last one.

    A day is judged once the watermark has passed its end, so rows that come late
    but within the watermark, in whatever batch, count where they belong. State per
    symbol: the distinct (day, name) of the window and of days not yet judged, the
    last day judged and the last alert; it goes when the watermark has left the
    last alert's window. Days that the watermark has not passed give no alert yet.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, judged, last = (state.get if state.exists else ([], -(10**9), -(10**9)))
        held = {(int(d), n) for d, n in (x.split(" ", 1) for x in seen)}
        if not state.hasTimedOut:
            for part in batches:
                held.update(zip(part["day"].astype(int).tolist(), part["name"].astype(str).tolist()))
        closed, out = state.getCurrentWatermarkMs() // DAY_MS, []
        for day in sorted({d for d, _ in held if judged < d < closed}):
            names = {n for d, n in held if day - days <= d <= day}
            if len(names) >= least and day > last + days:
                out.append((key[0], day, len(names)))
                last = day
            judged = day
        held = {(d, n) for d, n in held if d >= min(judged, closed) - days}
        waiting = [d for d, _ in held if d > judged]
        if not waiting and closed > last + days:
            state.remove()
        else:
            state.update((sorted(f"{d} {n}" for d, n in held), judged, last))
            until = (min(waiting) + 1 if waiting else max(last, judged) + days + 1) * DAY_MS
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["symbol", "day", "insiders"])

    return trades.withWatermark("ts", late).groupBy("symbol").applyInPandasWithState(
        update, "symbol string, day long, insiders long", "seen array<string>, judged long, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def drained(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run to the end of the feed and read back what was written.

    In update mode every batch writes only the rows that changed, to a folder of
    its own (a batch that is run again overwrites it), and of each key the row of
    the last batch is read; state is dropped behind the watermark. In complete mode
    the last batch's result is what stays.
    """
    spark = stream.sparkSession
    out = f"{folder}/out"
    if mode == "update":
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
    elif mode == "complete":
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    last = Window.partitionBy(*(keys or [])).orderBy(F.desc("batch"))
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").select(*stream.columns)
