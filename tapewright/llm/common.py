"""Helpers shared by the training-data operators: scratch tables, ranks, joins with hot keys, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Parts into which the rows of one key are dealt by `join_hot`.
SALTS = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, for results that outlive the call."""
    return Scratch(df.sparkSession).written(df, name)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], salt: str, how: str = "left") -> DataFrame:
    """`left` joined with `right`, which has one row per key, where a key may hold a third of `left`.

    The rows of `left` are dealt to SALTS parts by a hash of the column `salt`, and
    every row of `right` is given to each part.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return dealt.join(right.withColumn("_salt", parts), [*keys, "_salt"], how).drop("_salt")


def rank_in_group(df: DataFrame, group: str, key: str, out: str, digits: int = 3) -> DataFrame:
    """Add `out`: the 0-based rank of each row in its group, in order of the hex string `key`.

    Ranks are summed from two parts: the rows of earlier key prefixes (a count
    aggregated before its shuffle) and the row number among rows of the same
    group and prefix. A group with a third of all rows is thus spread over
    16**digits windows. `key` should be an evenly spread digest; `group` must
    not be null.
    """
    dealt = df.withColumn("_bucket", F.substring(key, 1, digits))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(group, "_bucket").orderBy(key)
    return (
        dealt.withColumn("_in", F.row_number().over(within) - 1)
        .join(offsets, [group, "_bucket"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_bucket", "_in", "_before")
    )


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """All rows, or about `rows` of them chosen by a hash of the id where there are more."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 40)) < int(rows / total * (1 << 40)))


def id_key(id_col: str) -> Column:
    """An evenly spread hex key of an id; null ids get one each, by their place in the table."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string"))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, comp) for the nodes of `edges`; comp is the smallest node reachable.

    Large-star and small-star rounds: each joins nothing and groups edges only
    by aggregated minima, and is written to the shared folder, where it takes
    the place of the one before. Rounds end when the set of edges no longer
    changes; their number grows with the logarithm of the largest component.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    kept = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    kept = scratch.written(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    last = None
    while True:
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: every neighbour above u links to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: u and its smaller neighbours link to the smallest of them
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, kept = kept, scratch.written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        scratch.drop(before)
        now = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    named = kept.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        kept.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
    named, stars = scratch.written(named, "components"), kept
    scratch.drop(stars)
    return named
