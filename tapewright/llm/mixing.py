"""Mixing sources to target weights by Pfair scheduling.

DataFrame and SQL functions only. The documents of a source, in the order of a
digest of their id, form blocks of `block_rows`. With integer weights a_s and
Q = sum of a_s, block i (from 0) of source s is released at slot
floor(i*Q/a_s) and due by slot ceil((i+1)*Q/a_s). Earliest deadline first among
released blocks serves every block inside its window, so that at every slot
each source is less than one block from its share. All windows repeat after Q
slots, so one period of Q slots is scheduled and block i takes the slot of its
place in the period. Every document gets a slot: when a source is exhausted its
slots stay empty and the others go on in the same proportions; positions count
only rows that exist.

Sources of equal weight have equal windows and take turns, so the schedule is a
fold over Q slots whose state is one count per distinct weight, however many
sources there are; deadlines that tie go to the larger weight, then by name.
The fold's picks are gathered in stretches of STRETCH slots.

Bounds: what the driver gathers is one row per distinct weight. Schedule and
sources are broadcast up to BROADCAST rows; beyond, rows are joined with them.
Null sources form a source of their own; null ids come in the order of the table;
rows that repeat an id follow each other. An empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_key, join_hot, rank_in_group

STRETCH = 1024
BROADCAST = 65_536
SPAN = 256  # slots of one window of positions


def _named(source: str | None) -> str:
    return "null" if source is None else "=" + source


def period_schedule(spark: SparkSession, classes: list[tuple[int, int]]) -> DataFrame:
    """(_class, _nth, _t): the slots of one period, for (weight, number of sources) by falling weight."""
    period = sum(a * m for a, m in classes)
    ints = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    members = ints(m for _, m in classes)
    pick = f"""array_min(filter(transform({ints(a for a, _ in classes)}, (w, i) -> struct(
        ((x.served[i] div {members}[i] + 1) * {period}L + w - 1) div w AS due, i AS i, (x.served[i] div {members}[i]) * {period}L div w AS released)),
        c -> c.released <= t)).i"""
    stretch = f"""aggregate(sequence(o * {STRETCH}L, least((o + 1) * {STRETCH}L, {period}L) - 1),
        named_struct('served', y.served, 'picks', cast(array() AS array<int>)),
        (x, t) -> transform(array({pick}), p -> named_struct(
            'served', transform(x.served, (v, i) -> v + if(i = p, 1L, 0L)), 'picks', concat(x.picks, array(p))))[0])"""
    whole = f"""aggregate(sequence(0L, {-(-period // STRETCH) - 1}L),
        named_struct('served', {ints([0] * len(classes))}, 'all', cast(array() AS array<array<int>>)),
        (y, o) -> transform(array({stretch}), z -> named_struct('served', z.served, 'all', concat(y.all, array(z.picks))))[0],
        y -> flatten(y.all))"""
    slots = spark.range(1).select(F.posexplode(F.expr(whole)).alias("_t", "_class")).withColumn("_t", F.col("_t").cast("long"))
    return slots.withColumn("_nth", F.row_number().over(Window.partitionBy("_class").orderBy("_t")).cast("long") - 1)


def positions(placed: DataFrame) -> DataFrame:
    """Add `position`: the place of each row by slot, then rank.

    A window holds the rows of SPAN slots; what comes before is summed from counts
    by window, in two levels.
    """
    dealt = placed.withColumn("_span", F.floor(F.col("slot") / SPAN))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy("_span").agg(F.count(F.lit(1)).alias("_n")).withColumn("_wide", F.floor(F.col("_span") / SPAN))
    wide = spans.groupBy("_wide").agg(F.sum("_n").alias("_m"))
    wide = wide.select("_wide", F.coalesce(F.sum("_m").over(before(Window.orderBy("_wide"))), F.lit(0)).alias("_first"))
    inside = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_wide").orderBy("_span"))), F.lit(0))
    starts = spans.withColumn("_inside", inside).join(wide, "_wide").select("_span", (F.col("_first") + F.col("_inside")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_span").orderBy("slot", "_rank")) - 1
    return dealt.withColumn("_place", place).join(starts, "_span").withColumn("position", F.col("_start") + F.col("_place"))


def pfair_mix(
    docs: DataFrame,
    weights: dict[str | None, int],
    default_weight: int = 1,
    block_rows: int = 16,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, block, release, deadline, slot, position, in_mix), one row per document.

    `position` is the row's place in the whole interleaved stream (from 0).
    `in_mix` marks slots before the first source is exhausted: up to there every
    prefix of whole slots keeps the target weights to less than one block.
    """
    given = {_named(s): int(w) for s, w in weights.items()}
    if any(w < 1 for w in [default_weight, *given.values()]):
        raise ValueError("weights must be 1 or more")
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), named.alias("_s"), id_key(id_col).alias("_key"))
    weight = F.lit(default_weight)
    if given:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, w in given.items() for x in (s, w)]), F.col("_s")), weight)
    sources = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_have")).withColumn("_a", weight.cast("long"))
    found = sources.groupBy("_a").agg(F.count(F.lit(1)).alias("m")).collect()
    classes = sorted(((r["_a"], r["m"]) for r in found), reverse=True) or [(1, 1)]
    period, many = sum(a * m for a, m in classes), sum(m for _, m in classes)
    # the first source to run out: its number of whole blocks fixes how far the mix is on target
    horizon = sources.agg(F.min(F.expr(f"(_have div {block_rows}) * {period}L div _a"))).first()[0] or 0

    ranks = {a: i for i, (a, _) in enumerate(classes)}
    sources = sources.select(
        "_s", "_a", F.element_at(F.create_map(*[F.lit(x) for a, i in ranks.items() for x in (a, i)]), F.col("_a")).alias("_class"),
        F.count(F.lit(1)).over(Window.partitionBy("_a")).alias("_m"),
        (F.row_number().over(Window.partitionBy("_a").orderBy("_s")) - 1).alias("_member"),
    )
    ranked = rank_in_group(rows, "_s", "_key", "_rank")
    ranked = ranked.join(F.broadcast(sources), "_s") if many <= BROADCAST else join_hot(ranked, sources, ["_s"], "_key", "inner")
    ranked = ranked.withColumn("block", F.floor(F.col("_rank") / block_rows)).withColumn("_nth", F.col("block") % F.col("_a") * F.col("_m") + F.col("_member"))
    schedule = period_schedule(docs.sparkSession, classes)
    placed = ranked.join(F.broadcast(schedule) if period <= BROADCAST else schedule, ["_class", "_nth"])
    placed = placed.withColumns({
        "slot": F.expr(f"block div _a * {period}L + _t"), "release": F.expr(f"block * {period}L div _a"),
        "deadline": F.expr(f"((block + 1) * {period}L + _a - 1) div _a"),
    })
    return positions(placed).select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "block", "release", "deadline", "slot", "position",
        (F.col("slot") < horizon).alias("in_mix"),
    )


#: Target weights of the registered query: src0 takes five parts, any other source one.
WEIGHTS = {"src0": 5}
BLOCK_ROWS = 16

ORACLE = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, md5(coalesce(cast(doc_id AS VARCHAR), '')) AS k FROM documents
), srcs AS (
  SELECT s, count(*) AS n, CASE WHEN s = '=src0' THEN 5 ELSE 1 END AS a FROM docs GROUP BY s
), lists AS (
  SELECT list(a ORDER BY a DESC, encode(s)) AS aa, list(n ORDER BY a DESC, encode(s)) AS nn, list(s ORDER BY a DESC, encode(s)) AS ss, cast(sum(a) AS BIGINT) AS q FROM srcs
), sim AS (
  SELECT -1::BIGINT AS t, [0::BIGINT for x in aa] AS seen, [0::BIGINT for x in aa] AS served, -1::BIGINT AS pick, aa, q FROM lists
  UNION ALL
  SELECT t + 1, served, list_transform(served, lambda v, j: v + CASE WHEN j = p THEN 1 ELSE 0 END), p, aa, q
  FROM (SELECT *, list_min(list_filter(list_transform(served, lambda v, j:
          {'d': cast(-floor(-((v + 1) * q) / aa[j]) AS BIGINT), 'j': j, 'r': cast(floor(v * q / aa[j]) AS BIGINT)}),
          lambda c: c.r <= t + 1)).j AS p FROM sim WHERE t + 1 < q)
), ranked AS (
  SELECT docs.*, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS r FROM docs
), placed AS (
  SELECT doc_id, source, r, r // 16 AS block, list_position(ss, s) AS i, aa, nn, q FROM ranked, lists
), slots AS (
  SELECT p.doc_id, p.source, p.r, p.block, p.aa, p.nn, p.q, p.i, sim.t, sim.seen, (p.block // p.aa[p.i]) * p.q + sim.t AS slot
  FROM placed p JOIN sim ON sim.pick = p.i AND sim.seen[p.i] = p.block % p.aa[p.i] WHERE sim.t >= 0
), ends AS (
  SELECT cast(floor(arg_min(n // 16, (n // 16) / a) * (SELECT q FROM lists) / arg_min(a, (n // 16) / a)) AS BIGINT) AS h FROM srcs
)
SELECT doc_id, source, cast(block AS BIGINT) AS block,
  cast(floor(block * q / aa[i]) AS BIGINT) AS release, cast(-floor(-((block + 1) * q) / aa[i]) AS BIGINT) AS deadline,
  cast(slot AS BIGINT) AS slot,
  cast(list_sum(list_transform(nn, lambda n, j: least(n, (((slot - t) // q) * aa[j] + seen[j]) * 16))) + r % 16 AS BIGINT) AS position,
  slot < h AS in_mix
FROM slots, ends
"""
