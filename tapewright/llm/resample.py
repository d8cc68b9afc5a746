"""Importance resampling towards a target distribution over hashed n-grams.

A text is normalised to its lower-cased words with one space between them and
scanned once, which gives the running CRC of every prefix. The CRC of any n-gram
then follows from the prefixes at its two ends: CRC is linear over GF(2), so the
earlier prefix, shifted by the n-gram's length, cancels out of the later one, and
n-grams of all lengths cost the same two look-ups. All of it is done for a batch of
texts at once: lanes of LANE bytes run side by side through the byte table, a scan
over the lanes' ends joins them, and shifts go by tables of 8 bits of the length.

    gain(bucket) = floor(scale * ln((t+1)(S+B) / ((s+1)(T+B))))
    weight(doc)  = floor(mean gain of its features)
    score(doc)   = weight + floor(-scale * ln(-ln u)),   u from a digest of the id

so that the highest scores are a draw without replacement by weights (Gumbel's
trick), repeatable from the seed alone. Per batch only counts by bucket leave a
task, and the gains of at most `buckets` buckets are what goes to all tasks.
The draw needs no global sort: scores are integers within a range that their
formula bounds, so a histogram of them gives the cut, and only rows at or above
it are ranked.

Null texts and texts without words have no features and weight 0; they, and texts
of fewer than `min_words` words, are scored but not drawn. A null id is digested
as the empty string and comes last among ties. Rows that repeat an id are scored
each and, where also their scores tie, ranked in the order of the table. An
empty table gives an empty result, an empty target or source the gains that the
formula gives for no features. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
LANE = 256
#: Bytes of texts that are scanned together.
BATCH_BYTES = 2 << 20

_ONES = np.uint32(0xFFFFFFFF)
_POLY = 0xEDB88320  # the reflected polynomial of CRC-32, a fixed value
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    return t


def _times_byte(crc: np.ndarray) -> np.ndarray:
    """The register after one more zero byte."""
    return _byte_table()[crc & 255] ^ (crc >> np.uint32(8))


@lru_cache(maxsize=8)
def _shift_tables(level: int) -> np.ndarray:
    """[k, part, byte]: what a byte of the register becomes after k * 256**level zero bytes."""
    out = np.zeros((256, 4, 256), np.uint32)
    for part in range(4):
        out[0, part] = np.arange(256, dtype=np.uint32) << np.uint32(8 * part)
    for k in range(1, 256):
        before = out[k - 1]
        out[k] = _times_byte(before) if level == 0 else _apply(_whole_step(level), before)
    return out


@lru_cache(maxsize=8)
def _whole_step(level: int) -> np.ndarray:
    """[part, byte] for 256**level zero bytes: one more step than the level below goes."""
    below = _shift_tables(level - 1)
    return _apply(below[1], below[255])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> np.uint32(8) & 255] ^ table[2, crc >> np.uint32(16) & 255] ^ table[3, crc >> np.uint32(24)]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after as many further zero bytes as `lengths` says."""
    lengths, level = lengths.astype(np.int64), 0
    while len(lengths) and lengths.any():
        low, t = lengths & 255, _shift_tables(level)
        b = [crc >> np.uint32(8 * p) & np.uint32(255) for p in range(4)]
        crc = t[low, 0, b[0]] ^ t[low, 1, b[1]] ^ t[low, 2, b[2]] ^ t[low, 3, b[3]]
        lengths, level = lengths >> 8, level + 1
    return crc


def running_crcs(data: np.ndarray) -> np.ndarray:
    """The register (from 0) before each byte and after the last one: one pass in lanes, then a scan over their ends."""
    n = len(data)
    width = max(1, -(-n // LANE))
    lanes = np.zeros(width * LANE, np.uint8)
    lanes[:n] = data
    columns = np.ascontiguousarray(lanes.reshape(width, LANE).T).astype(np.uint32)
    table, crc, own = _byte_table(), np.zeros(width, np.uint32), np.zeros((LANE, width), np.uint32)
    for step in range(LANE):
        crc = table[(crc ^ columns[step]) & 255] ^ (crc >> np.uint32(8))
        own[step] = crc
    ends, d = crc.copy(), 1
    while d < width:  # ends[i] takes in the lanes before it, twice as many each time
        ends[d:] ^= shifted(ends[:-d], np.full(width - d, d * LANE, np.int64))
        d *= 2
    starts = np.concatenate([np.zeros(1, np.uint32), ends[:-1]])
    carried = starts
    for step in range(LANE):  # what came before a lane, moved on by its bytes so far
        carried = _times_byte(carried)
        own[step] ^= carried
    out = np.zeros(n + 1, np.uint32)
    out[1:] = own.T.reshape(-1)[:n]
    return out


def substring_crcs(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] from the registers at both places."""
    return running[ends] ^ shifted(running[starts] ^ _ONES, ends - starts) ^ _ONES


def features(texts: list[str | None], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of low to high words, the text of each, and the number of words of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    word = _WORD[data]
    ends_word = word[:-1] & ~word[1:]
    kept = word.copy()
    kept[1:] |= ends_word  # the separator after each word stays, as one space
    flat = np.where(word, data, np.uint8(32))[kept]
    inside = word[kept]
    turns = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    place = np.flatnonzero(kept)[starts] if len(starts) else starts  # where each word begins in the texts
    of = np.searchsorted(np.cumsum(lengths), place, side="right")
    running = running_crcs(flat)
    crcs, docs = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for n in range(low, high + 1):
        if len(starts) >= n:
            last = slice(n - 1, None)
            same = of[: len(of) - n + 1] == of[last]
            crcs.append(substring_crcs(running, starts[: len(starts) - n + 1][same], ends[last][same]))
            docs.append(of[last][same])
    return np.concatenate(crcs), np.concatenate(docs), np.bincount(of, minlength=len(texts))


def _batches(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of rows of about BATCH_BYTES; a longer text is one of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = 4 * len(t or "")
        if size and size + n > 4 * BATCH_BYTES:
            yield slice(first, k)
            first, size = k, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))


def bucket_counts(docs: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often the texts' features fall into each bucket that any falls into."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _batches(texts):
                found += np.bincount(features(texts[part], low, high)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(found[some])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """The gain of every bucket, from the counts of source and target: `buckets` numbers, whatever the input."""
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    sums = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    own = (F.col("t") + 1).cast("double") * F.lit(float(sums["S"] + buckets))
    other = (F.col("s") + 1).cast("double") * F.lit(float(sums["T"] + buckets))
    found = both.select("bucket", F.floor(F.lit(float(scale)) * F.log(own / other)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["gain"]
    return out


def weighted(
    docs: DataFrame, gain: np.ndarray, low: int = 1, high: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    buckets = np.uint32(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sums, counts, words = batch.column(1).to_pylist(), [], [], []
            for part in _batches(texts):
                own = texts[part]
                crcs, of, n_words = features(own, low, high)
                n = np.bincount(of, minlength=len(own))
                ends = np.cumsum(n)
                order = np.argsort(of, kind="stable")  # several lengths of run come one after the other
                total = np.concatenate([[0], np.cumsum(gain[crcs % buckets][order])])
                sums.append(total[ends] - total[ends - n])
                counts.append(n)
                words.append(n_words)
            if texts:
                n, s = np.concatenate(counts), np.concatenate(sums)
                weight = np.where(n > 0, s // np.maximum(n, 1), 0)
                arrays = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in (np.concatenate(words), n, weight))]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(weigh, f"`{id_col}` long, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int = SEED, scale: int = SCALE) -> Column:
    """floor(-scale * ln(-ln u)) of a digest of seed and id: between about -3.2 and 22.9 times scale."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id") -> DataFrame:
    """Add `rank`: 1, 2, 3, ... for the floor(percent * N / 100) highest scores of the N rows of enough words, else null.

    `scored` should be a stored table: its rows are read three times.
    """
    able = scored.where(F.col("n_words") >= min_words)
    tops = able.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))  # a row per integer score, of which the formula bounds the range
    upto = Window.orderBy(F.col("score").desc())
    cut = tops.select("score", F.sum("_n").over(upto).alias("_upto"), F.col("_n")).withColumn("_before", F.col("_upto") - F.col("_n"))
    wanted = able.count() * percent // 100
    heads = cut.where(F.col("_before") < wanted)
    least = heads.agg(F.min("score")).first()[0]
    keyed = scored.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    hit = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    # rows that share a score and an id are numbered within each part of the table first, so that no window holds all of them
    same = [F.col("score"), F.col(id_col), F.col("_part")]
    top = keyed.where(hit).withColumn("_in", F.row_number().over(Window.partitionBy(*same).orderBy("_place")))
    order = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = top.groupBy(*same).agg(F.count(F.lit(1)).alias("_m"))
    starts = starts.select(*same, F.coalesce(F.sum("_m").over(order), F.lit(0)).alias("_ids_before")).join(heads.select("score", "_before"), "score")
    starts = starts.select(F.col("score").alias("_s"), F.col(id_col).alias("_i"), F.col("_part").alias("_p"), (F.col("_before") + F.col("_ids_before")).alias("_start"))
    matched = (F.col("score") == F.col("_s")) & F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_part") == F.col("_p"))
    ranked = top.join(starts, matched).withColumn("rank", F.col("_start") + F.col("_in"))
    out = [*scored.columns, "rank"]
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = keyed.where(~F.coalesce(hit, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out).unionByName(rest.select(*out))


def resampled(
    docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """Every row's (id, n_words, n_features, weight, score, rank); `target` has a text column of the same name."""
    scratch = scratch or Scratch(docs.sparkSession)
    gain = gains(bucket_counts(docs, low, high, buckets, text_col), bucket_counts(target, low, high, buckets, text_col), buckets)
    found = weighted(docs, gain, low, high, id_col, text_col).withColumn("score", F.col("weight") + gumbel(id_col, seed))
    return drawn(scratch.written(found, "scored"), percent, min_words, id_col)


#: CRC-32 by its byte table, on distinct words; all else as the operator's docstring says.
ORACLE = r"""
WITH bits AS (SELECT range AS b, range AS c0 FROM range(256)),
tbl AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([c0, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM bits)),
words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
flat AS (SELECT doc_id, unnest(ws) AS w FROM words),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(w)) + 1),
        lambda i: CAST('0x' || hex(encode(w))[2 * i - 1 : 2 * i] AS BIGINT))),
        lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM (SELECT w FROM flat UNION ALL SELECT w FROM target)), tbl),
s AS (SELECT bucket, COUNT(*) AS s FROM flat JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, COUNT(*) AS t FROM target JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) AS DOUBLE) * ((SELECT coalesce(SUM(s), 0) FROM s) + 10000)
        / (CAST((coalesce(s, 0) + 1) AS DOUBLE) * ((SELECT coalesce(SUM(t), 0) FROM t) + 10000)))) AS BIGINT) AS g
    FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, CAST(floor(SUM(g) / CAST(COUNT(*) AS DOUBLE)) AS BIGINT) AS weight
    FROM flat JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE)
        / 4294967296))) AS BIGINT) AS score FROM words LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
    COUNT(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""
