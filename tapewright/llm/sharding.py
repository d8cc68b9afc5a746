"""Sharding by histogram sort: equal bytes per shard, one exchange.

Rows are ordered by a 128-bit key: 64 hash bits of the text, so that equal
texts lie together, then 64 hash bits of the id. Splitters between shards are
found by counting: in each round every partition counts the exact bytes below
each probe key (numpy search in sorted probes), the counts are summed, and each
splitter's bracket shrinks to the two probes around its target. A bracket also
shrinks to the smallest and largest key that exist inside it, so a hot group of
equal texts is passed in one round and then divided by the id bits. A splitter
is accepted at the first text boundary within `tolerance` of its target, else
refined down to single rows; only groups larger than the tolerance are divided.

What the driver gathers per round is bounded: shards * probes * 3 numbers. The
keys (16 bytes and a size a row) are written once to the shared folder for the
rounds. With the splitters known, a row's shard is a column expression and all
rows are exchanged once, by shard and id-digest prefix, to get their slots.

Null texts have no bytes (size 8) and share a group with each other; rows that
repeat id and text have equal keys and stay in one shard. An empty table gives
an empty result. Further columns are carried, computed ones take precedence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, rank_in_group, written

TOP = 1 << 128


def _key_columns(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """The two key halves, as signed longs, and the size of a row."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    return F.xxhash64(F.lit(1), F.col(text_col)), F.xxhash64(F.lit(2), F.col(id_col)), size


def _wide(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Keys as 16 big-endian bytes, whose order is that of the 128-bit number."""
    flip = np.uint64(1 << 63)
    both = np.stack([hi.astype(np.int64).view(np.uint64) ^ flip, lo.astype(np.int64).view(np.uint64) ^ flip], axis=1)
    return both.astype(">u8").view("S16").ravel()


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(16, b"\0"), "big")


def _counter(probes: list[int]):
    """Per partition and interval between probes: bytes, smallest and largest key."""
    edges = np.array([p.to_bytes(16, "big") for p in probes], dtype="S16")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = np.zeros(len(edges) + 1, np.int64), {}, {}
        for batch in batches:
            hi, lo, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys = _wide(hi, lo)
            at = np.searchsorted(edges, keys, side="right")
            np.add.at(total, at, size)
            order = np.lexsort((keys, at))
            ats, ks = at[order], keys[order]
            first = np.flatnonzero(np.r_[True, ats[1:] != ats[:-1]]) if len(ats) else np.array([], np.int64)
            last = np.r_[first[1:] - 1, len(ats) - 1] if len(ats) else first
            for f, e in zip(first, last):
                i = int(ats[f])
                a, b = bytes(ks[f]).ljust(16, b"\0"), bytes(ks[e]).ljust(16, b"\0")
                low[i], high[i] = min(a, low.get(i, a)), max(b, high.get(i, b))
        used = sorted(low)
        yield pa.RecordBatch.from_pydict(
            {"bin": pa.array(used, pa.int32()), "bytes": pa.array([int(total[i]) for i in used], pa.int64()),
             "low": pa.array([low[i] for i in used], pa.binary()), "high": pa.array([high[i] for i in used], pa.binary())}
        )

    return count


def find_splitters(keys: DataFrame, shards: int, probes: int = 48, tolerance: float = 0.01) -> list[int]:
    """The shards - 1 keys at which a new shard begins; `keys` has (hi, lo, size)."""
    total = keys.agg(F.sum("size")).first()[0]
    if not total or shards < 2:
        return [TOP - 1] * (shards - 1)
    slack = max(1, int(tolerance * total / shards))
    targets = [round(total * i / shards) for i in range(1, shards)]
    # bracket of each splitter: keys lo <= splitter <= hi and the exact bytes below them
    brackets = [(0, 0, TOP, total) for _ in targets]
    done: dict[int, int] = {}
    while len(done) < len(targets):
        asked: set[int] = set()
        for i, (lo, _, hi, _) in enumerate(brackets):
            if i in done:
                continue
            step = hi - lo
            same = lo >> 64 == (hi - 1) >> 64
            for k in range(1, probes + 1):
                p = lo + step * k // (probes + 1)
                if not same and step >> 64 > probes:
                    p = p >> 64 << 64  # a text boundary
                if lo < p < hi:
                    asked.add(p)
            for edge in ((lo >> 64) + 1 << 64, hi - 1 >> 64 << 64):
                if lo < edge < hi:
                    asked.add(edge)
            asked.update(x for x in (lo, hi) if 0 < x < TOP)
        edges = sorted(asked)
        found = (
            keys.mapInArrow(_counter(edges), "bin int, bytes long, low binary, high binary")
            .groupBy("bin")
            .agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
            .collect()
        )
        inside = {r["bin"]: (r["bytes"], _number(bytes(r["low"])), _number(bytes(r["high"]))) for r in found}
        below, sums = 0, []
        for j in range(len(edges) + 1):
            sums.append(below)
            below += inside.get(j, (0,))[0]
        starts = [0, *edges]
        for i, want in enumerate(targets):
            if i in done:
                continue
            j = int(np.searchsorted(sums, want, side="right")) - 1  # the interval that holds the target
            while inside.get(j, (0,))[0] == 0 and j > 0 and sums[j] >= want:
                j -= 1
            lo, hi = starts[j], edges[j] if j < len(edges) else TOP
            a, b = sums[j], sums[j] + inside.get(j, (0,))[0]
            near, at = min((abs(a - want), lo), (abs(b - want), hi))
            if near <= slack:
                done[i] = min(at, TOP - 1)
                continue
            _, first, last = inside[j]
            if first == last:  # equal keys can't be divided
                done[i] = min(at, TOP - 1)
                continue
            brackets[i] = (max(lo, first), a, min(hi, last + 1), b)
    return sorted(done.values())


def shard_column(splitters: list[int], hi: Column, lo: Column) -> Column:
    """The shard of a row: how many splitters are at or below its key."""
    place = F.lit(0)
    for s in splitters:
        a, b = (s >> 64) - (1 << 63), (s & (1 << 64) - 1) - (1 << 63)
        place = place + F.when((hi > a) | ((hi == a) & (lo >= b)), 1).otherwise(0)
    return place.cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", probes: int = 48, tolerance: float = 0.01
) -> DataFrame:
    """`docs` with size, shard and slot (gapless from 0 in its shard)."""
    hi, lo, size = _key_columns(id_col, text_col)
    keys = written(docs.select(hi.alias("hi"), lo.alias("lo"), size.alias("size")), "shard-keys")
    splitters = find_splitters(keys, shards, probes, tolerance)
    placed = docs.drop("size", "shard", "slot", "_key").withColumns(
        {"size": size, "shard": shard_column(splitters, hi, lo), "_key": id_key(id_col)}
    )
    return rank_in_group(placed, "shard", "_key", "slot").drop("_key")
