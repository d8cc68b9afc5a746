"""Sliding windows per key in Arrow batches: sums and ends of all windows of a batch at once, order statistics as a sorted window that gains and loses one value a row."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATISTICS = ["_held", "_below", "_upto", "_middle", "_low", "_high"]


class SortedWindow:
    """The values at the last `n` positions in order; nulls take a position and no value."""

    def __init__(self, n: int):
        self.n = n
        self.queue: deque[tuple[int, float]] = deque()
        self.ordered: list[float] = []

    def move(self, place: int, value: float | None) -> None:
        """Go on to a position, not before the last one, that adds a value or none."""
        while self.queue and self.queue[0][0] <= place - self.n:
            del self.ordered[bisect_left(self.ordered, self.queue.popleft()[1])]
        if value is not None:
            self.queue.append((place, value))
            insort(self.ordered, value)

    def middle(self) -> float | None:
        k = len(self.ordered)
        return (self.ordered[(k - 1) // 2] + self.ordered[k // 2]) / 2 if k else None


def in_order(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """`df` with the rows of a key together in one part and in their order, and `_nth`, their numbers.

    A window asks for both, so they also hold after Spark changes the plan while it runs. A repartition before an Arrow map
    asks for nothing: it is left out above a union whose sides lie by the key, and the sides are then merged into unequal parts.
    """
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def order_statistics(df: DataFrame, col: str, n: int, key: str = "symbol", order: tuple[str, ...] = ("date",), place: str | None = None) -> DataFrame:
    """`df` with _held, _below, _upto, _middle, _low and _high: of the values of `col` in the last n rows of a key (with `place`, at the
    last n integers of that column) how many there are, how many are below and how many at most the row's own (null if
    that is null), their median and their ends.

    Each key's rows stream through one task in their order, as in a window; what is
    held is one window, and a row costs a search in it instead of a list of n values.
    """
    schema = StructType([*df.schema.fields])
    for name, kind in zip(STATISTICS, ("integer", "integer", "integer", "double", "double", "double")):
        schema.add(name, kind)
    kinds = [pa.int32()] * 3 + [pa.float64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, window = object(), 0, SortedWindow(n)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            values = [None if v is None else float(v) for v in batch.column(col).to_pylist()]
            places = batch.column(place).to_pylist() if place else [None] * len(values)
            for k, v, at in zip(batch.column(key).to_pylist(), values, places):
                if k != now:
                    now, row, window = k, 0, SortedWindow(n)
                row += 1
                window.move(row if at is None else at, v)
                known = v is not None
                own = window.ordered
                found = (len(own), bisect_left(own, v) if known else None, bisect_right(own, v) if known else None, window.middle(), own[0] if own else None, own[-1] if own else None)
                for c, x in zip(out, found):
                    c.append(x)
            arrays = [*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], *STATISTICS])

    return in_order(df, key, order).mapInArrow(run, schema)


def _windows(padded: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(padded, n)


def _reduce(kind: str, values: np.ndarray, known: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
    """The statistic of each window of n places, over the places that are known."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if kind in ("max", "min"):
            nan = np.isnan(values) & known
            fill = -np.inf if kind == "max" else np.inf
            clean = np.where(known & ~(nan if kind == "min" else False), values, fill)  # NaN is greater than any number
            found = _windows(clean, n).max(axis=1) if kind == "max" else _windows(clean, n).min(axis=1)
            return np.where(_windows(nan, n).sum(axis=1) == count, np.nan, found) if kind == "min" and nan.any() else found
        zeroed = np.where(known, values, 0.0)
        total = np.zeros(len(count))
        for k in range(n):  # oldest first, as a window sums: means that tie there tie here
            total += zeroed[k:k + len(count)]
        mean = total / count
        if kind == "avg":
            return mean
        away = (_windows(zeroed, n) - mean[:, None]) * _windows(known, n)
        return np.sqrt(np.einsum("ij,ij->i", away, away) / (count - 1))


def rolled(df: DataFrame, columns: dict[str, tuple[str, str, int, int]], key: str = "symbol", order: tuple[str, ...] = ("date",)) -> DataFrame:
    """`df` with rolling columns {name: (kind, column, n, least)}: the avg, max, min or stddev (of a sample) of a column over the last n rows
    of a key, null with fewer than `least` known values (or, for stddev, than two).

    Each key's rows stream through one task in their order, as in a window; what is
    held is a batch and the last rows before it. Every window is summed up by itself, so
    that equal windows have equal values.
    """
    longest = max(n for _, _, n, _ in columns.values())
    sources = list(dict.fromkeys(c for _, c, _, _ in columns.values()))
    schema = StructType([*df.schema.fields])
    for name in columns:
        schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, {c: (np.empty(0), np.empty(0, bool)) for c in sources}
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, max(whole.num_rows, 1), 4096)):
                size = batch.num_rows
                if not size:
                    continue
                keys = batch.column(key).dictionary_encode()
                codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                part = np.zeros(size, int)
                part[starts[1:]] = 1
                part = np.cumsum(part)
                goes_on = last is not None and batch.column(key)[0].as_py() == last[0]
                held = {}
                for c in sources:
                    column = batch.column(c)
                    known = np.asarray(column.is_valid())
                    values = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                    had = before[c] if goes_on else (np.empty(0), np.empty(0, bool))
                    held[c] = (values, known, had)
                    tail = starts[-1]
                    kept = (values[tail:], known[tail:])
                    if tail == 0:
                        kept = (np.r_[had[0], values], np.r_[had[1], known])
                    before[c] = (kept[0][-(longest - 1):].copy(), kept[1][-(longest - 1):].copy()) if longest > 1 else (np.empty(0), np.empty(0, bool))
                last = (batch.column(key)[size - 1].as_py(),)
                made = []
                for kind, c, n, least in columns.values():
                    values, known, had = held[c]
                    gap = n - 1
                    at = np.arange(size) + (part + 1) * gap
                    padded, there = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1, bool)
                    padded[at], there[at] = values, known
                    carried = min(gap, len(had[0]))
                    if carried:
                        padded[gap - carried:gap], there[gap - carried:gap] = had[0][-carried:], had[1][-carried:]
                    sums = np.r_[0, np.cumsum(there)]
                    count = sums[n:] - sums[:-n]
                    found = _reduce(kind, padded, there, n, count)[at - gap]
                    made.append(pa.array(found, mask=count[at - gap] < max(least, 2 if kind == "stddev" else 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *columns])

    return in_order(df, key, order).mapInArrow(run, schema)
