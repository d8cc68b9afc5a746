"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index. Centroids are fitted by k-means to a bounded sample (at most SAMPLE
vectors, by a hash of the id); every vector is indexed. A vector
is stored with the list of its nearest centroid: its residual is normalised,
rotated by one random orthogonal matrix and reduced to the signs of its D
components (packed bits), with two scalars beside it, the residual's norm and
the inner product of the code with the residual itself.

Search. Every query is held against the codes of all lists: no list is left
out, so that neighbours in far lists are found too. The inner products with all
codes are estimated from the packed bits and corrected by the scalars; the
estimate's error is at most EPSILON / sqrt(D - 1) * sqrt(1 / x**2 - 1), x being
the stored inner product, but for a tail that EPSILON makes small. The k vectors
of a task's first block with the smallest upper bounds are measured; those whose lower bound
exceeds the largest of these distances are dropped, the others are reranked by
exact distance in double precision. A task carries the best k of each query from
one block of rows to the next, so that the bounds are held against ever smaller
distances, and gives them out once at its end.

Queries are taken in blocks of about QUERIES by hashes of their ids. The vectors of
one block go to every task (at 64 dimensions 2 MB, whatever the input), which scan
the stored index where it lies: rows are not shuffled, only each task's k nearest
are. Code comparisons are rows times queries. What the driver gathers is bounded:
the sample, and one block of queries at a time.

Vectors that are null, zero, of another length than most of the sample, or hold
null or non-finite components take no part, nor do null ids. Of equal distances
the smaller id comes first. An empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .common import bounded_sample

SAMPLE = 65_536
LISTS = 1024
ROWS, QUERIES = 8192, 4096
EPSILON = 3.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        at = nearest_lists(x, c)
        n = np.bincount(at, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_lists(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Per row of x the nearest centroid, in blocks of rows."""
    own = (centroids**2).sum(1)
    out = np.zeros(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (own - 2 * x[k : k + 4096] @ centroids.T).argmin(1)
    return out


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centroids: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual norms and code-residual inner products."""
    residual = x - centroids
    norm = np.sqrt((residual**2).sum(1))
    unit = (residual / np.where(norm > 0, norm, 1)[:, None]) @ rotate.T
    inner = np.abs(unit).sum(1) / math.sqrt(x.shape[1])
    return np.packbits(unit > 0, axis=1), norm, np.where(norm > 0, inner, 1.0)


def bounds(
    bits: np.ndarray, norm: np.ndarray, inner: np.ndarray, q: np.ndarray, centroids: np.ndarray, rotate: np.ndarray, at: np.ndarray | None = None
):
    """Lower and upper bounds of squared distances, queries by rows.

    `centroids` is one centroid, or several with `at` naming that of each row.
    """
    dim, c = q.shape[1], np.atleast_2d(centroids)
    at = np.zeros(len(norm), np.int64) if at is None else at
    signs = 2.0 * np.unpackbits(bits, axis=1, count=dim) - 1
    # the code's product with a rotated residual q - c is its product with q less that with c
    own = np.einsum("rd,rd->r", signs, (c @ rotate.T)[at])
    product = ((q @ rotate.T) @ signs.T - own) / math.sqrt(dim) / inner  # of q's residual with the unit residual
    size = (q**2).sum(1)[:, None] + (c**2).sum(1)
    q_square = np.maximum(size - 2 * q @ c.T, 0)[:, at]
    error = np.sqrt(q_square) * (EPSILON / math.sqrt(max(dim - 1, 1)) * np.sqrt(np.maximum(1 / inner**2 - 1, 0)))
    base = norm**2 + q_square
    slack = 1e-5 * base + 1e-12 * size[:, at]
    return base - 2 * norm * (product + error) - slack, base - 2 * norm * (product - error) + slack


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _searcher(k: int, centroids: np.ndarray, rotate: np.ndarray, all_q: np.ndarray, q: np.ndarray):
    """Holds the queries (ids, vectors) against all rows of a task; gives the k nearest of each that the task has."""
    dim = centroids.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, found = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)  # so far, in order
        for rows in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            ids, x = rows["vec_id"].to_numpy(), _matrix(rows["v"], dim).astype(np.float64)
            bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
            present, at = np.unique(rows["list"].to_numpy(), return_inverse=True)
            norm, inner = rows["norm"].to_numpy(), rows["inner"].to_numpy()
            for s in range(0, len(q), 64):
                low, high = bounds(bits, norm, inner, q[s : s + 64], centroids[present], rotate, at)
                for j in np.flatnonzero(low.min(axis=1) <= square[s : s + 64, k - 1]):
                    i, other = s + j, ids != all_q[s + j]
                    limit = square[i, k - 1]
                    if limit == np.inf and other.sum() > k:  # nothing to go by yet: measure what must be near
                        some = np.argpartition(np.where(other, high[j], np.inf), k - 1)[:k]
                        limit = ((x[some] - q[i]) ** 2).sum(1).max()
                    near = np.flatnonzero((low[j] <= limit) & other)
                    d = np.concatenate([square[i], ((x[near] - q[i]) ** 2).sum(1)])
                    who = np.concatenate([found[i], ids[near]])
                    first = np.lexsort((who, np.sqrt(d)))[:k]
                    square[i], found[i] = d[first], who[first]
        held = square < np.inf
        arrays = [np.repeat(all_q, held.sum(axis=1)), found[held], np.sqrt(square[held])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], ["query_id", "vec_id", "score"])

    return search


def _indexer(centroids: np.ndarray, rotate: np.ndarray):
    dim = centroids.shape[1]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype(np.float64)
            at = nearest_lists(x, centroids)
            bits, norm, inner = encode(x, centroids[at], rotate)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()),
                 pa.array(norm), pa.array(inner)],
                ["vec_id", "v", "list", "bits", "norm", "inner"],
            )

    return index


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, rows_per_list: int = 256, sample: int = SAMPLE,
    id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance.

    `queries` has the same columns as `vectors`; a row of the query's own id is no candidate.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col).withColumnRenamed("vec_id", "query_id")
    drawn = bounded_sample(rows, "vec_id", sample)
    lengths = drawn.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dim = lengths["dim"]
    x = _matrix(drawn.where(F.size("v") == dim).orderBy("vec_id").select(F.col("v").cast("array<float>")).toArrow().column(0), dim).astype(np.float64)
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    total = rows.count()
    lists = max(1, min(LISTS, len(x), total // rows_per_list))
    centroids, rotate = kmeans(x, lists), rotation(dim)
    scratch = scratch or Scratch(spark)
    kept = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    schema = f"vec_id long, v {kept}, list int, bits binary, norm double, inner double"
    index = scratch.written(rows.withColumn("v", F.col("v").cast(kept)).mapInArrow(_indexer(centroids, rotate), schema), "index")
    blocks = -(-asked.count() // QUERIES) or 1
    found = []
    for n in range(blocks):  # a block's vectors go to all tasks; rows stay where they are
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        search = _searcher(k, centroids, rotate, block.column("query_id").to_numpy(), _matrix(block.column("v"), dim))
        found.append(index.mapInArrow(search, "query_id long, vec_id long, score double"))
        if blocks > 1:
            found[-1] = scratch.written(found[-1], "found")
    found = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
