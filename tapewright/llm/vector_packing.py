"""Packing whole documents by vector best fit.

A bin (sequence) has three residual capacities: tokens, documents, and attention
cost (the sum of squared lengths, which is what attention inside documents costs).
A piece asks for a vector of the same three. Pieces are taken largest first; of the
open bins that satisfy every constraint the piece goes to the one with

    norm   the smallest weighted norm of what would be left over (packs tightest)
    dot    the largest weighted dot-product of demand and residual (fills the
           scarce capacities evenly)

and opens a bin where none has room. Documents are cut only where they are longer
than a sequence: the first piece takes the remainder, all others are full. A full
piece is a sequence of its own and takes no part in the search. The others are dealt
evenly, by their places in the written table of pieces and whatever their ids, to
groups of about `GROUP` pieces, which are packed independently; each group leaves at
most a few bins open, so the number of sequences differs from that of one search
over all pieces by a fraction of a per cent, and the work of a task is bounded.

Defaults for documents and cost (`capacity` and its square) never bind, since each
document has a token at least. A null text counts as empty and gives the closing id
alone. Rows that repeat an id, or have none, are packed each. An empty table gives
an empty result; further columns are not read. A piece that violates a constraint
even in an empty bin raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .tokens import byte_bpe

CAPACITY = 1024
#: Pieces that are searched together.
GROUP = 8192
#: Weights of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.0625, 0.0625)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Where the pieces of a document of n ids begin, and n: the first piece takes the remainder."""
    return [0, *range(n % capacity or capacity, n, capacity), n]


def _cutter(tokenizer: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_bpe(tokenizer), np.array([end_id], np.uint32)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([coder.encode(text or ""), end])
                raw, cuts = memoryview(ids.astype("<u4").tobytes()), cut_points(len(ids), capacity)
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    for c, v in zip(cols, (doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity), PIECES)


def vector_best_fit(demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each row of `demands`, which are placed in their order."""
    x, n = demands / capacities, len(demands)
    over = (demands > capacities).any(axis=1)
    if over.any():
        raise ValueError(f"{int(over.sum())} pieces exceed a capacity by themselves")
    least = np.minimum.accumulate(demands[::-1], axis=0)[::-1]  # the smallest demand still to come, in each dimension
    room, name = np.zeros((n, demands.shape[1])), np.zeros(n, np.int64)  # open bins: residuals and numbers
    held, made, bins = 0, 0, np.zeros(n, np.int64)
    for i in range(n):
        if i % 256 == 0 and held:  # bins without room for anything to come are closed
            live = (room[:held] >= least[i]).all(axis=1)
            kept = int(live.sum())
            room[:kept], name[:kept], held = room[:held][live], name[:held][live], kept
        own = room[:held]
        fits = np.flatnonzero((own >= demands[i]).all(axis=1))
        if len(fits):
            left = own[fits] / capacities
            if rule == "norm":
                k = fits[np.argmin((left - x[i]) ** 2 @ weights)]
            elif rule == "dot":
                k = fits[np.argmax(left @ (weights * x[i]))]
            else:
                raise ValueError(f"no rule {rule!r}")
        else:
            k = held
            room[k], name[k], held, made = capacities, made, held + 1, made + 1
        room[k] -= demands[i]
        bins[i] = name[k]
    return bins


def _packer(capacities: np.ndarray, weights: np.ndarray, rule: str):
    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        n = pdf["length"].to_numpy(np.float64)
        bins = vector_best_fit(np.stack([n, np.ones(len(n)), n * n], axis=1), capacities, weights, rule)
        pdf["sequence_id"] = (pdf.pop("_group").to_numpy(np.int64) << 32) + bins
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf

    return pack_group


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None, max_cost: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP,
) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces. Sequences of one full piece have negative numbers."""
    most = max_documents or capacity, float(max_cost or capacity * capacity)
    if most[0] < 1 or most[1] < capacity * capacity:
        raise ValueError("a full piece must satisfy every constraint: it is a sequence of its own")
    placed = pieces.withColumn("_place", F.monotonically_increasing_id())
    full = placed.where(F.col("length") == capacity)
    full = full.select(*pieces.columns, (-1 - F.col("_place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = placed.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.select(*pieces.columns, F.pmod("_place", F.lit(groups)).alias("_group"))
    fit = _packer(np.array([capacity, *most], np.float64), np.array(weights), rule)
    packed = dealt.groupBy("_group").applyInPandas(fit, f"{PIECES}, sequence_id long, offset long")
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, scratch: Scratch | None = None, **options) -> DataFrame:
    """Cut and pack; the pieces' figures are written once, so texts are encoded once."""
    scratch = scratch or Scratch(docs.sparkSession)
    pieces = scratch.written(cut_documents(docs, tokenizer, end_id, capacity), "cut")
    return pack(pieces, capacity, **options)
