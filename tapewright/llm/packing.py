"""Harmonic packing of token sequences.

A document's ids are cut where that costs nothing: full sequences first, then
pieces of exactly floor(C / j) ids, the slot sizes of the reciprocal-capacity
classes 1/1, 1/2, 1/3, ..., until the rest fills its slot to within 1 part in
`slack`. A piece of class j goes into a bin of exactly j pieces of that class,
so a bin is full after a fixed count, whatever else happens: workers number
their pieces alone, from an exchange by (class, digest prefix of the id), and a
small table of counts per worker and class turns that into bin numbers.

Only the last, partly filled bin of each class is left over. These bins hold a
bounded number of pieces (fewer than sum over the slot sizes of C / size, about
21,000 for C = 4096), which are packed by first fit decreasing in one group.

With an order column the bins of a class are filled in that order instead of the
digest's, and sequences are numbered by the first position each holds, so that
sequences read in turn follow the order of the documents.

Tokens: words between white space are encoded once per distinct word and batch
(the vocabulary's pre-tokenizer never joins text over white space) and looked
up afterwards; word ids are gathered with numpy. The word table of a worker is
emptied at `WORDS_KEPT` entries.

Null text counts as empty and gives the single closing id. Rows that repeat an
id, or have none, are packed each. An empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import rank_in_group, written

CAPACITY = 4096
SLACK = 64
WORDS_KEPT = 600_000
_words: dict = {}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256 and up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_COMBINING = re.compile("[\u0300-\u036f]")
_MARK_AFTER_LETTER = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n])")


def _words_of(text: str) -> list[bytes]:
    """Chunks of a text that are encoded apart with the same result.

    Cuts at white space and between a letter or digit and a final mark. ASCII is
    lower-cased, as the vocabulary does, unless combining marks could compose.
    """
    if _COMBINING.search(text):
        return text.encode("utf-8", "surrogatepass").split()
    return _MARK_AFTER_LETTER.sub(rb" \1", text.encode("utf-8", "surrogatepass").lower()).split()


def _encode_words(words: list[bytes], tokenizer: str) -> dict[bytes, bytes]:
    """Ids of distinct words, as little-endian bytes.

    A word of lower-case Latin-1 letters is one pre-token that normalizing leaves
    as it is, so it goes straight to the vocabulary's merges.
    """
    whole, out, others = _tokenizer(tokenizer), {}, []
    merges = whole.model
    for w in words:
        t = w.decode("utf-8", "replace")
        if t.isalpha() and t.islower() and max(t) <= "\xff":
            mapped = t if t.isascii() else "".join([_LETTERS[b] for b in w])
            out[w] = array("I", [x.id for x in merges.tokenize(mapped)]).tobytes()
        else:
            others.append((w, t))
    for k in range(0, len(others), 10_000):
        part = others[k : k + 10_000]
        for (w, _), e in zip(part, whole.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
            out[w] = array("I", e.ids).tobytes()
    return out


def encode_texts(texts: list[str], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and the number of ids of each text."""
    known = _words.setdefault(tokenizer, {})
    if len(known) > WORDS_KEPT:
        known.clear()
    split = [_words_of(t) for t in texts]
    known.update(_encode_words(list(set().union(*split).difference(known)), tokenizer))
    ids_of = known.__getitem__
    raw = [b"".join(map(ids_of, ws)) for ws in split]
    return np.frombuffer(b"".join(raw), dtype=np.uint32), np.array([len(r) // 4 for r in raw], np.int64)


def cut_lengths(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    cuts = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        slot = capacity // (capacity // rest)
        if slot - rest <= rest // slack:
            cuts.append(rest)
            break
        size = capacity // (capacity // rest + 1)
        cuts.append(size)
        rest -= size
    return cuts


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, per_bin int"


def _cutter(tokenizer: str, end_id: int, capacity: int, slack: int, with_ids: bool, ordered: bool = False):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                places = part.column(2).to_pylist() if ordered else ids
                flat, counts = encode_texts(texts, tokenizer)
                cols: list[list] = [[] for _ in range(8)]
                at = 0
                for doc, place, n in zip(ids, places, counts.tolist()):
                    own = np.concatenate([flat[at : at + n], end])
                    at += n
                    raw, start = own.astype("<u4").tobytes(), 0
                    for size in cut_lengths(n + 1, capacity, slack):
                        values = (doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n + 1, capacity // size)
                        for c, v in zip(cols, values):
                            c.append(v)
                        cols[7].append(place)
                        if with_ids:
                            cols[6].append(own[start : start + size].astype(np.int32))
                        start += size
                arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.int32()])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "per_bin"]
                if with_ids:
                    arrays.append(pa.array(cols[6], pa.list_(pa.int32())))
                    names.append("ids")
                if ordered:
                    arrays.append(pa.array(cols[7], pa.int64()))
                    names.append("_position")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return cut


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, slack: int = SLACK,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, order_col: str | None = None,
) -> DataFrame:
    """The pieces of all documents; with `with_ids` also their token ids, with `order_col` its value as `_position`."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(order_col).cast("long")] if order_col else [])
    )
    schema = PIECES + (", ids array<int>" if with_ids else "") + (", _position long" if order_col else "")
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity, slack, with_ids, order_col is not None), schema)


def _first_fit(capacity: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        room: np.ndarray = np.zeros(0, np.int64)
        bins, offsets = [], []
        for n in pdf["length"].tolist():
            fits = np.flatnonzero(room >= n)
            if len(fits):
                k = int(fits[0])
            else:
                k, room = len(room), np.append(room, capacity)
            bins.append(k)
            offsets.append(capacity - int(room[k]))
            room[k] -= n
        return pdf.assign(sequence_id=np.array(bins, np.int64), offset=np.array(offsets, np.int64))

    return fit


def _place_key(pieces: DataFrame) -> Column:
    """A hex key in order of `_position`, spread over its first digits; pieces of a place go by start."""
    low, high = pieces.agg(F.min("_position"), F.max("_position")).first()
    span = (high or 0) - (low or 0) + 1
    # the first digits: position / span as a fraction of 16**7, in longs
    place = f"(_position - {low or 0}L)"
    spread = F.expr(f"{place} * {1 << 28}L div {span}L" if span < 1 << 35 else f"{place} div {-(-span >> 28)}L")
    return F.concat(*[F.lpad(F.hex(c), n, "0") for c, n in ((spread, 7), (F.col("_position") - (low or 0), 16), (F.col("start"), 16))])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, per_bin, ...).

    Pieces with a `_position` are packed in its order.
    """
    ordered = "_position" in pieces.columns
    columns = [c for c in pieces.columns if c != "_position"]
    # pieces with equal keys are equal in all their figures, so it is all one which of them comes first
    figures = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    key = _place_key(pieces) if ordered else F.md5(F.concat_ws("/", *figures))
    keyed = pieces.withColumn("_key", key)
    kept = keyed.columns if ordered else columns
    ranked = rank_in_group(keyed, "per_bin", "_key", "_rank")
    sizes = {r["per_bin"]: r["n"] for r in pieces.groupBy("per_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, base = {}, 0  # first sequence of each class; there are at most `capacity` classes
    for j in sorted(sizes):
        first[j] = base
        base += sizes[j] // j
    if not sizes:
        first, sizes = {1: 0}, {1: 0}
    start_of = F.create_map(*[F.lit(x) for j in first for x in (j, first[j])])
    full_of = F.create_map(*[F.lit(x) for j in first for x in (j, sizes[j] // j)])
    placed = ranked.withColumn("_bin", F.floor(F.col("_rank") / F.col("per_bin"))).withColumn(
        "_full", F.col("_bin") < F.element_at(full_of, F.col("per_bin"))
    )
    in_bin = Window.partitionBy("per_bin", "_bin").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        placed.where("_full")
        .withColumn("sequence_id", F.element_at(start_of, F.col("per_bin")) + F.col("_bin"))
        .withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    )
    left = placed.where("NOT _full").select(*kept)
    schema = StructType([*left.schema.fields]).add("sequence_id", "long").add("offset", "long")
    left = (
        left.groupBy(F.lit(0).alias("_one")).applyInPandas(_first_fit(capacity), schema)
        .withColumn("sequence_id", F.col("sequence_id") + base)
    )
    out = [*kept, "sequence_id", "offset"]
    both = full.select(*out).unionByName(left.select(*out))
    if not ordered:
        return both
    both = written(both, "packed").withColumnRenamed("sequence_id", "_bin")
    heads = both.groupBy("_bin").agg(F.min("_key").alias("_head")).withColumn("_all", F.lit(0))
    turns = rank_in_group(heads, "_all", "_head", "sequence_id").select("_bin", "sequence_id")
    return both.join(turns, "_bin").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Cut and pack; the pieces' figures are written once, so texts are encoded once."""
    return pack(written(cut_documents(docs, tokenizer, **options), "pieces"), options.get("capacity", CAPACITY))
