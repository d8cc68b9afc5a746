"""Alignment of two tokenizers' tokens over the same bytes.

Both encode a space and the text. Their tokens' byte ends lie on one line, on which
the texts of a batch follow each other, and are merged in lockstep: one NumPy state
vector holds a pair of pointers (A, B) for each lane, a document or, of long ones, a
stretch of LANE bytes. Each step emits the link of every lane's two open tokens,
marks a cut where both end, advances the pointer whose token ends first (both at a
cut), and compacts the lanes that are finished. A lane starts at the tokens that
cover its first byte and owns the links that end inside it, so stretches need no cut
between them. A link that ends at a byte exists once, so lanes neither lose nor
repeat any.

Links are counted by documents, per pair of ids: each document's distinct pairs and
how often it holds them are written once and unfolded by Spark. The table of pairs
grows with the vocabularies, not with the documents; it is broadcast only if it
counts at most PAIRS rows, and joined by a shuffle otherwise.

Texts null or empty, and those that either tokenizer does not give back byte by byte,
have no tokens: all their figures are 0 and their digest is the empty string. Rows
that repeat an id, or have none, are documents of their own. An empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .tokens import byte_bpe, piece_bpe

LANE = 1024
#: Characters of text merged together; a longer text is a batch of its own.
BATCH = 1 << 20
#: Pairs of ids up to which their counts are broadcast.
PAIRS = 2_000_000


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, borders: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links of a batch in order: indices of the A token, the B token, the document, and whether both end.

    `borders` are the bytes between the documents, from 0 to the last end; no
    document is empty.
    """
    last = np.iinfo(np.int64).max
    ends_a, ends_b = np.append(ends_a, last), np.append(ends_b, last)
    counts = -(-np.diff(borders) // lane)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    begin = borders[doc_of] + lane * (np.arange(len(doc_of)) - first[doc_of])
    stop = np.minimum(begin + lane, borders[doc_of + 1])
    a, b = np.searchsorted(ends_a, begin, "right"), np.searchsorted(ends_b, begin, "right")
    live, steps = np.arange(len(doc_of)), []
    while len(live):
        end_a, end_b = ends_a[a], ends_b[b]
        inside = np.minimum(end_a, end_b) <= stop
        if not inside.all():  # finished lanes go
            a, b, stop, live, end_a, end_b = a[inside], b[inside], stop[inside], live[inside], end_a[inside], end_b[inside]
        cut = end_a == end_b
        steps.append((a, b, live, cut))
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
    of_a, of_b, lanes, cuts = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    n = np.bincount(lanes, minlength=len(doc_of))
    at = (np.cumsum(n) - n)[lanes] + np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])  # lanes side by side become lanes in turn
    out_a, out_b, docs, out_cut = np.empty_like(of_a), np.empty_like(of_b), np.empty_like(lanes), np.empty_like(cuts)
    out_a[at], out_b[at], docs[at], out_cut[at] = of_a, of_b, doc_of[lanes], cuts
    return out_a, out_b, docs, out_cut


_POWERS = np.array([10**k for k in range(6, -1, -1)], np.int64)


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` for every document: all bytes, and how many each document has.

    Groups are numbered through the batch and end in the order of their tokens.
    """
    n_a, n_b = np.bincount(group_a, minlength=len(doc_of_group)), np.bincount(group_b, minlength=len(doc_of_group))
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + (before_a + n_a)[group_b]
    ids, mark = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    ends_a, ends_b = before_a + n_a + before_b - 1, before_a + n_a + before_b + n_b - 1
    mark[ends_a], mark[ends_b] = ord("|"), ord(";")
    doc_of = np.zeros(len(ids), np.int64)
    doc_of[at_a], doc_of[at_b] = doc_of_group[group_a], doc_of_group[group_b]
    digits = np.empty((len(ids), len(_POWERS) + 1), np.uint8)
    shown = np.ones(digits.shape, bool)
    for k, power in enumerate(_POWERS):
        digits[:, k] = ids // power % 10 + 48
        if power > 1:
            shown[:, k] = ids >= power
    digits[:, -1] = mark
    last = np.flatnonzero(np.diff(doc_of, append=-1) != 0)  # no mark behind a document's last token
    shown[last, -1] = False
    return digits[shown], np.bincount(doc_of, weights=shown.sum(axis=1)).astype(np.int64)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > BATCH:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
SCHEMA = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,n:int>>"


def _aligner(path_a: str, path_b: str):
    def align(texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], pa.Array]:
        coder_a, coder_b = byte_bpe(path_a), piece_bpe(path_b)
        held, ids_a, ids_b, sizes = [], [], [], []
        for k, text in enumerate(texts):
            if text:
                raw, a, b = (" " + text).encode(), coder_a.encode(" " + text), coder_b.encode(text)
                if all(b"".join(map(c.bytes_of.__getitem__, x.tolist())) == raw for c, x in ((coder_a, a), (coder_b, b))):
                    held.append(k), ids_a.append(a), ids_b.append(b), sizes.append(len(raw))
        out = {c: np.zeros(len(texts), np.int64) for c in FIGURES}
        digests, starts = [""] * len(texts), np.zeros(len(texts) + 1, np.int64)
        a = b = n = np.zeros(0, np.int64)
        if held:
            docs = np.array(held)
            flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
            of_a, of_b, doc, cut = lockstep(
                np.cumsum(coder_a.lengths[flat_a]), np.cumsum(coder_b.lengths[flat_b]), np.concatenate([[0], np.cumsum(sizes)])
            )
            out["n_a"][docs], out["n_b"][docs] = [len(x) for x in ids_a], [len(x) for x in ids_b]
            out["n_links"][docs] = np.bincount(doc, minlength=len(docs))
            out["n_groups"][docs] = np.bincount(doc[cut], minlength=len(docs))
            group = np.cumsum(cut) - cut  # of each link
            group_a, group_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
            group_a[of_a], group_b[of_b] = group, group
            text, lengths = written_groups(flat_a, flat_b, group_a, group_b, doc[cut])
            view, at = memoryview(text), 0
            for k, size in zip(held, lengths.tolist()):
                digests[k] = hashlib.sha256(view[at : at + size]).hexdigest()
                at += size
            pairs = (doc * len(coder_a.lengths) + flat_a[of_a]) * len(coder_b.lengths) + flat_b[of_b]
            found, n = np.unique(pairs, return_counts=True)
            rest, b = np.divmod(found, len(coder_b.lengths))
            own, a = np.divmod(rest, len(coder_a.lengths))
            starts[docs + 1] = np.bincount(own, minlength=len(docs))
            starts = np.cumsum(starts)
        fields = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a, b, n)], ["a", "b", "n"])
        return out, digests, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for first, end in _batches(texts):
                found, digests, links = align(texts[first:end])
                own = batch.slice(first, end - first)
                arrays = [own.column(0), own.column(1), *(pa.array(found[c]) for c in FIGURES), pa.array(digests, pa.string()), links]
                yield pa.RecordBatch.from_arrays(arrays, ["_row", "doc_id", *FIGURES, "groups_sha256", "links"])

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: figures, the digest of its groups, and its distinct linked pairs of ids with their numbers."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_aligner(path_a, path_b), SCHEMA)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many documents a pair is linked, and whether no partner of `a` has more."""
    pairs = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))
    most = pairs.groupBy("a").agg(F.max("docs").alias("_most"))
    return pairs.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def align_corpus(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = PAIRS, scratch: Scratch | None = None
) -> DataFrame:
    """`aligned`, with n_best and count_sum from the counts of all documents in place of the links."""
    scratch = scratch or Scratch(docs.sparkSession)
    own = scratch.written(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    links = own.select("_row", F.inline("links"))
    pairs = scratch.written(pair_counts(links), "pairs")
    if pairs.count() <= most_pairs:
        pairs = F.broadcast(pairs)
    sums = links.join(pairs, ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("docs")).cast("long").alias("count_sum")
    )
    return own.drop("links").join(sums, "_row", "left").na.fill(0, ["n_best", "count_sum"]).drop("_row")
