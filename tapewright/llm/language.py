"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features of a whole text: its lower-cased 1-, 2- and 3-grams of code points,
hashed to FEATURES buckets; weight (1 + log count) * idf, scaled to length 1.
Document frequencies are counted over all training rows. Weights are learned by
follow-the-regularised-leader with elastic-net penalties, so most stay exactly
zero, over a bounded sample: FIT_ROWS in equal parts for the languages, which are
counted over all training rows, but LEAST_ROWS of each at least, chosen by a hash
of the id. So a rare language is learned at any size of the table. Every fifth row
of a language is left out and fits the temperature by which scores are calibrated.

Rows without a language or without a letter are not learned from. Texts that are null or have no
letter get `und` with score 0; if nothing could be learned, so do all. Ties go
to the language first in order of name. Further columns are carried, but columns named
`lang_pred` and `score` are replaced by the prediction's. Weights are languages times
FEATURES doubles, so memory grows with the number of languages, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 15
FIT_ROWS = 6000
LEAST_ROWS = 100
_C = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)]


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter (Unicode category L)."""
    return any(map(str.isalpha, text or ""))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the hashed n-grams of one whole text."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h1 = cp * _C[0]
    h2 = (h1[:-1] ^ np.uint32(0x5BD1E995)) * _C[1] + cp[1:] * _C[2]
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(15))) * _C[0] + cp[2:] * _C[1]
    total = np.zeros(FEATURES, np.int64)
    for h in (h1, h2, h3):
        if len(h):
            total += np.bincount((h ^ (h >> np.uint32(13))) >> np.uint32(17), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                total[features(text)[0]] += 1
                n += 1
    total[FEATURES] = n  # the number of documents
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(t if has_letter(t) else None) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32()))],
            ["id", "lang", "at", "counts"],
        )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05, epochs=2, seed=3) -> np.ndarray:
    """Weights (FEATURES + 1, classes); the last row is the bias."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(FEATURES + 1))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by a search over a log scale."""

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    return float(min(grid, key=loss)) if len(y) else 1.0


def sampled(own: DataFrame, rows: int) -> DataFrame:
    """Rows (_id, _lang, _text) by a hash of the id, about as many of each language; all of it where there are fewer."""
    counts = own.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    langs = counts.count()
    share = counts.select("_lang", (F.lit(max(LEAST_ROWS, rows // max(langs, 1))) / F.col("_n")).alias("_share"))
    place = F.pmod(F.xxhash64(F.lit(17), F.col("_id")), F.lit(1 << 40)) / F.lit(1 << 40)
    return own.join(F.broadcast(share) if langs <= 10_000 else share, "_lang").where(place < F.col("_share")).select("_id", "_lang", "_text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> dict:
    """Learn from the rows of `docs` that name a language and hold a letter."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where("_lang IS NOT NULL")
    df = own.select("_text").mapInArrow(_document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES + 1)
    counts[df["feature"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    sample = sampled(own, rows).mapInArrow(_sparse_rows, "id long, lang string, at array<int>, counts array<int>").toPandas()
    sample = sample[sample["at"].map(len) > 0].sort_values("id", kind="stable")
    langs = sorted(sample["lang"].unique())
    index = {v: i for i, v in enumerate(langs)}
    data = [(np.asarray(a), weighted(np.asarray(a), np.asarray(c), idf), index[v]) for a, c, v in zip(sample["at"], sample["counts"], sample["lang"])]
    turn = sample.groupby("lang").cumcount().to_numpy() % 5
    if not data:
        return {"langs": [], "idf": idf, "weights": np.zeros((FEATURES + 1, 0)), "temperature": 1.0}
    weights = ftrl([r for r, k in zip(data, turn) if k != 4], len(langs))
    held = [r for r, k in zip(data, turn) if k == 4] or data
    scores = np.array([x @ weights[at] + weights[-1] for at, x, _ in held])
    return {"langs": langs, "idf": idf, "weights": weights, "temperature": temperature(scores, np.array([y for _, _, y in held]))}


def predicted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and its calibrated score."""
    langs, idf, heat = model["langs"], model["idf"], model["temperature"]
    weights = model["weights"]
    used = np.flatnonzero((weights[:-1] != 0).any(1))  # the penalties leave few; send only those
    small, bias = weights[used].astype(np.float32), weights[-1]

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        full = np.zeros((FEATURES, len(langs)))
        full[used] = small
        names, scores = [], []
        for t in texts:
            if not langs or not has_letter(t):
                names.append("und")
                scores.append(0.0)
                continue
            at, counts = features(t)
            s = (weighted(at, counts, idf) @ full[at] + bias) / heat
            p = np.exp(s - s.max())
            best = int(p.argmax())
            names.append(langs[best])
            scores.append(float(p[best] / p.sum()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("_p", predict(F.col(text_col))).withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")
