"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of a whole text (STATS: character classes, words, repetition, lines)
come from one vectorised UDF. Small boosted trees are grown on them; every path
from a root to a node is a rule, a conjunction of thresholds on statistics. A
lasso logistic regression weighs the rules, most of them to zero, and the rest
is compiled into one Spark column expression, so that scoring is a UDF for the
statistics and ordinary column arithmetic.

Fitting takes a bounded sample of labelled rows (FIT_ROWS, by a hash of the
id); rows with null labels are not used. Without labels of both kinds the score
is the share of good labels (0.5 without any). Null and empty texts have
statistics of 0 and get a score like any other. Further columns are carried, but a
column that has the name of the score (`out`) is replaced by it and one named `_stats`
is dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample

FIT_ROWS = 20_000
STATS = [
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "common_punct", "symbol", "wide", "bar", "shout_words",
    "odd_ends", "unique_words", "unique_pairs", "top_word", "unique_lines", "words_per_line", "packed", "stops_per_word",
]
_PUNCT = np.array([ord(c) for c in ".,;:!?'\"()-"])
_ASCII_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in set(_PUNCT.tolist())])


def text_stats(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATS."""
    if not text:
        return [0.0] * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    k = max(len(words), 1)
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = int(by[65:91].sum() + by[97:123].sum() + by[128:].sum())
    sample_counts: dict[str, int] = {}
    for w in words:
        sample_counts[w] = sample_counts.get(w, 0) + 1
    return [
        math.log1p(n), math.log1p(len(words)), (n - int(by[32] + by[9:14].sum())) / k, int(by[65:91].sum()) / max(letters, 1),
        int(by[48:58].sum()) / n, int(by[32] + by[9:14].sum()) / n, int(by[_PUNCT].sum()) / n, int(by[_ASCII_SYMBOL].sum()) / n,
        int(by[128:].sum()) / n, int(by[124]) / k, sum(map(str.isupper, distinct)) / max(len(distinct), 1),
        sum(1 for w in distinct if not (w[-1].isalnum() or w[-1] in ".,;:?!")) / max(len(distinct), 1),
        len(distinct) / k, len(set(zip(words, words[1:]))) / max(k - 1, 1), max(sample_counts.values(), default=0) / k,
        len(set(lines)) / max(len(lines), 1), k / max(len(lines), 1), len(zlib.compress(raw, 1)) / n,
        (text.count(". ") + text.count(".\n")) / k,
    ]


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def stats_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=STATS)


Rule = list[tuple[int, bool, float]]  # conditions: statistic, whether above, threshold


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rules: list[Rule]) -> np.ndarray:
    """One tree by histograms; its paths join `rules`. The step that it takes for each row."""
    step = np.zeros(len(x))

    def split(rows: np.ndarray, path: Rule, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        if path:
            rules.append(path)
        best = (1e-3, None, None)
        if left and len(rows) >= 20:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], grad[rows], minlength=len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], hess[rows], minlength=len(c) + 1))[:-1]
                ns = np.cumsum(np.bincount(binned[rows, f], minlength=len(c) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < 10) | (len(rows) - ns < 10)] = 0
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b)
        if best[1] is None:
            step[rows] = 0.3 * g / (h + 1)
            return
        _, f, b = best
        above = binned[rows, f] > b
        split(rows[~above], [*path, (f, False, float(cuts[f][b]))], left - 1)
        split(rows[above], [*path, (f, True, float(cuts[f][b]))], left - 1)

    split(np.arange(len(x)), [], depth)
    return step


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, lasso: float = 2e-3, rounds: int = 400) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return math.log(p / (1 - p)), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = math.log(y.mean() / (1 - y.mean()))
    score, rules = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        score += _grow(x, cuts, binned, y - p, p * (1 - p), depth, rules)
    rules = [list(r) for r in dict.fromkeys(tuple(sorted(r)) for r in rules)]
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32)
    mean, spread = z.mean(0), np.maximum(z.std(0), 0.05)
    z = (z - mean) / spread
    # accelerated proximal gradient on the lasso logistic loss
    rate = 4 * len(y) / max(float(np.linalg.norm(z, 2) ** 2), 1e-9)
    w, ahead, t, b = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0, base
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ ahead + b)))
        grad = z.T @ (p - y) / len(y)
        b -= 4 * float((p - y).mean())
        new = ahead - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    weights = w / spread
    return float(b - (weights * mean).sum()), [(float(v), r) for v, r in zip(weights, rules) if abs(v) > 1e-6]


def score_column(intercept: float, rules: list[tuple[float, Rule]], stats: Callable[[str], Column]) -> Column:
    """The fitted ensemble as a column expression of the statistics."""
    total = F.lit(intercept)
    for weight, rule in rules:
        met = F.lit(True)
        for f, above, t in rule:
            met = met & ((stats(STATS[f]) > t) if above else (stats(STATS[f]) <= t))
        total = total + F.when(met, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo `folds` (null id: of the empty string)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS):
    """Fit on at most about `rows` of the labelled rows."""
    labelled = bounded_sample(labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna(), "_id", rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(labelled), "_id").select("_y", "_id", stats_udf("_text").alias("s")).select("_id", "_y", "s.*").toPandas()
    found = found.sort_values(["_id", *STATS])
    return fit_rules(found[STATS].to_numpy(float), found["_y"].to_numpy(float))


def scored(docs: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score in (0, 1) of each whole text."""
    intercept, rules = model
    with_stats = docs.withColumn("_stats", stats_udf(F.col(text_col)))
    return with_stats.withColumn(out, score_column(intercept, rules, lambda s: F.col("_stats")[s])).drop("_stats")
