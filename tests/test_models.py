"""Fitted and resampled queries against closed forms and the same draws."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import books, models

DATES = [dt.date(2018 + m // 12, m % 12 + 1, 28) for m in range(24)]


def test_cpcv_ridge_equals_the_closed_form(spark):
    rng = random.Random(3)
    rows = [(d, str(k), rng.gauss(0, 1), rng.gauss(5, 2), rng.gauss(0, 1)) for d in DATES for k in range(25)]
    panel = spark.createDataFrame(rows, "rebal_date date, symbol string, x double, z double, fwd double")
    roles = books.cpcv_paths(spark.createDataFrame([(d,) for d in DATES], "rebal_date date"))
    kinds = {}
    for r in roles.collect():
        kinds.setdefault((r["g1"], r["g2"]), {})[r["rebal_date"]] = r["role"]
    got = {(r["g1"], r["g2"]): r for r in models.cpcv_ridge(panel, roles, ["x", "z"], "fwd", ridge=10.0).collect()}
    assert len(got) == 15 and set(got) == set(kinds)
    for path, kind in kinds.items():
        train = np.array([r[2:] for r in rows if kind[r[0]] == "train"])
        mean, scale = train[:, :2].mean(0), train[:, :2].std(0, ddof=1)
        a = np.column_stack([np.ones(len(train)), (train[:, :2] - mean) / scale])
        w = np.linalg.solve(a.T @ a + np.diag([0, 10.0, 10.0]), a.T @ train[:, 2])
        returns = []
        for d in (d for d in DATES if kind[d] == "test"):
            own = np.array([r[2:] for r in rows if r[0] == d])
            score = w[0] + (own[:, :2] - mean) / scale @ w[1:]
            place = np.argsort(np.argsort(score)) / (len(own) - 1)
            returns.append(own[place >= 0.9, 2].mean())
        assert got[path]["months"] == len(returns)
        assert got[path]["sharpe"] == pytest.approx(np.mean(returns) / np.std(returns, ddof=1) * 12**0.5)


def test_bootstrap_equals_its_own_draws(spark):
    rng = random.Random(5)
    values = [rng.gauss(0.01, 0.05) for _ in DATES]
    frame = spark.createDataFrame([(d, v) for d, v in zip(DATES, values)] + [(dt.date(2030, 1, 1), None)], "rebal_date date, ret double")
    draws, block, n = 60, 5, len(values)
    blocks = -(-n // block)
    starts = [r[0] for r in spark.range(draws * blocks).orderBy("id").select(F.pmod(F.xxhash64("id"), F.lit(n))).collect()]
    sharpes = []
    for k in range(draws):
        own = [values[(s + j) % n] for s in starts[k * blocks : (k + 1) * blocks] for j in range(block)]
        sharpes.append(np.mean(own) / np.std(own, ddof=1) * 12**0.5)
    got = books.block_bootstrap(frame, draws, block).first()
    assert [got[c] for c in ("p05", "p50", "p95")] == pytest.approx(np.quantile(sharpes, [0.05, 0.5, 0.95]).tolist())
    assert got["p_positive"] == pytest.approx(np.mean(np.array(sharpes) > 0))
