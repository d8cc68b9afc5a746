"""Exit simulation against a walk over each path."""

import datetime as dt
import random

import pytest

from tapewright.operators import exits

DAY = dt.date(2020, 1, 1)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
TRADES = "symbol string, entry_date date, entry double, target double, stop double"


def made(seed, symbols=6, days=90):
    rng, rows, trades = random.Random(seed), [], []
    for s in range(symbols):
        c = 100.0
        for d in range(days):
            c *= 1 + rng.gauss(0, 0.03)
            spread = c * rng.random() * 0.03
            if rng.random() < 0.9:
                rows.append((str(s), DAY + dt.timedelta(d), c, c + spread, c - spread, c, 1.0))
                if rng.random() < 0.2:
                    stop = c * (1 - rng.random() * 0.1)
                    trades.append((str(s), DAY + dt.timedelta(d + rng.choice([0, 0, 1])), c, c + 1.5 * (c - stop), stop))
    trades += [("0", DAY - dt.timedelta(3), 100.0, 120.0, 95.0), ("1", DAY + dt.timedelta(days), 1.0, 2.0, 0.5), ("2", DAY, 10.0, 12.0, 11.0), ("x", DAY, 1.0, 2.0, 0.5)]
    return rows, trades


def walked(rows, trades, days=21):
    out = {}
    for symbol, day, entry, target, stop in trades:
        own = sorted(r for r in rows if r[0] == symbol)
        i0 = next((i for i, r in enumerate(own) if r[1] > day), None)
        if i0 is None or stop >= entry:
            continue
        i, d = i0 - 1, entry - stop
        ranges = [max(own[j][3] - own[j][4], abs(own[j][3] - own[j - 1][5]), abs(own[j][4] - own[j - 1][5])) for j in range(max(i - 13, 1), i + 1)]
        atr = sum(ranges) / 14 if i >= 15 else None
        for variant in exits.VARIANTS:
            k = exits.WIDER.get(variant, 1.0)
            s, t, peak, up, down, found = entry - k * d, entry + 2 * k * d, entry, 0.0, 0.0, None
            for r in own[i0 : i0 + days + 1]:
                up, down, last = max(up, r[3] / entry - 1), min(down, r[4] / entry - 1), r
                if variant == "trail_atr3":
                    peak = max(peak, r[5])
                    s = max(s, peak - 3 * (atr or d))
                if variant != "time_only" and r[4] <= s:
                    found = ("stop", r[1], s / entry - 1)
                elif variant in exits.WIDER and r[3] >= t:
                    found = ("target", r[1], t / entry - 1)
                if found:
                    break
            outcome, when, ret = found or ("expired", last[1], last[5] / entry - 1)
            out[symbol, day, entry, variant] = (outcome, when, ret, ret / (k * d / entry), up, down)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exits_equal_a_walk(spark, seed):
    rows, trades = made(seed)
    got = exits.exit_variants(spark.createDataFrame(trades, TRADES), spark.createDataFrame(rows, BARS)).collect()
    want = walked(rows, trades)
    assert len(got) == len(want) and {r["outcome"] for r in got} == {"stop", "target", "expired"}
    for r in got:
        outcome, when, *figures = want[r["symbol"], r["entry_date"], r["entry"], r["variant"]]
        assert (r["outcome"], r["exit_date"]) == (outcome, when)
        assert [r[c] for c in ("realized", "r", "mfe", "mae")] == pytest.approx(figures, abs=1e-9)


def test_no_trades_no_rows(spark):
    rows, _ = made(3, symbols=1)
    nothing = exits.exit_variants(spark.createDataFrame([], TRADES), spark.createDataFrame(rows, BARS))
    assert nothing.collect() == [] and exits.calibrated(nothing).collect() == []
    assert exits.whipsaw(nothing).first().asDict() == {"stopped": 0, "reversed": 0, "share": 0.0}


OUTCOMES = "symbol string, entry_date date, entry double, target double, stop double, variant string, outcome string, exit_date date, realized double, r double, mfe double, mae double"


def outcomes(spark, returns):
    """Ten trades, one a day, with a return in R per variant before and after the split and the share of the best excursion that was kept."""
    return spark.createDataFrame(
        [(str(k), DAY + dt.timedelta(k), 10.0, 12.0, 9.0, v, "target" if r > 0 else "stop", DAY, r / 10, r, abs(r) / 10 / kept, 0.0) for v, (a, b, kept) in returns.items() for k in range(10) for r in [a if k < 7 else b]], OUTCOMES)


@pytest.mark.parametrize(
    "wide, verdicts",
    [((1.5, 1.5, 0.9), {"ADOPT"}), ((1.5, 0.5, 0.9), {"reject"}), ((0.5, 1.5, 0.9), {"reject"}), ((1.5, 1.5, 0.5), {"reject"})],
)
def test_adoption_rule(spark, wide, verdicts):
    got = {r["variant"]: r for r in exits.calibrated(outcomes(spark, {"current": (1.0, 1.0, 0.9), "wide_2x": wide, TRAIL: (1.2, 1.2, 0.8)} if verdicts == {"ADOPT"} else {"current": (1.0, 1.0, 0.9), "wide_2x": wide})).collect()}
    assert {got["wide_2x"]["verdict"]} == verdicts and got["current"]["verdict"] == ("reject" if verdicts == {"ADOPT"} else "KEEP")
    assert got["current"]["n_train"] == 7 and got["current"]["n_test"] == 3
    assert sum(r["verdict"] == "ADOPT" for r in got.values()) == (verdicts == {"ADOPT"})


def test_whipsaw_counts_paths_that_reached_the_target(spark):
    rows = [("a", "stop", 0.25), ("b", "stop", 0.1), ("c", "target", 0.3)]
    found = spark.createDataFrame([(s, DAY, 10.0, 12.0, 9.0, "current", o, DAY, 0.0, 0.0, m, 0.0) for s, o, m in rows], OUTCOMES)
    assert exits.whipsaw(found).first().asDict() == {"stopped": 2, "reversed": 1, "share": 0.5}


TRAIL = exits.TRAIL
