"""Books of several strategies at once, weighted deciles and the ensemble, against loops."""

import datetime as dt
import random

import pandas as pd
import pytest

from tapewright.operators import books, models

DATES = [dt.date(2020, m, 28) for m in range(1, 13)]
HELD = "strategy string, rebal_date date, symbol string, weight double"


def made(seed):
    rng = random.Random(seed)
    signals = [(s, d, str(k), rng.choice([0.0, 1.0, 2.5, -1.0])) for s in ("a", "b") for d in DATES for k in range(8) if rng.random() < 0.6 and not (s == "b" and d.month in (4, 5))]
    returns = [(d, str(k), rng.gauss(0, 0.1) if rng.random() < 0.9 else None) for d in DATES for k in range(8)]
    scores = [(d, rng.choice([20.0, 50.0, 80.0])) for d in DATES[2:]]
    return signals, returns, scores


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_books_equal_a_loop(spark, seed):
    signals, returns, scores = made(seed)
    known, gate = {(d, s): r for d, s, r in returns if r is not None}, dict(scores)
    want, trades = {}, {}
    for name in ("a", "b"):
        before, equity = {}, 1.0
        for d in DATES:
            w = {s: x for n, day, s, x in signals if n == name and day == d and x > 0 and (d, s) in known}
            if not w:
                continue
            w = {s: x / sum(w.values()) for s, x in w.items()}
            moves = {s: w.get(s, 0) - before.get(s, 0) for s in {*w, *before}}
            gross, turn = sum(x * known[d, s] for s, x in w.items()), sum(map(abs, moves.values()))
            net = gross - turn * 0.003
            on = gate.get(d, 99.0) >= 50
            equity *= 1 + (net if on else 0)
            want[name, d] = (len(w), gross, turn, net, on, net if on else 0.0, equity)
            trades |= {(name, d, s): x for s, x in moves.items() if abs(x) > 1e-6}
            before = w
    held = books.target_weights(spark.createDataFrame(signals, HELD), spark.createDataFrame(returns, "rebal_date date, symbol string, realized double"))
    got = {(r["strategy"], r["rebal_date"]): r for r in books.run_books(held, spark.createDataFrame(scores, "rebal_date date, score double")).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert [float(got[k][c]) for c in ("names", "gross", "turnover", "net", "on", "net_gated", "equity")] == pytest.approx(list(map(float, v)))
    moved = {(r["strategy"], r["rebal_date"], r["symbol"]): r for r in books.leg_trades(held).collect()}
    assert {k: r["delta"] for k, r in moved.items()} == pytest.approx(trades) and all((r["side"] == "buy") == (r["delta"] > 0) for r in moved.values())
    assert all(r["on"] and r["net"] == r["net_gated"] for r in books.run_books(held).collect())


def test_weighted_deciles(spark):
    rows = [(DATES[0], str(k), 10, v) for k, v in enumerate([0.01, 0.2, 0.4, None])] + [(DATES[0], "x", 9, 0.1), (DATES[1], "0", 10, 0.2)]
    got = {(r["kind"], r["symbol"]): r["weight"] for r in books.weighted_deciles(spark.createDataFrame(rows, "rebal_date date, symbol string, decile int, vol_3m double"), least=2).collect()}
    assert got == {**{("ew", str(k)): 1.0 for k in range(4)}, ("iv", "0"): 20.0, ("iv", "1"): 5.0, ("iv", "2"): 2.5}


def test_ensemble_is_the_mean_of_two_ranks(spark):
    rng = random.Random(4)
    rows = [(d, str(k), rng.choice([0.1, 0.2, 0.3, rng.random(), None]), rng.random()) for d in DATES[:3] for k in range(20)]
    frame = pd.DataFrame(rows, columns=["rebal_date", "symbol", "a", "b"])
    kind = "rebal_date date, symbol string, score double"
    learned, linear = (spark.createDataFrame([(r[0], r[1], r[i]) for r in rows if not (i == 3 and r[1] == "7")], kind) for i in (2, 3))
    both = frame[frame["a"].notna() & (frame["symbol"] != "7")]
    want = both.assign(score=sum(both.groupby("rebal_date")[c].rank(pct=True) for c in "ab") / 2)
    got = {(r["rebal_date"], r["symbol"]): r["score"] for r in books.ensemble_rank(learned, linear).collect()}
    assert got == pytest.approx({(r.rebal_date, r.symbol): r.score for r in want.itertuples()})


def test_no_score_has_seen_its_own_time(spark):
    """Folds begin and end where they should, and their models end before them by the embargo."""
    rng = random.Random(6)
    dates = [dt.date(2015 + m // 12, m % 12 + 1, 28) for m in range(30)]
    rows = [(d, str(k), rng.random(), rng.gauss(0, 1)) for d in dates for k in range(12)]
    panel = spark.createDataFrame(rows, "rebal_date date, symbol string, x double, fwd double")
    got = models.walkforward_gbt(panel, ["x"], "fwd", first=12, step=9, embargo=2).collect()
    until = {r["rebal_date"]: r["learned_until"] for r in got}
    assert until == {d: dates[12 + (i - 12) // 9 * 9 - 3] for i, d in enumerate(dates) if i >= 12} and len(got) == 18 * 12
    assert all(r["learned_until"] < r["rebal_date"] for r in got)
    # what a model learns from ends there: other labels after it change no score before the next fold
    later = panel.selectExpr("rebal_date", "symbol", "x", f"CASE WHEN rebal_date > DATE '{dates[9]}' THEN -5 * fwd ELSE fwd END AS fwd")
    again = {(r["rebal_date"], r["symbol"]): r["score"] for r in models.walkforward_gbt(later, ["x"], "fwd", first=12, step=9, embargo=2).collect()}
    assert all(again[r["rebal_date"], r["symbol"]] == r["score"] for r in got if r["rebal_date"] < dates[21])


def test_risk_curve_brakes_and_cards(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    returns = [0.05, -0.05, 0.0, -0.05, 0.05, *[-0.25] * 6]
    trades = spark.createDataFrame([("s", k, day(k), 100.0, 95.0, r) for k, r in enumerate(returns)], "strategy string, trade_id int, exit_date date, entry_price double, stop double, realized double")
    got = books.max_cards(
        books.risk_curve(trades), spark.createDataFrame([(day(0), 3), (day(1), 1), (day(2), 2)], "exit_date date, votes int"), spark.createDataFrame([("s", 0.5)], "strategy string, correlation double")).orderBy("trade_id").collect()
    equity, high, streak = 0.0, 0.0, 0
    for k, r in enumerate(returns):
        equity += r / 0.05 * 10_000
        high, streak = max(high, equity), 0 if r > 0 else streak + 1
        drawdown = (high - equity) / (high + 1e6)
        factor = min(0.25 if drawdown >= 0.22 else 0.5 if drawdown >= 0.15 else 0.75 if drawdown >= 0.1 else 1.0, 0.75 if streak >= 3 else 1.0)
        assert (got[k]["equity"], got[k]["drawdown"], got[k]["multiplier"]) == pytest.approx((equity, drawdown, factor))
        assert (got[k]["streak"], got[k]["halt"]) == (streak, drawdown >= 0.22)
    assert [r["max_cards"] for r in got[:4]] == [50, 25, 50, 25]
    both = books.max_cards(books.risk_curve(trades), spark.createDataFrame([(day(0), 3)], "exit_date date, votes int"), spark.createDataFrame([("s", 0.7)], "strategy string, correlation double"))
    assert [r["max_cards"] for r in both.orderBy("trade_id").collect()[:2]] == [25, 12]


def test_recommendations_become_trades(spark):
    kind = "rec_id int, strategy string, horizon int, entry double, target double, stop double, close_date date, exit_price double, realized double, outcome string"
    recs = spark.createDataFrame([
        (1, "Value_x", 21, 10.0, 12.0, 9.0, DATES[0], 12.0, 0.2, "TARGET"), (2, None, None, 10.0, 12.0, 9.0, None, None, None, None), (3, "macro", 63, 10.0, 12.0, 9.0, DATES[1], 9.5, -0.05, "EXPIRED_LOSS")], kind)
    made = books.trades_of(recs)
    got = {r["thesis_id"]: (r["thesis_type"], r["timeframe"], r["status"], r["exit_reason"]) for r in made.collect()}
    assert got == {1: ("value", "swing", "closed", "target"), 2: ("momentum", "swing", "active", None), 3: ("macro_overlay", "positional", "closed", "expired")}
    parity = books.trade_parity(recs, made).first()
    assert parity["parity"] and parity["rec_mean"] == pytest.approx(0.075)
    assert not books.trade_parity(recs, made.where("thesis_id = 1")).first()["parity"]
    assert books.trade_parity(recs.where("false"), made.where("false")).first()["parity"]


def test_phase_headroom_takes_the_latest_cap(spark):
    from tapewright.operators.stats import phase_headroom

    log = spark.createDataFrame([("a", 1, "250s / cap 300s"), ("a", 2, "10s / cap 900s"), ("a", 3, "killed"), ("b", 1, "99s / cap 300s"), ("c", 1, None)], "phase string, ts int, detail string")
    assert {tuple(r) for r in phase_headroom(log, ["ts"]).collect()} == {("a", 250.0, 900.0, False), ("b", 99.0, 300.0, False)}
    assert phase_headroom(log.where("ts = 1"), ["ts"]).where("phase = 'a'").first()["tight"]
