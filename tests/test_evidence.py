"""Membership, sector engine, market intelligence, claims, lags, shadows and fundamentals on made frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import evidence, market, membership

D = dt.date
DAY = D(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(k)


@pytest.mark.parametrize("seed", range(4))
def test_bridge_replays_any_log(spark, seed):
    """Against a set that takes one day after the other."""
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(12)]
    held = [(s, day(-rng.randrange(5, 50)), None, 1.0) for s in names[:6]] + [("s0", day(-90), day(-60), 1.0), ("s9", day(-90), day(-60), 0.7)]
    log = [(rng.choice(names), day(rng.randrange(-3, 34)), rng.choice(["add", "remove", "rename"])) for _ in range(60)]
    log += log[:5]  # repeated entries
    cutoff = 30
    spans, began = [], {s: (f, "snapshot", c) for s, f, t, c in held if t is None}
    spans += [(s, f, t, "snapshot", c) for s, f, t, c in held if t is not None]
    for k in range(1, cutoff + 1):
        today = {(s, c) for s, d, c in log if d == day(k)}
        for s in sorted(s for s, c in today if c == "remove" and s in began):
            f, method, c = began.pop(s)
            spans.append((s, f, day(k), method, c))
        for s in sorted(s for s, c in today if c == "add" and s not in began):
            began[s] = (day(k), "change_log", 0.95)
    spans += [(s, f, day(cutoff), "snapshot_bridged" if m == "snapshot" else m, min(c, 0.95)) for s, (f, m, c) in began.items()]
    got = membership.bridged(
        spark.createDataFrame(held, "symbol string, effective_from date, effective_to date, confidence double"), spark.createDataFrame(log, "symbol string, date date, change string"), str(DAY), str(day(cutoff)))
    assert sorted(map(tuple, got.collect())) == sorted(s for s in spans if s[1] < s[2])


def test_consumable_keeps_segments_that_agree(spark):
    kind = "segment string, symbol string"
    official = spark.createDataFrame([("a", x) for x in "pqrs"] + [("b", x) for x in "pqrs"], kind)
    rebuilt = spark.createDataFrame([("a", x) for x in "pqrx"] + [("a", "p"), ("b", "p"), ("c", "p")], kind)
    assert {tuple(r) for r in membership.agreement(rebuilt, official).collect()} == {("a", 0.75), ("b", 0.25), ("c", 0.0)}
    spans = spark.createDataFrame([(s, "p", DAY, 0.0) for s in "abc"], kind + ", effective_from date, confidence double")
    assert [(r["segment"], r["confidence"]) for r in membership.consumable(spans, rebuilt, official).collect()] == [("a", 0.75)]


CLAIM = "signal string, status string, least_mean double, least_t double, least_late double"


def test_claims_that_are_kept_and_broken(spark):
    registry = spark.createDataFrame([(s, k, 0.0, 3.0, 0.0) for s, k in [("good", "scored"), ("weak", "scored"), ("new", "scored"), ("dead", "killed"), ("ghost", "killed"), ("seen", "context")]], CLAIM)
    results = spark.createDataFrame([("good", 0.1, 3.0, 0.1), ("weak", 0.0, 2.9, -0.1), ("dead", 9.0, 9.0, 9.0)], "signal string, mean double, t_stat double, late double")
    weights = spark.createDataFrame([("good", 0.5), ("dead", 0.25), ("dead", -0.25), ("ghost", 0.0)], "signal string, weight double")
    tiers = spark.createDataFrame([("good",), ("good",), ("seen",), ("other",), ("ghost",)], "signal string")
    got = {(r["signal"], r["rule"], r["observed"]) for r in evidence.gate_violations(registry, results, weights, tiers).collect()}
    assert got == {
        ("seen", "scored without registration", None), ("other", "scored without registration", None), ("new", "no result", None), ("weak", "mean too low", 0.0),
        ("weak", "t too low", 2.9), ("weak", "later half too low", -0.1), ("dead", "killed but weighted", 0.5), ("ghost", "killed but scored", None)}
    only = registry.where("signal = 'good'")
    assert evidence.gate_violations(only, results, weights, tiers.where("signal = 'good'")).collect() == []


def test_usable_window_is_the_longest_run(spark):
    ends = [D(2018, 3, 31), D(2018, 6, 30), D(2018, 12, 31), D(2019, 3, 31), D(2019, 6, 30), D(2019, 9, 30), D(2019, 12, 31)]
    late = {D(2019, 6, 30): 401}
    rows = [(q, q + dt.timedelta(late.get(q, 400))) for q in ends] + [(ends[0], ends[0] + dt.timedelta(500))]
    got = {r["quarter_end"]: r for r in evidence.filing_lag_gate(spark.createDataFrame(rows, "quarter_end date, broadcast date")).collect()}
    assert (got[ends[0]]["filings"], got[ends[0]]["retro"], got[ends[0]]["usable"]) == (2, 1, 1) and not got[D(2019, 6, 30)]["good"]
    assert [q for q in ends if got[q]["in_window"]] == ends[:2]  # the first of runs of two


BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def test_sector_engine_against_a_loop(spark):
    rng, rows, closes = random.Random(5), [], {}
    for s in ("a1", "a2", "b1", "b2", "c1"):
        c = 100.0
        for k in range(260):
            c *= 1 + rng.gauss(0.001, 0.02)
            closes[s, k] = c
            rows.append((s, day(k), c, c, c, c, 1.0))
    sectors = spark.createDataFrame([(s, s[0]) for s in ("a1", "a2", "b1", "b2", "c1")], "symbol string, sector string")
    index = spark.createDataFrame([(day(k), 100.0 + k) for k in range(260)], "date date, close double")
    got = {(r["sector"], r["date"]): r for r in market.sector_engine(spark.createDataFrame(rows, BARS), sectors, index, least=2).collect()}
    level = {}
    for sector in "ab":
        x = 1.0
        for k in range(260):
            if k:
                x *= 1 + sum(closes[s, k] / closes[s, k - 1] - 1 for s in (sector + "1", sector + "2")) / 2
            level[sector, k] = x
    rs = {(s, k): level[s, k] / level[s, k - 63] - (100.0 + k) / (100.0 + k - 63) for s in "ab" for k in range(63, 260)}
    assert set(got) == {(s, day(k)) for s, k in rs}
    for (s, k), v in rs.items():
        r, mom = got[s, day(k)], rs[s, k] - rs[s, k - 21] if k >= 84 else None
        first = v > rs["b" if s == "a" else "a", k]
        assert r["rs"] == pytest.approx(v) and (r["rank"], r["score"]) == ((1, 100.0) if first else (2, 50.0)) and r["members"] == 2
        if mom is None:
            assert r["rs_mom"] is None and r["quadrant"] is None
        else:
            assert r["quadrant"] == {(True, True): "leading", (False, True): "improving", (True, False): "weakening", (False, False): "lagging"}[v > 0, mom > 0]
        if k >= 199:
            above = [closes[s + n, k] > sum(closes[s + n, j] for j in range(k - 199, k + 1)) / 200 for n in "12"]
            assert r["breadth"] == pytest.approx(50.0 * sum(above))


def test_market_intel_lists(spark):
    insiders = spark.createDataFrame(
        [("a", day(100), n, 5.0) for n in "xyz"] + [("b", day(100), n, 5.0) for n in "xy"] + [("c", day(100), "x", 1.0)] * 4 + [("d", day(-50), n, 1.0) for n in "xyz"], "symbol string, filing_date date, name string, value double")
    deals = spark.createDataFrame([("a", day(10), 5.0), ("a", day(12), -2.0), ("b", day(12), -1.0), ("c", day(-30), 9.0)], "symbol string, date date, net double")
    interest = spark.createDataFrame(
        [(s, day(5), 110.0, d, r) for s, d, r in [("a", 10.0, 0.1), ("b", 20.0, 0.2), ("c", 10.0, -0.1), ("d", -10.0, 0.1), ("e", -10.0, -0.1), ("f", None, 0.1)]] + [("z", day(4), 1.0, 1.0, 1.0)],
        "symbol string, date date, oi double, doi double, ret double")
    ratios = spark.createDataFrame([("a", day(5), 2.0), ("b", day(5), 0.5), ("c", day(5), 0.0), ("d", day(5), None), ("e", day(4), 9.0)], "symbol string, date date, pcr double")
    got = market.market_intel(insiders, deals, interest, ratios, extremes=2).collect()
    lists = {}
    for r in got:
        lists.setdefault(r["category"], []).append((r["symbol"], r["detail"], round(r["value"], 6)))
    assert lists == {
        "Insider cluster-buy": [("a", "3 insiders", 15.0)], "Bulk-deal accumulation": [("a", "net buy", 3.0)], "High PCR (puts heavy)": [("a", "PCR", 2.0), ("b", "PCR", 0.5)],
        "Low PCR (calls heavy)": [("b", "PCR", 0.5), ("a", "PCR", 2.0)], "Long buildup (bullish)": [("b", "OI 22%", 20.0), ("a", "OI 10%", 10.0)], "Short buildup (bearish)": [("c", "OI 10%", -10.0)],
        "Short covering": [("d", "OI -8%", 10.0)], "Long unwinding": [("e", "OI -8%", -10.0)]}


def test_shadow_returns_fill_as_time_passes(spark):
    bars = spark.createDataFrame([("a", day(k), 1.0, 1.0, 1.0, 100.0 + k, 1.0) for k in range(80)] + [("a", day(80), 1.0, 1.0, 1.0, 0.0, 1.0)], BARS)
    events = spark.createDataFrame([("a", day(0), "x"), ("a", day(0), "x"), ("a", day(30), "x"), ("a", day(90), "x"), ("q", day(0), "x"), ("a", day(70), "y")], "symbol string, event_date date, event_type string")
    got = {(r["event_date"], r["event_type"]): r for r in evidence.shadow_returns(events, bars).collect()}
    assert set(got) == {(day(0), "x"), (day(30), "x"), (day(70), "y")}
    first = got[day(0), "x"]
    assert first["entry_date"] == day(1) and first["ret_63"] == pytest.approx(164 / 101 - 1) and (first["filled_21"], first["filled_63"], first["filled_126"]) == (True, True, False)
    board = {r["event_type"]: r for r in evidence.shadow_board(evidence.shadow_returns(events, bars), least=1).collect()}
    assert (board["x"]["n"], board["x"]["filled"], board["x"]["hit"], board["x"]["enough"]) == (2, 1, 1.0, True)
    assert (board["y"]["filled"], board["y"]["hit"], board["y"]["enough"]) == (0, None, False)


def test_fundamentals_take_any_usual_name(spark):
    kind = "symbol string, report_date date, data_json string"
    income = spark.createDataFrame([("a", DAY, '{"Basic EPS": 2, "Net Income": 10, "Total Revenue": 100}'), ("b", DAY, '{"Diluted EPS": 1, "Basic EPS": 3, "Operating Revenue": 7}'), ("c", DAY, "broken"), ("d", DAY, "{}")], kind)
    balance = spark.createDataFrame([("a", DAY, '{"Common Stock Equity": 50}'), ("b", DAY, '{"Stockholders Equity": -1}')], kind)
    dates = spark.createDataFrame([(s, DAY, DAY) for s in "abc"] + [("d", DAY, None)], "symbol string, report_date date, pit_date date")
    got = {r["symbol"]: tuple(r)[3:] for r in evidence.fundamentals_features(income, balance, dates).collect()}
    assert got == {"a": (2.0, 10.0, 100.0, 50.0, 0.2), "b": (1.0, None, 7.0, -1.0, None), "c": (None,) * 5}


def test_annual_lines_and_depth(spark):
    lines = spark.createDataFrame([("a", "Mar 2015", "Sales", 1.0), ("a", "Mar 2015", "Sales", 2.0), ("a", "Dec 2016", "Net Profit", 3.0), ("a", "Foo 2017", "EPS in Rs", 4.0), ("a", "TTM", "Sales", 5.0), ("a", "Mar 2015", "Dividend", 6.0)],
                                  "symbol string, fiscal_year string, field string, value double")
    got = {(r["metric"], r["report_date"], r["pit_date"], r["value"]) for r in evidence.annual_pit(lines).collect()}
    assert got == {("Sales", D(2015, 3, 31), D(2015, 5, 30), 2.0), ("Net Profit", D(2016, 12, 31), D(2017, 3, 1), 3.0), ("EPS in Rs", D(2017, 3, 31), D(2017, 5, 30), 4.0)}
    figures = spark.createDataFrame([(s, y, 100.0) for s in "abc" for y in range(2010, 2018)] + [("d", 2010, 100.0)], "symbol string, year int, value double")
    other = spark.createDataFrame([("a", 2012, 120.0), ("b", 2012, 200.0), ("c", 2012, 0.5), ("d", 2010, 100.0)], "symbol string, year int, value double")
    found = {r["symbol"]: (r["depth"], r["validated"], r["eligible"]) for r in evidence.validated_depth(figures, other).collect()}
    assert found == {"a": (8, 1, True), "b": (8, 0, False), "c": (8, 0, False), "d": (1, 1, False)}
