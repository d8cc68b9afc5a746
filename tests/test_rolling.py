"""Sliding order statistics against pandas and lists."""

import random
from statistics import median

import pytest

from tapewright.operators import stats
from tapewright.operators.rolling import order_statistics


@pytest.mark.parametrize("n, by_place", [(1, False), (7, False), (40, False), (9, True)])
def test_order_statistics_equal_lists(spark, n, by_place):
    rng = random.Random(n)
    rows = [(s, d, rng.choice([None, 1.0, 2.0, rng.random() * 3]), d // 2) for s in ("a", "b", None) for d in range(60) if rng.random() < 0.8]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "symbol string, date int, v double, p int").repartition(4)
    got = {(r["symbol"], r["date"]): r for r in order_statistics(frame, "v", n, place="p" if by_place else None).collect()}
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        own = sorted(r for r in rows if r[0] == s) if s else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        for k, (_, d, v, p) in enumerate(own):
            frame_rows = [r for r in own[: k + 1] if r[3] > p - n] if by_place else own[max(0, k - n + 1) : k + 1]
            held = [r[2] for r in frame_rows if r[2] is not None]
            r = got[s, d]
            assert (r["_held"], r["_middle"]) == (len(held), median(held) if held else None)
            assert (r["_low"], r["_high"]) == ((min(held), max(held)) if held else (None, None))
            assert (r["_below"], r["_upto"]) == ((sum(x < v for x in held), sum(x <= v for x in held)) if v is not None else (None, None))


def test_universe_window_against_a_loop(spark):
    import datetime as dt

    rng, rows = random.Random(8), []
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    for s in "abcd":
        for k in range(0 if s != "d" else 50, 150 if s != "c" else 60):
            if rng.random() < 0.5:
                rows.append((s, day(k), 1.0, 1.0, 1.0, rng.random(), 10.0))
    dates = sorted({r[1] for r in rows})
    ends = [d for d in dates if d.month != (d + dt.timedelta(8)).month][::5]
    got = stats.universe_window(
        spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double"), spark.createDataFrame([(d,) for d in ends], "rebal_date date"), days=20, least=3).collect()
    want = {}
    for e in ends:
        frame = set(dates[max(0, dates.index(e) - 19) : dates.index(e) + 1])
        for s in "abcd":
            held = [r[5] * r[6] for r in rows if r[0] == s and r[1] in frame]
            if len(held) >= 3:
                want[e, s] = (len(held), median(held))
    found = {(r["rebal_date"], r["symbol"]): (r["n_days"], r["med_turnover"]) for r in got}
    assert set(found) == set(want) and len(got) == len(want)
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1]) for k in want)


@pytest.mark.parametrize("parts", [2, 64])
def test_spread_rank_equals_pandas(spark, parts):
    import pandas as pd

    rng = random.Random(parts)
    rows = [(k, rng.choice("ab"), rng.choice([None, 0.5, 0.5, rng.random()])) for k in range(900)]
    got = stats.spread_rank(spark.createDataFrame(rows, "k int, g string, v double"), "v", "g", "r", parts).orderBy("k").collect()
    frame = pd.DataFrame(rows, columns=["k", "g", "v"])
    want = frame.groupby("g")["v"].rank()
    assert [r["r"] for r in got] == [None if pd.isna(x) else x for x in want]


def test_first_filing_and_yearly_growth(spark):
    import datetime as dt

    from tapewright.operators import composites, series

    q, days = dt.date(2020, 1, 1), lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    statements = spark.createDataFrame([(s, q, 0.0) for s in "abcd"], "symbol string, quarter date, revenue double")
    filings = spark.createDataFrame([("a", days(89)), ("a", days(95)), ("a", days(90)), ("b", days(210)), ("c", days(211)), ("c", days(10))], "symbol string, broadcast date")
    got = {r["symbol"]: (r["real_date"], r["pit_date"], r["dated_by"]) for r in composites.first_filing(statements, filings).collect()}
    assert got == {"a": (days(90), days(90), "filing"), "b": (days(210), days(210), "filing"), "c": (None, days(135), "lag"), "d": (None, days(135), "lag")}
    rows = [("a", days(0), 2e5), ("a", days(100), 1e5), ("a", days(350), 3e5), ("a", days(449), 4e5), ("a", days(450), 5e5), ("b", days(0), 10.0), ("b", days(400), 20.0)]
    grown = {(r["symbol"], r["quarter"]): r["growth"] for r in series.yearly_growth(spark.createDataFrame(rows, "symbol string, quarter date, revenue double")).collect()}
    assert grown == {("a", days(350)): 0.5, ("a", days(449)): 1.0, ("a", days(450)): 4.0}
