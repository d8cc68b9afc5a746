"""Strategies, bands, scores, feeds and books on small made panels."""

import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tapewright.functions.core import clip, norm_ppf
from tapewright.operators import books, composites, scoring, series, stats, strategies
from tapewright.sources import feeds
from tapewright.sources.scratch import Scratch, release, tables

D = dt.date
PANEL = (
    "rebal_date date, symbol string, sector string, close double, vol_3m double, ret_1m double, mom_12_1 double, prox_52w_high double, deliv_1m double, "
    "above_200 int, earnings_yield double, roe double, dividend_yield double"
)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        (D(2020, 1, 31), f"s{i:02d}", f"x{i % 5}", 10.0, 0.01 if i == 0 else 0.1 + i / 100, i / 10, -i / 10, i / 30, 50.0 - i, int(i < 12), (i - 10) / 10, i / 20, i / 50)
        for i in range(20)
    ]
    return spark.createDataFrame([*rows, (D(2020, 2, 29), "s00", "x0", 1.0, 0.1, 0.1, 0.1, 0.1, 0.1, 1, 0.1, 0.1, 0.1)], PANEL)


def chosen(df):
    return {r["symbol"]: r["weight"] for r in df.collect()}


def test_strategies_choose_their_deciles(panel):
    s = strategies.STRATEGIES
    assert set(s) == {
        "momentum_delivery_lowvol", "low_volatility", "short_term_reversal", "high52_breakout", "value_earnings_yield", "quality_roe", "dividend_yield", "sector_rotation",
    }
    lowest = chosen(s["low_volatility"](panel))
    assert set(lowest) == {"s00", "s01"} and lowest["s00"] == 1 / 0.05  # volatility is taken as 0.05 at least
    assert chosen(s["short_term_reversal"](panel)) == {"s00": 1.0, "s01": 1.0}
    assert set(chosen(s["high52_breakout"](panel))) == {"s10", "s11"}  # of the twelve above their average
    assert set(chosen(s["quality_roe"](panel))) == {"s18", "s19"} and set(chosen(s["dividend_yield"](panel))) == {"s18", "s19"}
    assert chosen(s["value_earnings_yield"](panel)) == {}  # nine positive earners are too few
    assert {x for x in chosen(s["sector_rotation"](panel))} == {f"s{i:02d}" for i in range(20) if i % 5 in (0, 1, 2)}
    best = chosen(s["momentum_delivery_lowvol"](panel))
    assert set(best) == {"s00", "s01"} or len(best) == 2
    assert all(chosen(f(panel.where("false"))) == {} for f in s.values())


def test_mean_rank_takes_the_ranks_there_are(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, None), (1, "b", 2.0, 5.0), (1, "c", None, None)], "rebal_date int, symbol string, x double, y double")
    got = {r["symbol"]: r["composite"] for r in strategies.mean_rank(rows, {"x": 1, "y": -1}).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": None}


def test_bands(spark):
    rows = [("swing", 100.0, 2.0, 10.0, 0.1), ("trend", 100.0, 2.0, 30.0, 0.1), ("wide", 100.0, 50.0, 30.0, 0.1), ("dear", 2e6, 1.0, 1.0, -0.1), ("none", 100.0, None, 30.0, 0.1)]
    cards = spark.createDataFrame(rows, "symbol string, entry double, atr_pct double, adx double, dist_sma200 double")
    got = {r["symbol"]: (r["timeframe"], r["stop"], r["target"], r["size"]) for r in scoring.bands(cards).collect()}
    assert got["swing"] == ("swing", 96.5, 107.0, 2857) and got["trend"] == ("positional", 94.5, 111.0, 1818) and got["wide"] == ("positional", 90.0, 120.0, 1000)
    assert set(got) == {"swing", "trend", "wide"}


def test_event_score_fades_and_is_strictly_before(spark):
    cards = spark.createDataFrame([("a", D(2020, 3, 1)), ("b", D(2020, 3, 1)), ("c", D(2020, 3, 1))], "symbol string, rebal_date date")
    events = spark.createDataFrame(
        [("a", D(2020, 2, 1), "scored", "bullish"), ("a", D(2020, 2, 20), "scored", "bearish"), ("b", D(2020, 3, 1), "scored", "bullish"), ("c", D(2019, 1, 1), "scored", "bullish"),
         ("c", D(2020, 2, 1), "risk", "bearish")], "symbol string, event_date date, tier string, direction string")
    got = {r["symbol"]: (r["event_score"], r["at_risk"]) for r in scoring.event_score(cards, events).collect()}
    assert got["a"][0] == pytest.approx(50 + 50 * (1 - 29 / 63)) and got["b"] == (50.0, False) and got["c"] == (50.0, True)


def test_each_kind_of_event_counts_for_its_own_time(spark):
    """Against a loop over all events of a card."""
    import random

    rng, day = random.Random(2), lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    horizons = {"a": 10, "b": 40, "c": 10}
    events = [(rng.choice("xyz"), day(rng.randrange(120)), rng.choice(["scored", "risk", "context"]), rng.choice(["bullish", "bearish"]), rng.choice(["a", "b", "c", "d", None])) for _ in range(60)]
    cards = [(s, day(k)) for s in "xyzq" for k in range(0, 130, 7)]
    frame = scoring.event_score(
        spark.createDataFrame(cards, "symbol string, rebal_date date"), spark.createDataFrame(events, "symbol string, event_date date, tier string, direction string, event_type string"), horizons)
    assert frame.columns == ["symbol", "rebal_date", "event_score", "at_risk"]
    for r in frame.collect():
        score, risk = 50.0, False
        for s, d, tier, direction, kind in events:
            age, days = (r["rebal_date"] - d).days, horizons.get(kind, 63)
            if s == r["symbol"] and 0 < age <= days:
                risk |= tier == "risk"
                if tier == "scored" and direction == "bullish":
                    score = max(score, 50 + 50 * (1 - age / days))
        assert (r["event_score"], r["at_risk"]) == (pytest.approx(score), risk)


def test_confidence_cap_and_audit(spark):
    scored = spark.createDataFrame([(1, "a", *[100.0] * 6, 0.0), (1, "b", *[100.0] * 6, 0.0)], "rebal_date int, symbol string, " + ", ".join(f"{p} double" for p in scoring.WEIGHTS))
    years = spark.createDataFrame([("a", 3), ("b", 9)], "symbol string, years long")
    rows = scoring.confidence(scored, years, F.lit("value")).collect()
    assert len(rows) == 14 and {r["symbol"]: r["confidence"] for r in rows} == {"a": 70.0, "b": pytest.approx(100.0)}


def test_decile_book_costs_entries(spark):
    rows = [(D(2020, m, 28), f"s{i:02d}", 0.01 * i, (i + 10 * (m == 3)) % 20 // 2 + 1) for m in (1, 2, 3) for i in range(20)]
    book = spark.createDataFrame(rows, "rebal_date date, symbol string, realized double, decile int")
    got = {r["rebal_date"].month: r for r in books.decile_book(book).collect()}
    assert got[1]["long_gross"] == pytest.approx(0.185) and got[1]["long_net"] == pytest.approx(0.185 - 0.006)  # all names are new
    assert got[2]["long_net"] == pytest.approx(0.185) and got[3]["long_net"] == pytest.approx(0.085 - 0.006)


def test_weight_diff_and_orders(spark):
    book = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0)], "rebal_date int, symbol string, weight double")
    got = {(r["rebal_date"], r["symbol"]): (r["weight"], r["delta"]) for r in books.weight_diff(book).collect()}
    assert got == {(1, "a"): (0.5, 0.5), (1, "b"): (0.5, 0.5), (2, "a"): (0.0, -0.5), (2, "b"): (1.0, 0.5)}
    prices = spark.createDataFrame([(1, "a", 10.0, 1e9), (1, "b", 10.0, 1e4), (2, "a", 10.0, 1e9), (2, "b", 10.0, 1e9)], "rebal_date int, symbol string, close double, adv double")
    orders = {(r["rebal_date"], r["symbol"]): (r["side"], r["shares"], r["verdict"]) for r in books.checked_orders(book, prices, 1e6).collect()}
    assert orders == {(1, "a"): ("BUY", 6000, "ok"), (1, "b"): ("BUY", 6000, "adv"), (2, "a"): ("SELL", 6000, "ok")}  # b is at its cap already


def test_norm_ppf_and_clip(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(norm_ppf(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-7)
    assert spark.range(1).select(norm_ppf(F.lit(1.0)), clip(F.lit(None).cast("double"), 0, 1)).first() == (None, None)


def test_macd_against_a_loop(spark):
    closes = [100 + 10 * ((i * 37) % 11) / 11 + i / 7 for i in range(60)]
    frame = spark.createDataFrame([("a", D(2020, 1, 1) + dt.timedelta(i), c) for i, c in enumerate(closes)] + [("b", D(2020, 1, 1), 1.0)], "symbol string, date date, close double")

    def ema(xs, n):
        out = [sum(xs[:n]) / n]
        for x in xs[n:]:
            out.append(out[-1] + (x - out[-1]) * 2 / (n + 1))
        return out

    line = [f - s for f, s in zip(ema(closes, 12)[14:], ema(closes, 26))]
    (r,) = series.macd(frame).collect()
    assert (r["macd"], r["signal"]) == pytest.approx((line[-1], ema(line, 9)[-1]))


def test_feeds(spark):
    lines = [(1, 0, "Title"), (1, 1, "Client,Long"), (1, 2, " FII , 5,2,3,-,1,2,3,4,5,6,7,8"), (1, 3, "short,1,2"), (1, 4, ",1,2,3,4,5,6,7,8,9,10,11,12")]
    (r,) = feeds.participant_oi(spark.createDataFrame(lines, "date int, line_no int, value string")).collect()
    assert (r["participant"], r["index_fut_net"], r["stock_fut_net"], r["stock_put_short"]) == ("FII", 3.0, None, 8.0)
    texts = [("Securities in Ban For Trade Date 29-JUN-2026: NIL",), ("Securities in Ban For Trade Date 01-JUL-2026:\n1,ABC\n2, M&M ,x1",), ("no date",)]
    assert [tuple(x) for x in feeds.ban_list(spark.createDataFrame(texts, "text string")).collect()] == [(D(2026, 7, 1), "ABC"), (D(2026, 7, 1), "M&M")]
    item = lambda link, title, day: f"<item><title>{title}</title><link>{link}</link><pubDate>{day}</pubDate></item>"
    xml = "<rss><channel>" + item("l1", "a", "Mon, 5 Jan 2026 10:00:00 +0530") + item("l1", "b", "Tue, 06 Jan 2026 11:00:00 GMT") + item("", "c", "x") + item("l2", "d", "soon") + "</channel></rss>"
    got = {x["link"]: (x["title"], x["published"]) for x in feeds.news_items(spark.createDataFrame([("s", 1, xml)], "source string, fetched int, xml string")).collect()}
    assert got == {"l1": ("b", "2026-01-06 11:00:00"), "l2": ("d", "soon")}
    text = '[{"page": 1}, [{"date": "1999", "value": 1.5}, {"date": "2000", "value": null}]]'
    assert [tuple(x) for x in feeds.annual_series(spark.createDataFrame([("s", text)], "series_id string, text string")).collect()] == [("s", D(1999, 1, 1), 1.5, "A")]


def test_spine_reweights_the_axes_there_are(spark):
    scores = spark.createDataFrame([("risk", "a", D(2020, 1, 1), 100.0), ("risk", "b", D(2020, 1, 1), 0.0), ("vol", "a", D(2020, 1, 2), -100.0)], "axis string, component string, date date, score double")
    calendar = spark.createDataFrame([(D(2020, 1, d),) for d in (1, 2)], "date date")
    got = {r["date"].day: (r["risk_axis"], r["vol_axis"], r["regime_score"], r["label"]) for r in composites.regime_spine(scores, calendar).collect()}
    assert got[1] == (50.0, None, 75.0, "risk_on")
    assert got[2][:2] == (50.0, -100.0) and got[2][2] == pytest.approx((100 + (50 * 0.4 - 100 * 0.25) / 0.65) / 2) and got[2][3] == "neutral"


def test_scorecard_and_event_study(spark):
    navs = spark.createDataFrame([("a", D(2010, 1, 1) + dt.timedelta(i), 100.0 * 1.0002**i) for i in range(2000)] + [("b", D(2010, 1, 1), 1.0)], "symbol string, date date, close double")
    (r,) = stats.fund_scorecard(navs).collect()
    assert r["cagr_1y"] == pytest.approx(1.0002**365 - 1) and r["cagr_5y"] == pytest.approx(1.0002**365 - 1) and r["max_dd"] == 0
    rows = spark.createDataFrame([(D(2020, 1, d), float(d)) for d in (1, 2, 3, 4)], "event_date date, abnormal double")
    r = composites.event_study(rows).first()
    assert (r["n"], r["mean"], r["h1"], r["h2"]) == (4, 2.5, 1.0, 3.0)


def test_queries_leave_no_tables(spark):
    """What a result read is dropped by one call after it; tables of others stay."""
    from tapewright import registry

    release(spark)
    mine = Scratch(spark).written(spark.range(3), "mine")
    before = tables(spark)
    for name in ("bt_decile_book", "market_regime_spine"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert tables(spark) > before
        release(spark, before)
        assert tables(spark) == before
    kept = Scratch(spark).written(spark.range(5), "kept")
    release(spark, keep=kept)
    assert tables(spark) == {kept._scratch_table} and kept.count() == 5
    release(spark)
    assert tables(spark) == set() and not spark.catalog.databaseExists(Scratch(spark).database)
    del mine


def test_scratch_tables_are_deleted(spark):
    scratch = Scratch(spark)
    made = scratch.written(spark.range(3), "three")
    (path,) = {f.rsplit("/", 1)[0] for f in made.inputFiles()}
    scratch.drop(made, spark.range(1))
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_clusters_count_late_rows_where_they_belong(spark, tmp_path):
    """Rows that come a batch late, but within the watermark, give the alerts that sorted rows would give."""
    from tapewright.streaming import jobs

    at = lambda day, hour=12: dt.datetime(2024, 1, day, hour)
    parts = [[("a", at(2), "n1"), ("b", at(2), "n1")], [("a", at(5), "n2"), ("b", at(4), "n2")], [("a", at(4), "n3"), ("a", at(20), "n4")], [("a", at(21), "n5"), ("a", at(30), "n6"), ("b", at(30), "n9")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "symbol string, ts timestamp, name string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    feed = spark.readStream.schema("symbol string, ts timestamp, name string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    trades = feed.withColumn("day", F.unix_date(F.to_date("ts")).cast("long"))
    got = {(r["symbol"], (D(1970, 1, 1) + dt.timedelta(r["day"])).day, r["insiders"]) for r in jobs.drained(jobs.clusters(trades, 7, 2, "3 days"), str(tmp_path / "run")).collect()}
    assert got == {("a", 4, 2), ("a", 21, 2), ("b", 4, 2)}
