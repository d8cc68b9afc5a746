"""Operators on hand-made fixtures and invariants; a sweep of queries against their SQL."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tapewright import registry
from tapewright.functions.core import parse_date, parse_number, parse_ratio, qcut_decile, rank_pct
from tapewright.operators import books, composites
from tapewright.operators.asof import asof
from tapewright.sources import normalize
from tapewright.sources.fixtures import TABLES, Tables

SF = "/root/testdata/sf0.001"
D = dt.date


def bars(spark, rows):
    return spark.createDataFrame([(s, D(2020, 1, d), c, c, c, c, 100.0) for s, d, c in rows], "symbol string, date date, open double, high double, low double, close double, volume double")


def test_parsing(spark):
    one = spark.range(1)
    ratio = lambda k, r: one.select(parse_ratio(F.lit(k), F.lit(r))).first()[0]
    assert ratio("SPLIT", "10:1") == 0.1 and ratio("BONUS", "1:1") == 0.5 and abs(ratio("BONUS", "10:1") - 1 / 11) < 1e-12
    assert ratio("SPLIT", "x") is None and ratio("DIVIDEND", "1:1") is None
    number = lambda v: one.select(parse_number(F.lit(v))).first()[0]
    assert number("₹ 1,234.50 Cr") == 1234.5 and number("12%") == 12 and number("n/a") is None and number("9e12") is None
    for text in ("2020-01-31 10:20:00", "31-Jan-2020", "31-01-2020", "31/01/2020"):
        assert one.select(parse_date(F.lit(text))).first()[0] == D(2020, 1, 31)


def test_ranks_match_pandas(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 5.0, 5.0, 5.0, 0.5, 7.0, 8.0, 9.0, 4.0]
    frame = pd.DataFrame({"g": 1, "symbol": [f"s{i:02d}" for i in range(len(values))], "v": values})
    rows = spark.createDataFrame([(1, f"s{i:02d}", v) for i, v in enumerate(values)], "g int, symbol string, v double")
    got = rows.select("symbol", rank_pct("v", "g").alias("r"), qcut_decile("v", "g").alias("d")).orderBy("symbol").collect()
    want = frame["v"].rank(pct=True)
    dec = pd.qcut(frame["v"].dropna().rank(method="first"), 10, labels=False) + 1
    for i, r in enumerate(got):
        assert (r["r"] is None and pd.isna(want[i])) or abs(r["r"] - want[i]) < 1e-12
        assert r["d"] == (None if i not in dec.index else dec[i])


def test_asof_ties_and_staleness(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 5)), ("a", D(2020, 3, 1)), ("b", D(2020, 1, 1))], "k string, t date")
    right = spark.createDataFrame([("a", D(2020, 1, 5), 1.0), ("a", D(2020, 1, 1), 2.0)], "k string, d date, v double")
    pick = lambda **o: [r["v"] for r in asof(left, right, ["k"], "t", "d", ["v"], **o).orderBy("k", "t").collect()]
    assert pick() == [1.0, 1.0, None]
    assert pick(strict=True) == [2.0, 1.0, None]
    assert pick(max_days=10) == [1.0, None, None]
    assert pick(forward=True) == [1.0, None, None]


def test_split_is_verified_by_its_cliff(spark):
    b = bars(spark, [("a", 1, 100.0), ("a", 2, 100.0), ("a", 5, 50.0), ("b", 1, 10.0), ("b", 4, 10.0)])
    actions = spark.createDataFrame(
        [("a", D(2020, 1, 3), "SPLIT", "2:1"), ("a", D(2020, 1, 1), "SPLIT", "2:1"), ("b", D(2020, 1, 3), "SPLIT", "2:1"), ("b", D(2020, 2, 1), "BONUS", "1:1")],
        "symbol string, date date, action_type string, ratio string")
    status = {(r["symbol"], r["ex_date"].day, r["ex_date"].month): r["status"] for r in composites.split_events(b, actions).collect()}
    assert status == {("a", 3, 1): "applied", ("a", 1, 1): "unverifiable", ("b", 3, 1): "skipped", ("b", 1, 2): "unverifiable"}
    adjusted = {(r["symbol"], r["date"].day): (r["close"], r["volume"]) for r in composites.split_adjust(b, actions).collect()}
    assert adjusted[("a", 2)] == (50.0, 200.0) and adjusted[("a", 5)] == (50.0, 100.0) and adjusted[("b", 1)] == (10.0, 100.0)


def test_membership_gap_makes_two_intervals(spark):
    months = spark.createDataFrame([(D(2020, m, 28),) for m in range(1, 7)], "rebal_date date")
    members = spark.createDataFrame([("a", D(2020, m, 28)) for m in (1, 2, 4, 6)], "symbol string, rebal_date date")
    got = sorted((r["effective_from"].month, r["effective_to"] and r["effective_to"].month) for r in composites.membership_islands(members, months).collect())
    assert got == [(1, 3), (4, 5), (6, None)]


def test_cluster_refires_after_the_window(spark):
    rows = [("a", D(2020, 1, d), f"n{i}", 1e7) for i, d in enumerate([1, 2, 20, 31])] + [("a", D(2020, 2, 10), "n9", 1e7)]
    got = composites.cluster_events(spark.createDataFrame(rows, "symbol string, filing_date date, name string, value double"), days=28).collect()
    assert [r["event_date"] for r in sorted(got, key=lambda r: r["event_date"])] == [D(2020, 1, 2), D(2020, 1, 31)]


def test_greedy_book_skips_and_goes_on(spark):
    cards = spark.createDataFrame([(1, "a", 60.0, 9.0), (1, "b", 50.0, 8.0), (1, "c", 40.0, 7.0)], "date int, symbol string, notional double, confidence double")
    assert [r["symbol"] for r in books.greedy_book(cards, 100.0).orderBy("rank").collect()] == ["a", "c"]


def test_first_touch_same_day_order(spark):
    b = bars(spark, [("a", 1, 10.0), ("a", 2, 10.0), ("a", 3, 10.0)]).withColumns({"high": F.lit(12.0), "low": F.lit(8.0)})
    trade = spark.createDataFrame([("a", D(2020, 1, 1), 10.0, 11.0, 9.0)], "symbol string, entry_date date, entry double, target double, stop double")
    assert books.first_touch(trade, b, 2, True).first()["outcome"] == "target"
    assert books.first_touch(trade, b, 2, False).first()["outcome"] == "stop"


def test_drawdown_multiplier_thresholds(spark):
    got = [spark.range(1).select(books.drawdown_multiplier(F.lit(x))).first()[0] for x in (0.05, 0.12, 0.18, 0.30)]
    assert got == [1.0, 0.75, 0.5, 0.25]


def test_weight_shrink(spark):
    rows = spark.createDataFrame([(0, 0.35, 0.5, 50), (0, 0.65, 0.9, 29)], "group int, prior double, estimate double, n int")
    got = sorted(r["raw"] for r in books.shrink_weights(rows).collect())
    assert got == [0.37, 0.65] and abs(sum(r["weight"] for r in books.shrink_weights(rows).collect()) - 1) < 1e-12


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a", 1)], "k int, v string, s int"), spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k int, v string, s int")
    assert {(r["k"], r["v"]) for r in normalize.upsert(old, new, ["k"], "s").collect()} == {(1, "c"), (2, "d")}
    assert {(r["k"], r["v"]) for r in normalize.insert_ignore(old, new, ["k"], "s").collect()} == {(1, "a"), (2, "d")}


def test_adjusted_prices_invert(spark):
    t = Tables(spark, SF)
    raw, adj = t.bars.select("symbol", "date", F.col("close").alias("raw")), composites.split_adjust(t.bars, t.corporate_actions)
    assert raw.join(adj, ["symbol", "date"]).where("abs(raw - close / adj_factor) > 1e-6").count() == 0
    assert adj.count() == t.bars.count()


def test_registry_is_consistent():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and len(registry.QUERIES) > 200


SWEEP = [
    "win_returns", "win_rsi", "rank_qcut_decile", "agg_breadth_daily", "agg_universe_window", "agg_window_stats", "asof_backward", "join_next_rebalance",
    "membership_islands", "options_max_pain", "bt_decile_book", "bt_walkforward_gate", "reco_first_touch", "risk_equity_curve", "sink_upsert", "stream_bars",
]


@pytest.mark.parametrize("name", SWEEP)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)

    def flat(frame):
        text = frame[columns].astype(object).map(lambda v: "" if pd.isna(v) else f"{v:.5g}" if isinstance(v, float) else str(v)[:10])
        return sorted(map(tuple, text.to_numpy()))

    assert flat(got) == flat(want)
