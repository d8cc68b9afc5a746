"""One test for each settled finding of the fourth round."""

import duckdb
import pytest

from tapewright.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def by_sql(name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return sorted(con.execute(ORACLES[name]).fetchall())


@pytest.fixture
def few_parts(spark):
    """So few parts that the bars' are merged otherwise than the marks'."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_f1_bars_and_month_ends_of_a_symbol_stay_together(few_parts):
    got = sorted(tuple(r) for r in QUERIES["agg_universe_window"](few_parts, SF).collect())
    assert got and got == by_sql("agg_universe_window")


def test_f2_segments_keep_their_members(few_parts):
    got = sorted(tuple(r) for r in QUERIES["membership_consumable"](few_parts, SF).collect())
    assert got and got == by_sql("membership_consumable")


def test_f3_universe_has_all_names_ranked_as_in_the_sql(few_parts):
    from tapewright.plans.composites import pit_universe

    got = sorted(tuple(r) for r in QUERIES["pit_universe"](few_parts, SF).collect())
    assert got and got == by_sql("pit_universe")
    rows = [(1, "a", 10, 0.0001), (1, "b", 10, 0.00015), (1, "c", 10, 29999.99997)]  # in binary 0.00015 is below the half
    window = few_parts.createDataFrame(rows, "rebal_date int, symbol string, n_days int, med_turnover double")
    assert [(r.symbol, r.adv_rank, r.liquid) for r in pit_universe(window).orderBy("adv_rank").collect()] == [("c", 1, 0), ("a", 2, 0), ("b", 3, 0)]


def test_f6_best_and_worst_windows_of_all_horizons(spark):
    import datetime as dt
    import random

    from tapewright.operators import stats as A

    got = sorted(tuple(r) for r in QUERIES["agg_window_extremes"](spark, SF).collect())
    assert got == by_sql("agg_window_extremes")
    assert {(r[1], r[2]) for r in got} >= {(h, d) for h in (1, 30) for d in ("up", "down")}
    random.seed(2)
    rows = [(s, dt.date(1995, 1, 1) + dt.timedelta(days=i), random.choice((1.0, 1.5, 2.0, 3.0))) for s in "ab" for i in range(40)]
    want = set()
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        for h in (1, 7, 30, 45):  # the last is longer than the series
            for d, sign in (("up", -1), ("down", 1)):
                every = sorted((sign * round(own[i + h][2] / own[i][2] - 1, 10), own[i][1], own[i + h][1]) for i in range(len(own) - h))
                want |= {(s, h, d, x[1], x[2], k + 1) for k, x in enumerate(every[:10])}
    made = A.window_extremes(spark.createDataFrame(rows, "symbol string, date date, close double"), horizons=(1, 7, 30, 45), directions=("up", "down"))
    assert {(r.symbol, r.horizon, r.direction, r.date, r.end_date, r.rank) for r in made.collect()} == want


def test_f7_every_fold_boosts_as_many_trees_as_the_ranker(spark, monkeypatch):
    import datetime as dt
    import random

    from pyspark.ml import regression

    from tapewright.operators import models as M

    asked, fit = [], regression.GBTRegressor.fit

    def few(self, rows):
        asked.append((self.getMaxIter(), self.getStepSize(), self.getMaxDepth()))
        return fit(self.setMaxIter(1), rows)

    monkeypatch.setattr(regression.GBTRegressor, "fit", few)
    random.seed(7)
    rows = [(dt.date(2015 + m // 12, m % 12 + 1, 28), str(k), random.random(), random.gauss(0, 1)) for m in range(63) for k in range(12)]
    got = M.walkforward_gbt(spark.createDataFrame(rows, "rebal_date date, symbol string, x double, fwd double"), ["x"], "fwd")
    assert len({r.learned_until for r in got.collect()}) == len(asked) == 3  # a fold for each 12 months after the first 36
    assert set(asked) == {(250, 0.03, 5)}
