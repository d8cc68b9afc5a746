"""Domain views over the driver's tables, as SQL that Spark and DuckDB both run.

`{name}` stands for a table or an earlier view. Views are lazy: Spark plans a
query over views as one plan, so filters and columns reach the Parquet scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .scratch import Scratch

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "bars": """
        SELECT symbol, date, min_by(price, k) AS open, max(price) AS high, min(price) AS low, max_by(price, k) AS close, sum(q) AS volume
        FROM (SELECT CAST(l_suppkey AS STRING) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS q,
                     (l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k FROM {lineitem})
        GROUP BY symbol, date""",
    "delivery": """
        SELECT CAST(l_suppkey AS STRING) AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS total_traded_qty,
               sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS delivery_qty,
               100 * sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS delivery_percent
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "corporate_actions": """
        SELECT CAST(l_suppkey AS STRING) AS symbol, CAST(l_shipdate AS DATE) AS date,
               CASE l_returnflag WHEN 'N' THEN 'SPLIT' WHEN 'A' THEN 'BONUS' ELSE 'DIVIDEND' END AS action_type,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '2:1' WHEN l_returnflag = 'N' THEN '5:1'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '1:1' WHEN l_returnflag = 'A' THEN '1:2' END AS ratio,
               CASE WHEN l_returnflag = 'R' THEN 0.01 * l_extendedprice / l_quantity END AS amount
        FROM {lineitem} WHERE l_linenumber = 1 AND l_tax = 0.08""",
    "sector_map": """
        SELECT CAST(s_suppkey AS STRING) AS symbol, s_name AS company, n_name AS sector, r_name AS macro
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "index_series": "SELECT date, avg(close) AS close, count(*) AS n FROM {bars} GROUP BY date",
    "month_ends": "SELECT max(date) AS rebal_date FROM (SELECT DISTINCT date FROM {bars}) GROUP BY date_trunc('month', date)",
    "statements": """
        SELECT symbol, quarter, net_income, revenue, n_orders, CAST(quarter + INTERVAL 90 DAY AS DATE) AS report_date,
               CAST(quarter + INTERVAL 135 DAY AS DATE) AS pit_date
        FROM (SELECT CAST(o_custkey AS STRING) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
                     sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS net_income, sum(o_totalprice) AS revenue,
                     count(*) AS n_orders FROM {orders} GROUP BY 1, 2)""",
    "option_chain": """
        SELECT date, symbol, strike, option_typ, CAST(date + CAST(30 * (1 + e) AS INTEGER) AS DATE) AS expiry,
               sum(q) AS open_int, avg(price) AS close, count(*) AS contracts
        FROM (SELECT last_day(CAST(l_shipdate AS DATE)) AS date, CAST(l_suppkey AS STRING) AS symbol, CAST(p_size AS DOUBLE) AS strike,
                     CASE WHEN l_linenumber % 2 = 1 THEN 'CE' ELSE 'PE' END AS option_typ, l_linenumber % 3 AS e,
                     l_quantity AS q, l_extendedprice / l_quantity AS price
              FROM {lineitem} JOIN {part} ON l_partkey = p_partkey)
        GROUP BY date, symbol, strike, option_typ, e""",
    "insider_trades": """
        SELECT event_id, CAST(user_id % 20 AS STRING) AS symbol, CAST(ts AS DATE) AS filing_date, props AS name, value * 1000000 AS value,
               CASE event_type WHEN 'purchase' THEN 'Buy' WHEN 'error' THEN 'Pledge' WHEN 'click' THEN 'Sell' ELSE 'Other' END AS transaction_type,
               CASE user_id % 4 WHEN 0 THEN 'Promoters' WHEN 1 THEN 'Promoter Group' WHEN 2 THEN 'Director' ELSE 'Employee' END AS category
        FROM {events}""",
    "filings": """
        SELECT o_orderkey AS filing_id, CAST(o_custkey AS STRING) AS scrip, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
               CAST(o_orderdate AS DATE) AS broadcast, o_totalprice AS amount, o_orderpriority AS segment, o_orderstatus AS status
        FROM {orders}""",
    "trades": """
        SELECT o_orderkey AS trade_id, CAST(o_custkey % 10 AS STRING) AS strategy, CAST(o_orderdate AS DATE) AS exit_date,
               o_totalprice AS entry_price, o_totalprice * 0.95 AS stop,
               CASE o_orderstatus WHEN 'F' THEN 'target' WHEN 'O' THEN 'stop' ELSE 'expired' END AS outcome,
               CASE o_orderstatus WHEN 'F' THEN 0.06 WHEN 'O' THEN -0.04 ELSE 0.01 END + (o_orderkey % 7 - 3) / 200.0e0 AS realized
        FROM {orders}""",
}


#: How Spark makes a view, where the plan of its text above shuffles more than the view needs; the rows are the same.
#: The lines of a symbol are brought together once, before they become bars, and the windows per symbol find them so.
IN_SPARK = {
    "bars": VIEWS["bars"].replace("(SELECT CAST(l_suppkey", "(SELECT /*+ REPARTITION(symbol) */ * FROM (SELECT CAST(l_suppkey").replace("FROM {lineitem})", "FROM {lineitem}))"),
    "delivery": """
        SELECT symbol, date, sum(q) AS total_traded_qty, sum(d) AS delivery_qty, 100 * sum(d) / sum(q) AS delivery_percent
        FROM (SELECT /*+ REPARTITION(symbol) */ * FROM (SELECT CAST(l_suppkey AS STRING) AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS q,
                     CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS d FROM {lineitem})) GROUP BY symbol, date""",
    "option_chain": VIEWS["option_chain"].replace("(SELECT last_day", "(SELECT /*+ REPARTITION({parts}, symbol) */ * FROM (SELECT last_day").replace("= p_partkey)", "= p_partkey))"),
    "month_ends": "SELECT max(date) AS rebal_date FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM {lineitem}) GROUP BY date_trunc('month', date)",
}


class Tables:
    """The tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = IN_SPARK.get(name, VIEWS[name]).replace("{parts}", self.spark.conf.get("spark.sql.shuffle.partitions"))
                needed = {n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", text)}
                sql = text.replace("CAST(date + CAST(30 * (1 + e) AS INTEGER) AS DATE)", "date_add(date, CAST(30 * (1 + e) AS INTEGER))")
                self._made[name] = self.spark.sql(sql, **needed)
        return self._made[name]

    def stored(self, *names: str) -> Tables:
        """These tables with views of a row per symbol and date written once, bucketed by symbol: for queries that read them often."""
        made = Tables(self.spark, self.sf_dir)
        for name in names:
            made._made[name] = Scratch(self.spark).written(getattr(made, name), name, by="symbol", order="date")
        return made


def with_views(names: str, body: str, doubles: str = "", digits: int = 6) -> str:
    """SQL for DuckDB: the named views as CTEs before `body`, with its double columns rounded."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
            if n in VIEWS:
                add(n)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        add(n)
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in ordered]
    if doubles or body.startswith("WITH"):
        rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles.split())
        body = re.sub(r"^WITH ", "WITH RECURSIVE ", body)
        ctes.append(f"_body AS ({body})")
        body = f"SELECT * REPLACE ({rounded}) FROM _body" if doubles else "SELECT * FROM _body"
    return ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + body
