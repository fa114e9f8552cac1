"""Registration of queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under name, with DuckDB SQL for the same rows."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded (and -0.0 made 0.0), other columns as they are."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


#: user_day and supplier_month as DuckDB has them.
USER_DAY = """
p0 as (select user_id::varchar as symbol, ts::date as date, first(value order by ts, event_id) as open, max(value) as high, min(value) as low,
  last(value order by ts, event_id) as close, count(value)::double as volume, sum(value) as amount from events group by 1, 2),
p1 as (select *, amount / nullif(volume, 0) as vwap, close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as "return" from p0),
p as (select *, lead("return") over (partition by symbol order by date) as forward_return from p1)
"""
SUPPLIER_MONTH = """
s0 as (select l_suppkey as k, date_trunc('month', l_shipdate)::date as date, l_extendedprice / nullif(l_quantity, 0) as u, * from lineitem),
s1 as (select k, date, first(u order by l_shipdate, l_orderkey, l_linenumber) as open, max(u) as high, min(u) as low, last(u order by l_shipdate, l_orderkey, l_linenumber) as close,
  sum(l_quantity) as volume, sum(l_extendedprice) as amount from s0 group by 1, 2),
s2 as (select s1.*, s1.k::varchar as symbol, amount / nullif(volume, 0) as vwap, s_nationkey::varchar as sector, case when s_acctbal > 0 then s_acctbal end as market_cap,
  close / nullif(lag(close) over (partition by k order by date), 0) - 1 as "return" from s1 left join supplier on s_suppkey = k),
p as (select *, lead("return") over (partition by symbol order by date) as forward_return from s2)
"""
W = "partition by symbol order by date"


def last(n: int) -> str:
    return f"({W} rows between {n - 1} preceding and current row)"
