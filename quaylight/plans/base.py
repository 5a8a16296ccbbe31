"""Registration of queries and the views of the driver's tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ticks: one symbol for each type of event.
TICKS_SQL = "ticks AS (SELECT event_id, event_type AS symbol, ts, value AS close, user_id, props FROM events)"
#: Hourly bars of the ticks.
BARS_SQL = TICKS_SQL + """,
hours AS (SELECT symbol, (epoch_us(ts) // 3600000000) * 3600 AS bucket_s, ts, close FROM ticks),
bars AS (SELECT symbol, bucket_s, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low,
  arg_max(close, ts) AS close, count(*) AS n FROM hours GROUP BY symbol, bucket_s)"""
DAYS_SQL = TICKS_SQL + """,
days AS (SELECT symbol, (epoch_us(ts) // 86400000000) AS day, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low,
  arg_max(close, ts) AS close, count(*) AS n FROM ticks GROUP BY ALL)"""
#: Monthly observations of one series for each order priority.
SERIES_SQL = """series AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS observed_at,
  round(avg(o_totalprice), 4) AS value, count(*) AS n FROM orders GROUP BY ALL)"""
#: Option contracts: strikes near the symbol's mean price, open interest and volume from the sales of a part.
CHAIN_SQL = """chain AS (SELECT p_brand AS symbol, p_partkey AS contract, p_retailprice AS strike, p_size AS dte,
  CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, round(p_retailprice / 100, 4) AS bid,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE round(p_retailprice / 90, 4) END AS ask, round(p_retailprice / 95, 4) AS last,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE round(0.1 + (p_partkey % 50) / 100.0, 4) END AS iv,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 1000 END AS volume FROM part),
spot AS (SELECT symbol, round(avg(strike), 4) AS spot FROM chain GROUP BY symbol)"""

#: Weekdays on which the venue stays closed in the months of the events, for the SQL side; the operator derives them by rule.
CALENDAR_SQL = """days AS (SELECT day::DATE AS day, isodow(day) < 6 AND day NOT IN (DATE '2023-12-25', DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19') AS open FROM range(DATE '2023-12-01', DATE '2024-03-02', INTERVAL 1 DAY) t(day)),
calendar AS (SELECT day, open, coalesce(sum(CASE WHEN open THEN 390 ELSE 0 END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM days)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"), "user_id", "props")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("observed_at"), "o_totalprice")
    return orders.groupBy("series_id", "observed_at").agg(F.round(F.avg("o_totalprice"), 4).alias("value"), F.count("*").alias("n"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"), key.alias("contract"), F.col("p_retailprice").alias("strike"), F.col("p_size").alias("dte"),
        F.when(key % 2 == 0, "call").otherwise("put").alias("kind"), F.round(F.col("p_retailprice") / 100, 4).alias("bid"),
        F.when(key % 7 != 0, F.round(F.col("p_retailprice") / 90, 4)).alias("ask"), F.round(F.col("p_retailprice") / 95, 4).alias("last"),
        F.when(key % 11 != 0, F.round(0.1 + (key % 50) / 100.0, 4)).alias("iv"), F.when(key % 13 != 0, key % 1000).alias("volume"),
    )
