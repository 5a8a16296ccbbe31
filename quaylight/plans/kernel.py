"""Latest rows, as-of joins, aggregates and predicates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions.times import bucket, micros
from quaylight.operators import asof, keys, market
from quaylight.plans.base import TICKS_SQL, query, table, ticks
from quaylight.sources.buckets import Buckets
from quaylight.sources.scratch import Scratch


def _ohlc_sql(seconds: int) -> str:
    return f"""WITH {TICKS_SQL}
SELECT symbol, (epoch_us(ts) // {seconds * 1_000_000}) * {seconds} AS bucket_s, arg_min(close, ts) AS open, max(close) AS high,
  min(close) AS low, arg_max(close, ts) AS close, count(*) AS n FROM ticks GROUP BY ALL"""


@query(_ohlc_sql(300))
def agg09_ohlcv_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ohlc(ticks(spark, sf_dir), 300)


@query(_ohlc_sql(3600))
def agg09_ohlcv_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.coarser(market.ohlc(ticks(spark, sf_dir), 300), 3600)


@query(_ohlc_sql(86400))
def agg09_ohlcv_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ohlc(ticks(spark, sf_dir), 86400)


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def win01_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return keys.top_n(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, rank="place")


@query("""SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def win02_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return keys.latest_by(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query("""SELECT symbol, event_id, close, prev, close - prev AS change FROM (SELECT event_type AS symbol, event_id, value AS close,
  lag(value) OVER w AS prev, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE rn = 1""")
def win03_lag_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = keys.top_n(ticks(spark, sf_dir), ["symbol"], [F.desc("ts"), F.desc("event_id")], 2, rank="rn")
    both = last.groupBy("symbol").agg(F.max_by("event_id", -F.col("rn")).alias("event_id"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("prev"))
    return both.withColumn("change", F.col("close") - F.col("prev"))


@query("""SELECT event_type AS symbol, (epoch_us(ts) // 900000000) * 900 AS bucket_s, arg_max(value, ts) AS close FROM events GROUP BY ALL""")
def win04_bucket_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol", bucket("ts", 900).alias("bucket_s")).agg(F.max_by("close", "ts").alias("close"))


@query("""WITH r AS (SELECT event_type AS symbol, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT symbol, round(sum(value) FILTER (rn <= 12), 6) AS recent, round(sum(value) FILTER (rn > 12 AND rn <= 24), 6) AS before FROM r WHERE rn <= 24 GROUP BY symbol""")
def win05_row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = keys.top_n(ticks(spark, sf_dir), ["symbol"], [F.desc("ts"), F.asc("event_id")], 24, rank="rn")
    part = lambda on: F.round(F.sum(F.when(on, F.col("close"))), 6)
    return r.groupBy("symbol").agg(part(F.col("rn") <= 12).alias("recent"), part(F.col("rn") > 12).alias("before"))


@query("""SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS turn
  FROM documents) ORDER BY turn, doc_id DESC LIMIT 30""")
def win06_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], [F.desc("doc_id")], 30)


@query("""SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey""")
def win10_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return keys.latest_by(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")])


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
  ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, round(sum(round(o_totalprice * 100) * pow(2.0, 21 - rn)) / 104857600, 1) AS mass, count(*) AS n FROM r GROUP BY o_custkey""")
def win11_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w))
    # whole numbers of cents times powers of two: their sum is the same in any order
    cents = F.sum(F.round(F.col("o_totalprice") * 100) * F.pow(F.lit(2.0), 21 - F.col("rn")))
    return r.groupBy("o_custkey").agg(F.round(cents / 104857600, 1).alias("mass"), F.count("*").alias("n"))


def _signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).filter("symbol = 'signup'").select("event_id", "ts")
    return rows.crossJoin(F.broadcast(spark.createDataFrame([("click",), ("view",)], "symbol string")))


PAIRS_SQL = TICKS_SQL + """,
asks AS (SELECT event_id, ts, i.symbol FROM (SELECT event_id, ts FROM ticks WHERE symbol = 'signup'), (VALUES ('click'), ('view')) i(symbol))"""
QUOTES = ["close"]


@query(f"""WITH {PAIRS_SQL}
SELECT a.event_id, a.ts, a.symbol, t.ts AS tick_ts, t.close FROM asks a LEFT JOIN LATERAL
  (SELECT ts, close FROM ticks t WHERE t.symbol = a.symbol AND t.ts < a.ts ORDER BY t.ts DESC, t.close DESC LIMIT 1) t ON true""")
def jon04_asof_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_before(_signups(spark, sf_dir), ticks(spark, sf_dir), ["symbol"], "ts", QUOTES).select("event_id", "ts", "symbol", "tick_ts", "close")


@query(f"""WITH {PAIRS_SQL}
SELECT a.event_id, a.ts, a.symbol, t.ts AS tick_ts, t.close FROM asks a LEFT JOIN LATERAL
  (SELECT ts, close FROM ticks t WHERE t.symbol = a.symbol AND t.ts >= a.ts + INTERVAL 5 MINUTE AND t.ts <= a.ts + INTERVAL 10 MINUTE
   ORDER BY t.ts, t.close LIMIT 1) t ON true""")
def jon05_asof_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_after(_signups(spark, sf_dir), ticks(spark, sf_dir), ["symbol"], "ts", QUOTES, seconds=300, offset_seconds=300).select("event_id", "ts", "symbol", "tick_ts", "close")


@query(f"""WITH {PAIRS_SQL}
SELECT a.event_id, a.ts, a.symbol, t.ts AS tick_ts, t.close FROM asks a LEFT JOIN LATERAL
  (SELECT ts, close FROM ticks t WHERE t.symbol = a.symbol AND t.ts <= a.ts + INTERVAL 60 MINUTE AND t.ts >= a.ts + INTERVAL 45 MINUTE
   ORDER BY t.ts DESC, t.close LIMIT 1) t ON true""")
def jon06_asof_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_until(_signups(spark, sf_dir), ticks(spark, sf_dir), ["symbol"], "ts", QUOTES, seconds=900, offset_seconds=3600).select("event_id", "ts", "symbol", "tick_ts", "close")


@query(f"""WITH {PAIRS_SQL}
SELECT a.event_id, a.ts, a.symbol, t.ts AS tick_ts, t.close FROM asks a LEFT JOIN LATERAL
  (SELECT ts, close FROM ticks t WHERE t.symbol = a.symbol AND abs(epoch_us(t.ts) - epoch_us(a.ts)) <= 600000000
   ORDER BY abs(epoch_us(t.ts) - epoch_us(a.ts)), t.ts, t.close LIMIT 1) t ON true""")
def jon07_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.nearest(_signups(spark, sf_dir), ticks(spark, sf_dir), ["symbol"], "ts", QUOTES, seconds=600).select("event_id", "ts", "symbol", "tick_ts", "close")


@query(f"""WITH {PAIRS_SQL}
SELECT a.event_id, a.ts, a.symbol, t.ts AS tick_ts, t.close FROM asks a LEFT JOIN LATERAL
  (SELECT ts, close FROM ticks t WHERE t.symbol = a.symbol AND t.ts <= a.ts AND epoch_us(a.ts) - epoch_us(t.ts) <= 1200000000
   ORDER BY t.ts DESC, t.close DESC LIMIT 1) t ON true""")
def jon08_asof_max_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_before(_signups(spark, sf_dir), ticks(spark, sf_dir), ["symbol"], "ts", QUOTES, strict=False, seconds=1200).select("event_id", "ts", "symbol", "tick_ts", "close")


@query("""SELECT c.c_custkey, o.o_orderkey AS last_order, o.o_totalprice AS last_price, p.o_totalprice AS prev_price FROM customer c
LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true
LEFT JOIN LATERAL (SELECT o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 1) p ON true""")
def jon09_lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = keys.top_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, rank="rn")
    at = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    both = two.groupBy("o_custkey").agg(at("o_orderkey", 1).alias("last_order"), at("o_totalprice", 1).alias("last_price"), at("o_totalprice", 2).alias("prev_price"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(both, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query("""SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), ',') AS top_orders FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5 GROUP BY o_custkey""")
def jon12_top_n_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = keys.top_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, rank="rn")
    listed = F.array_sort(F.collect_list(F.struct("rn", "o_orderkey")))["o_orderkey"]
    return top.groupBy("o_custkey").agg(F.array_join(listed.cast("array<string>"), ",").alias("top_orders"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""")
def jon13_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def jon14_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_semi")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def jon15_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(open_, "c_custkey", "left_anti")


@query("""WITH t AS (SELECT c_custkey AS id, c_name AS company, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'S' || (c_custkey // 3) END AS symbol,
  CASE WHEN c_acctbal > 4500 THEN 'long' ELSE 'short' END AS direction, c_mktsegment AS horizon FROM customer)
SELECT a.id, a.symbol, a.direction, a.horizon FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.horizon = a.horizon AND b.direction <> a.direction
  AND ((a.symbol <> '' AND b.symbol = a.symbol) OR (a.symbol = '' AND b.symbol = '' AND b.company = a.company)))""")
def jon16_opposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("company"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("S"), F.floor(key / 3).cast("string"))).alias("symbol"),
        F.when(F.col("c_acctbal") > 4500, "long").otherwise("short").alias("direction"), F.col("c_mktsegment").alias("horizon"),
    )
    # one key for both branches, and the direction looked for, make this an equi-join
    subject = F.when(F.col("symbol") != "", F.concat(F.lit("s:"), F.col("symbol"))).otherwise(F.concat(F.lit("c:"), F.col("company")))
    t = t.withColumn("subject", subject)
    other = t.select("subject", "horizon", F.when(F.col("direction") == "long", "short").otherwise("long").alias("direction"))
    return t.join(other, ["subject", "horizon", "direction"], "left_semi").select("id", "symbol", "direction", "horizon")


@query("""SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers,
  (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS best FROM nation""")
def jon18_scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    best = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("best"))
    return nation.join(customers, "n_nationkey", "left").join(best, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), "best")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, min(ts) FILTER (value > 90) AS first_peak,
  count(*) FILTER (user_id % 2 = 0) AS even_users FROM events GROUP BY event_type""")
def agg02_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.min(F.when(F.col("value") > 90, F.col("ts"))).alias("first_peak"), F.count_if(F.col("user_id") % 2 == 0).alias("even_users"))


@query("""SELECT l_returnflag, count(DISTINCT (l_suppkey, l_linestatus)) AS pairs, count(*) - count(DISTINCT (l_suppkey, l_linestatus)) AS repeats
FROM lineitem GROUP BY l_returnflag""")
def agg03_tuple_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linestatus").agg(F.count("*").alias("n"))
    return one.groupBy("l_returnflag").agg(F.count("*").alias("pairs"), (F.sum("n") - F.count("*")).alias("repeats"))


@query("""SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey
HAVING count(*) = 3 AND abs(sum(l_quantity) - 75) < 20""")
def agg04_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("q"))
    return g.filter((F.col("lines") == 3) & (F.abs(F.col("q") - 75) < 20)).select("l_orderkey", "lines", F.round("q", 2).alias("quantity"))


@query("""SELECT user_id, bool_or(event_type = 'purchase') AS bought, bool_and(value > 1) AS all_above FROM events GROUP BY user_id""")
def agg05_bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_and(F.col("value") > 1).alias("all_above"))


@query("""SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type, arg_max(value, ts) AS last_value FROM events GROUP BY user_id""")
def agg06_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "ts").alias("first_type"), F.max_by("event_type", "ts").alias("last_type"), F.max_by("value", "ts").alias("last_value"))


@query("""WITH holds AS (SELECT o_custkey, sum(o_totalprice) AS held FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey),
done AS (SELECT o_custkey, sum(o_totalprice) AS settled FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT h.o_custkey, round(greatest(held - coalesce(settled, 0), 0), 2) AS outstanding FROM holds h LEFT JOIN done d ON d.o_custkey IS NOT DISTINCT FROM h.o_custkey""")
def agg10_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    both = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(part("O").alias("held"), part("F").alias("settled")).filter("held is not null")
    return both.select("o_custkey", F.round(F.greatest(F.col("held") - F.coalesce("settled", F.lit(0.0)), F.lit(0.0)), 2).alias("outstanding"))


@query("""SELECT c_mktsegment AS sector, n_name AS country, count(*) AS holdings, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 8) AS weight
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def agg11_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    total = c.agg(F.sum("c_acctbal").alias("total"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    g = c.groupBy("c_nationkey", F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("holdings"), F.sum("c_acctbal").alias("w"))
    return g.join(nation, "c_nationkey").crossJoin(F.broadcast(total)).select("sector", "country", "holdings", F.round(F.col("w") / F.col("total"), 8).alias("weight"))


@query("""SELECT l_shipmode_key, median(l_extendedprice) AS mid, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM
(SELECT l_suppkey % 10 AS l_shipmode_key, l_extendedprice FROM lineitem) GROUP BY 1""")
def agg12_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("l_shipmode_key"), "l_extendedprice")
    return keys.exact_percentiles(l, ["l_shipmode_key"], "l_extendedprice", {"mid": 0.5, "p95": 0.95}).withColumn("p95", F.round("p95", 6))


@query("""SELECT event_type, round(stddev_pop(value), 8) AS sd_pop, round(stddev_samp(value), 8) AS sd_samp FROM events GROUP BY event_type""")
def agg13_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.stddev_pop("value"), 8).alias("sd_pop"), F.round(F.stddev_samp("value"), 8).alias("sd_samp"))


@query("""WITH last AS (SELECT event_type, arg_max(value, ts) AS x, count(*) AS n FROM events GROUP BY event_type)
SELECT l.event_type, l.n, round(count(*) FILTER (e.value <= l.x) / l.n, 8) AS ecdf FROM last l JOIN events e USING (event_type) GROUP BY l.event_type, l.n, l.x""")
def agg15_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    last = e.groupBy("event_type").agg(F.max_by("value", "ts").alias("x"))
    return e.join(last, "event_type").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") <= F.col("x"), 1.0).otherwise(0.0)), 8).alias("ecdf"))


@query("""SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM
(SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) WHERE rn <= 2""")
def agg16_top_k_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return keys.top_n(g, ["c_nationkey"], [F.desc("n"), F.asc("c_mktsegment")], 2)


@query("""WITH p AS (SELECT (o_orderkey % 100) / 100.0 AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS hit FROM orders)
SELECT least(4, greatest(0, floor(p * 5)))::INT AS bin, count(*) AS n, round(avg(p), 8) AS forecast, round(avg(hit), 8) AS realised,
  round(avg((p - hit) * (p - hit)), 8) AS brier FROM p GROUP BY 1""")
def agg18_brier_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") % 100) / 100.0).alias("p"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("hit"))
    b = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("p") * 5))).cast("int").alias("bin")
    gap = F.col("p") - F.col("hit")
    return p.groupBy(b).agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("forecast"), F.round(F.avg("hit"), 8).alias("realised"), F.round(F.avg(gap * gap), 8).alias("brier"))


@query("""WITH f AS (SELECT user_id, min(ts) AS first_seen, min(ts) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY user_id)
SELECT strftime(first_seen, '%Y-%m') AS cohort, count(*) AS users, count(bought) AS converted, round(count(bought) / count(*), 8) AS rate,
  median(date_diff('day', first_seen::DATE, bought::DATE)) AS median_days FROM f GROUP BY 1""")
def agg19_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("bought"))
    days = F.datediff(F.to_date("bought"), F.to_date("first_seen"))
    g = f.groupBy(F.date_format("first_seen", "yyyy-MM").alias("cohort"))
    return g.agg(F.count("*").alias("users"), F.count("bought").alias("converted"), F.round(F.count("bought") / F.count("*"), 8).alias("rate"), F.median(days).alias("median_days"))


@query("""SELECT o_orderkey, o_custkey, place FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0
  WHEN '2-HIGH' THEN 1 ELSE 2 END, nullif(o_totalprice, 0) DESC NULLS LAST, o_orderkey) AS place FROM orders) WHERE place > 20 AND place <= 40""")
def srt01_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    page = table(spark, sf_dir, "orders").orderBy(rank, F.nullif("o_totalprice", F.lit(0.0)).desc_nulls_last(), "o_orderkey").limit(40)
    page = page.withColumn("place", F.row_number().over(Window.orderBy(rank, F.nullif("o_totalprice", F.lit(0.0)).desc_nulls_last(), "o_orderkey")))
    return page.filter("place > 20").select("o_orderkey", "o_custkey", "place")


@query("""SELECT 'view' AS log, event_id AS id, ts, value, CAST(NULL AS BIGINT) AS user_id FROM events WHERE event_type = 'view'
UNION ALL SELECT 'error', event_id, ts, NULL, user_id FROM events WHERE event_type = 'error'""")
def set01_union_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = e.filter("event_type = 'view'").select(F.lit("view").alias("log"), F.col("event_id").alias("id"), "ts", "value")
    two = e.filter("event_type = 'error'").select(F.lit("error").alias("log"), F.col("event_id").alias("id"), "ts", "user_id")
    return one.unionByName(two, allowMissingColumns=True)


@query(f"""WITH {TICKS_SQL}, h AS (SELECT DISTINCT symbol, (epoch_us(ts) // 3600000000) AS hour FROM ticks),
r AS (SELECT symbol, min(hour) AS a, max(hour) AS b FROM h GROUP BY symbol), x AS (SELECT symbol, unnest(range(a, b + 1)) AS hour FROM r)
SELECT symbol, hour FROM x ANTI JOIN h USING (symbol, hour)""")
def set05_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ticks(spark, sf_dir).select("symbol", F.floor(micros("ts") / 3_600_000_000).alias("hour")).distinct()
    wanted = h.groupBy("symbol").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("symbol", F.explode(F.sequence("a", "b")).alias("hour"))
    return wanted.join(h, ["symbol", "hour"], "left_anti")


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events
WHERE CAST(json_extract_string(props, '$.k') AS INT) IN (1, 3, 5, 7) GROUP BY ALL""")
def flt07_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.filter(F.col("k").isin(1, 3, 5, 7)).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS p, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS p, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT a.p, n, top FROM a JOIN b ON a.p IS NOT DISTINCT FROM b.p""")
def flt08_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p"), "o_totalprice")
    a, b = o.groupBy("p").agg(F.count("*").alias("n")), o.groupBy(F.col("p").alias("q")).agg(F.max("o_totalprice").alias("top"))
    return a.join(b, a["p"].eqNullSafe(b["q"])).select("p", "n", "top")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderstatus, o_orderpriority) IN
(SELECT c_custkey, 'O', '1-URGENT' FROM customer WHERE c_acctbal > 5000) AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def flt09_tuple_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ'1995-01-01' AND o_orderdate < TIMESTAMP_NTZ'1997-01-01'")
    wanted = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"))
    return o.join(wanted, ["o_custkey", "o_orderstatus", "o_orderpriority"], "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events
WHERE ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL (event_id % 72) HOUR <= TIMESTAMP '2024-01-15') WHERE rn = 1""")
def flt10_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("known_at", F.expr("ts + make_dt_interval(0, cast(event_id % 72 as int))"))
    known = keys.as_known(e, F.lit("2024-01-15").cast("timestamp_ntz"), "ts", "known_at")
    return keys.latest_by(known.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.asc("event_id")])


@query("""WITH old AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0),
new AS (SELECT s_suppkey AS k, round(s_acctbal * 2, 2) AS v FROM supplier WHERE s_suppkey % 2 = 0)
SELECT k, v FROM old ANTI JOIN new USING (k) UNION ALL SELECT k, v FROM new""")
def snk01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return keys.upsert(s.filter("k % 3 <> 0"), s.filter("k % 2 = 0").withColumn("v", F.round(F.col("v") * 2, 2)), ["k"])


@query("""WITH old AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), new AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderkey % 50 = 1 UNION ALL SELECT -c_custkey, c_acctbal FROM customer WHERE c_custkey % 40 = 0 AND c_custkey > 0)
SELECT k, v FROM (SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new) WHERE k < 0 OR k % 90 <> 0""")
def snk01_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets: written, a part replaced, new keys added, some deleted; a batch that is run twice counts once."""
    orders, customers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), table(spark, sf_dir, "customer")
    target = Buckets(spark, Scratch(spark, "snk01").path("t"), ["k"], 32)
    target.upsert(orders, writer="load", batch=0)
    more = orders.filter("k % 50 = 1").withColumn("v", F.col("v") * 2).unionByName(customers.filter("c_custkey % 40 = 0 and c_custkey > 0").select((-F.col("c_custkey")).alias("k"), F.col("c_acctbal").alias("v")))
    target.upsert(more, writer="load", batch=1)
    target.upsert(more.withColumn("v", F.lit(0.0)), writer="load", batch=1)
    target.delete(orders.filter("k % 90 = 0"))
    target.vacuum()
    return target.read()


@query("""WITH old AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0),
new AS (SELECT s_suppkey AS k, 0.0 AS v FROM supplier WHERE s_suppkey % 2 = 0)
SELECT k, v FROM old UNION ALL SELECT k, v FROM new ANTI JOIN old USING (k)""")
def snk02_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return keys.insert_missing(s.filter("k % 3 <> 0"), s.filter("k % 2 = 0").withColumn("v", F.lit(0.0)), ["k"], [F.asc("v")])


@query("""SELECT k, max(v) AS v FROM (SELECT s_nationkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer) GROUP BY k""")
def snk04_upsert_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    return keys.upsert_greatest(s, c, ["k"], "v")


@query("""WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS before FROM events),
v AS (SELECT user_id, ts, event_type FROM e WHERE before IS DISTINCT FROM event_type)
SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to, row_number() OVER w AS version, lead(ts) OVER w IS NULL AS is_current FROM v
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)""")
def snk06_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return keys.versions(e, ["user_id"], "ts", "event_type").select("user_id", "event_type", "valid_from", "valid_to", "version", "is_current")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision_of FROM e WHERE before IS DISTINCT FROM event_type""")
def snk07_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return keys.revisions(e, ["user_id"], "ts", "event_type", "event_id").select("user_id", "event_id", "event_type", "revision_of")


@query("""SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def snk09_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.retain(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 7)
