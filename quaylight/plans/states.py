"""Market state over the driver's tables: returns, volatility, correlation, breadth, features and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions.numeric import band, percent_change, return_metric, sign_state
from quaylight.operators import keys, market
from quaylight.plans.base import BARS_SQL, DAYS_SQL, SERIES_SQL, TICKS_SQL, query, series, table, ticks
from quaylight.sources.buckets import Buckets
from quaylight.sources.scratch import Scratch

AS_OF = "2024-01-20 12:00:00"
HOUR, DAY = 3600, 86400


def bars(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    return market.ohlc(ticks(spark, sf_dir), seconds)


@query(f"""SELECT symbol, event_id, ts, close FROM (SELECT event_type AS symbol, event_id, ts, value AS close,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events
  WHERE isfinite(value) AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND ts <= TIMESTAMP '{AS_OF}') WHERE rn <= 50""")
def mkt01_recent_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = ticks(spark, sf_dir).filter(f"ts >= TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 3 DAY AND ts <= TIMESTAMP_NTZ'{AS_OF}' AND close < double('Infinity') AND close > double('-Infinity')")
    return keys.top_n(recent.select("symbol", "event_id", "ts", "close"), ["symbol"], [F.desc("ts"), F.asc("event_id")], 50)


@query(f"""WITH {DAYS_SQL}, p AS (SELECT symbol, day, close, CASE WHEN day % 5 = 0 THEN 0.0 ELSE lag(close) OVER (PARTITION BY symbol ORDER BY day) END AS prev FROM days)
SELECT symbol, day, CASE WHEN prev <> 0 THEN round(close / prev - 1, 8) END AS ret,
  CASE WHEN prev IS NULL THEN 'missing_data' WHEN prev = 0 THEN 'zero_denominator' END AS reason FROM p""")
def mkt02_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir, DAY).withColumn("day", F.expr(f"bucket_s div {DAY}"))
    w = market.Window.partitionBy("symbol").orderBy("day")
    prev = F.when(F.col("day") % 5 == 0, 0.0).otherwise(F.lag("close").over(w))
    out = days.withColumn("prev", prev).withColumn("m", return_metric("close", "prev"))
    return out.select("symbol", "day", F.round("m.value", 8).alias("ret"), F.col("m.reason").alias("reason"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY bucket_s) AS prev FROM bars)
SELECT symbol, CASE WHEN count(*) >= 2 AND min(close) > 0 THEN round(sqrt(sum(pow(ln(close / prev), 2))), 8) END AS volatility, count(*) AS n FROM r GROUP BY symbol""")
def mkt03_realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.realized_volatility(bars(spark, sf_dir)).withColumn("volatility", F.round("volatility", 8))


@query("""SELECT event_type AS symbol, CASE WHEN count(*) >= 2 THEN round((arg_max(value, ts) - avg(value)) / nullif(stddev_pop(value), 0), 6) END AS zscore, count(*) AS n
FROM events GROUP BY event_type""")
def mkt04_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.zscore_of_last(ticks(spark, sf_dir)).withColumn("zscore", F.round("zscore", 6))


@query(f"""WITH {DAYS_SQL} SELECT symbol, day, round((close - low) / nullif(high - low, 0), 8) AS position FROM days""")
def mkt05_hl_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.high_low_position(bars(spark, sf_dir, DAY))
    return out.select("symbol", F.expr(f"bucket_s div {DAY}").alias("day"), F.round("position", 8).alias("position"))


def _corr_sql(values: str) -> str:
    return f"""WITH {BARS_SQL}, v AS ({values}), p AS (SELECT a.symbol AS a, b.symbol AS b, a.x AS x, b.x AS y FROM v a JOIN v b ON a.bucket_s = b.bucket_s AND a.symbol < b.symbol)
SELECT a, b, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(x, y), 6) END AS correlation,
  CASE WHEN count(*) < 5 THEN 'insufficient_paired_samples' WHEN corr(x, y) IS NULL THEN 'constant_returns' END AS reason FROM p GROUP BY a, b"""


@query(_corr_sql("SELECT symbol, bucket_s, close AS x FROM bars"))
def mkt06_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.pair_correlations(bars(spark, sf_dir), value="close").withColumn("correlation", F.round("correlation", 6))


@query(_corr_sql("SELECT * FROM (SELECT symbol, bucket_s, close / lag(close) OVER (PARTITION BY symbol ORDER BY bucket_s) - 1 AS x FROM bars) WHERE x IS NOT NULL"))
def mkt07_returns_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.pair_correlations(market.returns(bars(spark, sf_dir))).withColumn("correlation", F.round("correlation", 6))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events),
c AS (SELECT user_id, max(value) FILTER (rn = 1) - max(value) FILTER (rn = 2) AS change FROM r WHERE rn <= 2 GROUP BY user_id)
SELECT user_id % 7 AS basket, count(*) FILTER (change > 0) AS advancing, count(*) FILTER (change < 0) AS declining, count(*) FILTER (change = 0) AS unchanged,
  count(change) AS total, round(count(*) FILTER (change > 0) / nullif(count(change), 0), 8) AS breadth FROM c GROUP BY 1""")
def mkt08_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = mkt13_changes(spark, sf_dir).select((F.col("user_id") % 7).alias("basket"), "change")
    return market.breadth(changes, "basket").withColumn("breadth", F.round("breadth", 8))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
SELECT user_id, max(value) FILTER (rn = 1) - max(value) FILTER (rn = 2) AS change FROM r WHERE rn <= 2 GROUP BY user_id""")
def mkt13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = keys.top_n(table(spark, sf_dir, "events").select("user_id", "ts", "value"), ["user_id"], [F.desc("ts")], 2, rank="rn")
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("value")))
    return two.groupBy("user_id").agg((at(1) - at(2)).alias("change"))


SPREADS = {"urgent_low": ("1-URGENT", "5-LOW"), "high_medium": ("2-HIGH", "3-MEDIUM"), "urgent_none": ("1-URGENT", "6-NONE")}


@query(f"""WITH {SERIES_SQL}, l AS (SELECT series_id, arg_max(value, observed_at) AS value FROM series GROUP BY series_id),
d(label, long_id, short_id) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in SPREADS.items())})
SELECT label, round(a.value - b.value, 4) AS spread, CASE WHEN a.value - b.value IS NULL THEN 'missing_data' END AS reason
FROM d LEFT JOIN l a ON a.series_id = long_id LEFT JOIN l b ON b.series_id = short_id""")
def mkt09_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = keys.latest_values(series(spark, sf_dir), ["series_id"], "observed_at", "value")
    return market.spreads(latest, SPREADS).withColumn("spread", F.round("spread", 4))


@query(f"""WITH {SERIES_SQL}, p AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY observed_at) AS d FROM series)
SELECT series_id, observed_at, CASE WHEN d IS NULL THEN 'unknown' WHEN d > 5000 THEN 'rising' WHEN d < -5000 THEN 'falling' ELSE 'stable' END AS state FROM p""")
def mkt10_state_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = market.Window.partitionBy("series_id").orderBy("observed_at")
    change = F.col("value") - F.lag("value").over(w)
    return series(spark, sf_dir).select("series_id", "observed_at", F.coalesce(sign_state(change, 5000.0), F.lit("unknown")).alias("state"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bucket_s)) AS x FROM bars)
SELECT symbol, CASE WHEN sqrt(sum(x * x)) >= 25 THEN 'volatility_high' ELSE 'volatility_normal' END AS level FROM r GROUP BY symbol""")
def mkt11_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = market.realized_volatility(bars(spark, sf_dir))
    return v.select("symbol", F.coalesce(band("volatility", (25.0, "volatility_high"), otherwise="volatility_normal"), F.lit("volatility_unknown")).alias("level"))


_B = {m: f"arg_max(close, ts) FILTER (ts <= TIMESTAMP '{AS_OF}' - INTERVAL {m} MINUTE)" for m in (1, 5, 30, 1440)}


FEATURES_SQL = f"""WITH {TICKS_SQL}, t AS (SELECT symbol, ts, close FROM ticks WHERE ts <= TIMESTAMP '{AS_OF}'),
g AS (SELECT symbol, arg_max(close, ts) AS last, arg_max(close, ts) FILTER (ts < DATE '2024-01-20') AS previous_close, arg_min(close, ts) FILTER (ts >= DATE '2024-01-20') AS session_open,
  max(close) FILTER (ts >= DATE '2024-01-20') AS session_high, min(close) FILTER (ts >= DATE '2024-01-20') AS session_low,
  max(close) FILTER (ts < DATE '2024-01-20') AS prior_high, min(close) FILTER (ts < DATE '2024-01-20') AS prior_low,
  {", ".join(f"{x} AS at_{m}m" for m, x in _B.items())} FROM t GROUP BY symbol),
s AS (SELECT symbol, regr_slope(close, -rn) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM t) WHERE rn <= 20 GROUP BY symbol)
SELECT symbol, last, previous_close, round(last - previous_close, 8) AS change, session_open, session_high, session_low,
  round((last - session_low) / nullif(session_high - session_low, 0), 8) AS position,
  {", ".join(f"round(last / nullif(at_{m}m, 0) - 1, 8) AS return_{m}m" for m in _B)},
  CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' WHEN slope = 0 THEN 'flat' END AS trend,
  CASE WHEN session_high IS NULL OR prior_high IS NULL THEN 'unknown' WHEN session_high > prior_high THEN 'breakout_up' WHEN session_low < prior_low THEN 'breakout_down' ELSE 'inside' END AS session_break
FROM g JOIN s USING (symbol)"""


@query(FEATURES_SQL)
def mkt12_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = market.features(ticks(spark, sf_dir), AS_OF)
    return f.withColumns({c: F.round(c, 8) for c in ("change", "position", "return_1m", "return_5m", "return_30m", "return_1440m")})


_MISSING_SQL = " || ".join(f"CASE WHEN {n} IS NULL THEN '{n}=' || " + ("CASE WHEN session_high = session_low THEN 'zero_denominator' ELSE 'missing_data' END" if n == "position" else "'missing_data'") + " || ';' ELSE '' END" for n in ("change", "position", "previous_close", "return_1440m", "return_1m", "return_30m", "return_5m", "session_high", "session_low", "session_open"))


@query(f"""WITH f AS ({FEATURES_SQL}), recent AS (SELECT event_type AS symbol, value AS close, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events WHERE ts <= TIMESTAMP '{AS_OF}'),
r AS (SELECT symbol, close, lead(close) OVER (PARTITION BY symbol ORDER BY rn) AS prev FROM recent WHERE rn <= 30), v AS (SELECT symbol, CASE WHEN count(*) >= 2 AND min(close) > 0 THEN sqrt(sum(pow(ln(close / prev), 2))) END AS volatility FROM r GROUP BY symbol)
SELECT symbol, TIMESTAMP '{AS_OF}' AS as_of, 'event-' || k AS source_event_id, last, trend, CASE WHEN volatility IS NULL THEN 'unavailable' WHEN volatility >= 4.0 THEN 'high' ELSE 'normal' END AS volatility_level, round(volatility, 6) AS volatility,
  {_MISSING_SQL} || CASE WHEN volatility IS NULL THEN 'realized_volatility=non_positive_or_missing_data;' ELSE '' END AS unavailable FROM f JOIN v USING (symbol), (SELECT unnest([1, 2]) AS k)""")
def mkt15_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of two events, saved, one of them twice, and read back."""
    kept = Buckets(spark, Scratch(spark, "mkt15").path("t"), ["symbol", "as_of", "source_event_id"], 4)
    for event, threshold in (("event-1", 1.0), ("event-2", 4.0), ("event-1", 4.0)):
        market.save_snapshots(market.snapshots(ticks(spark, sf_dir), AS_OF, event, threshold), kept)
    rows, figure = kept.read(), lambda n: F.col("features")[n]
    missing = F.array_join(F.transform(F.array_sort(F.map_entries("unavailable")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    late = F.concat(F.regexp_replace(missing, "realized_volatility=[a-z_]*;", ""), F.regexp_extract(missing, "realized_volatility=[a-z_]*;", 0))
    return rows.select("symbol", "as_of", "source_event_id", figure("last").alias("last"), F.col("labels")["trend"].alias("trend"), F.col("labels")["volatility_level"].alias("volatility_level"), F.round(figure("realized_volatility"), 6).alias("volatility"), late.alias("unavailable"))


@query(f"""WITH {DAYS_SQL}, p AS (SELECT symbol, day, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS prev, high - low AS span FROM days),
r AS (SELECT symbol, day, 'returns.daily' AS path, CASE WHEN prev IS NULL THEN 'missing_data' END AS reason FROM p
  UNION ALL SELECT symbol, day, 'position', CASE WHEN span = 0 THEN 'zero_denominator' END FROM p)
SELECT * FROM r WHERE reason IS NOT NULL""")
def mkt14_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir, DAY).withColumn("day", F.expr(f"bucket_s div {DAY}"))
    days = days.withColumn("prev", F.lag("close").over(market.Window.partitionBy("symbol").orderBy("day")))
    reasons = F.create_map(F.lit("returns.daily"), F.when(F.col("prev").isNull(), "missing_data"), F.lit("position"), F.when(F.col("high") == F.col("low"), "zero_denominator"))
    return days.select("symbol", "day", F.explode(reasons).alias("path", "reason")).filter("reason is not null")


@query(f"""WITH {BARS_SQL}, l AS (SELECT symbol, max(ts) AS last_ts FROM ticks GROUP BY symbol),
g AS (SELECT symbol, arg_max(close, ts) AS last, arg_max(close, ts) FILTER (ts <= last_ts - INTERVAL 5 MINUTE) AS ago_5m,
  arg_min(close, ts) FILTER (ts >= last_ts::DATE) AS day_open, count(*) FILTER (ts >= last_ts::DATE) AS samples FROM ticks JOIN l USING (symbol) GROUP BY symbol),
r AS (SELECT symbol, sum(high - low) FILTER (rn <= 12) / nullif(sum(high - low) FILTER (rn > 12), 0) AS share FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket_s DESC) AS rn FROM bars) WHERE rn <= 24 GROUP BY symbol)
SELECT symbol, last, ago_5m, day_open, samples, CASE WHEN share IS NULL THEN 'unknown' WHEN share >= 1.5 THEN 'elevated' WHEN share <= 0.66 THEN 'quiet' ELSE 'normal' END AS vol_state
FROM g LEFT JOIN r USING (symbol)""")
def mkt16_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.grid(ticks(spark, sf_dir), bars(spark, sf_dir))


@query(f"""WITH {DAYS_SQL}, r AS (SELECT symbol, day * 86400 AS bucket_s, close, lag(close) OVER w AS previous, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM days
  WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, bucket_s, close, previous, round(100 * (close - previous) / nullif(abs(previous), 0), 6) AS change_percent,
  CASE WHEN 100 * (close - previous) / abs(previous) > 0.05 THEN 'up' WHEN 100 * (close - previous) / abs(previous) < -0.05 THEN 'down' ELSE 'flat' END AS direction FROM r WHERE rn = 1""")
def mkt17_two_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.last_two(bars(spark, sf_dir, DAY))
    way = sign_state("change_percent", 0.05, ("up", "down", "flat"))
    return out.withColumn("direction", way).withColumn("change_percent", F.round("change_percent", 6))


def _last_range_sql(name: str, seconds: int) -> str:
    return f"""SELECT '{name}' AS resolution, symbol, arg_max(100 * (high - low) / nullif(close, 0), b) AS x FROM (SELECT symbol, epoch_us(ts) // {seconds * 1_000_000} AS b,
  max(close) AS high, min(close) AS low, arg_max(close, ts) AS close FROM ticks GROUP BY ALL) GROUP BY symbol"""


@query(f"""WITH {TICKS_SQL}, u AS ({" UNION ALL ".join(_last_range_sql(n, s) for n, s in (("1h", HOUR), ("4h", 4 * HOUR), ("1d", DAY)))})
SELECT resolution, round(avg(x), 6) AS range_percent, count(x) AS symbols FROM u GROUP BY resolution""")
def mkt18_vol_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = bars(spark, sf_dir)
    out = market.term_structure({"1h": hours, "4h": market.coarser(hours, 4 * HOUR), "1d": market.coarser(hours, DAY)})
    return out.withColumn("range_percent", F.round("range_percent", 6))


@query(f"""WITH {DAYS_SQL}, v AS (SELECT * FROM (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM days) WHERE x IS NOT NULL),
r AS (SELECT a.x, b.x AS y, row_number() OVER (ORDER BY day DESC) AS rn FROM v a JOIN v b USING (day) WHERE a.symbol = 'click' AND b.symbol = 'view')
SELECT count(*) AS days, CASE WHEN count(*) FILTER (rn <= 10) >= 10 THEN round(corr(x, y) FILTER (rn <= 10), 6) END AS current,
  CASE WHEN count(*) FILTER (rn > 10) >= 10 THEN round(corr(x, y) FILTER (rn > 10), 6) END AS prior FROM r WHERE rn <= 20""")
def mkt19_rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.rolling_correlation(market.returns(bars(spark, sf_dir, DAY)), "click", "view", 10)
    return out.select("days", F.round("current", 6).alias("current"), F.round("prior", 6).alias("prior"))


@query(f"""WITH {SERIES_SQL}, l AS (SELECT series_id, arg_max(value, observed_at) AS value FROM series GROUP BY series_id)
SELECT count(*) AS tenors, round(max(value) - min(value), 4) AS curve_range, arg_max(series_id, value) AS highest FROM l""")
def mkt20_curve_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = keys.latest_values(series(spark, sf_dir), ["series_id"], "observed_at", "value")
    return latest.agg(F.count("*").alias("tenors"), F.round(F.max("value") - F.min("value"), 4).alias("curve_range"), F.max_by("series_id", "value").alias("highest"))


@query(f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observed_at DESC) AS rn FROM series),
g AS (SELECT series_id, max(observed_at) AS observed_at, max(value) FILTER (rn = 1) AS latest, max(value) FILTER (rn = 2) AS previous, max(value) FILTER (rn = 5) AS fifth FROM r WHERE rn <= 5 GROUP BY series_id)
SELECT series_id, observed_at, latest, previous, round(latest - previous, 4) AS change, round(100 * (latest - previous) / nullif(abs(previous), 0), 6) AS change_percent,
  sign(latest - fifth)::INT AS trend, observed_at < DATE '1998-08-01' AS stale FROM g""")
def mkt21_macro_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = keys.top_n(series(spark, sf_dir), ["series_id"], [F.desc("observed_at")], 5, rank="rn")
    at = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    g = five.groupBy("series_id").agg(at("observed_at", 1).alias("observed_at"), at("value", 1).alias("latest"), at("value", 2).alias("previous"), at("value", 5).alias("fifth"))
    return g.select(
        "series_id", "observed_at", "latest", "previous", F.round(F.col("latest") - F.col("previous"), 4).alias("change"), F.round(percent_change("latest", "previous"), 6).alias("change_percent"),
        F.signum(F.col("latest") - F.col("fifth")).cast("int").alias("trend"), (F.col("observed_at") < F.lit("1998-08-01").cast("date")).alias("stale"),
    )


@query(f"""WITH {DAYS_SQL}, r AS (SELECT symbol, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS step, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM days)
SELECT symbol, count(*) AS bars, round(max(close) FILTER (rn = 1) / max(close) FILTER (rn = 6) - 1, 8) AS return_5, round(max(close) FILTER (rn = 1) / max(close) FILTER (rn = 21) - 1, 8) AS return_20,
  CASE WHEN count(step) FILTER (rn <= 20) >= 2 THEN round(stddev_samp(step) FILTER (rn <= 20), 8) END AS volatility FROM r WHERE rn <= 63 GROUP BY symbol""")
def mkt22_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.session_returns(bars(spark, sf_dir, DAY), (5, 20))
    return out.select("symbol", "bars", *[F.round(c, 8).alias(c) for c in ("return_5", "return_20", "volatility")])


@query(f"""WITH {DAYS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM days)
SELECT symbol, round(median(close * n * 100000), 4) AS turnover, round(least(1, greatest(0, (log10(median(close * n * 100000)) - 6) / 3)), 8) AS score FROM r WHERE rn <= 20 GROUP BY symbol""")
def mkt23_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.liquidity(bars(spark, sf_dir, DAY).withColumn("n", F.col("n") * 100_000))
    return out.select("symbol", F.round("turnover", 4).alias("turnover"), F.round("score", 8).alias("score"))
