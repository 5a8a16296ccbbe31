"""Streams over the driver's tables; each query runs over all that is there and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions import text
from quaylight.operators import stories
from quaylight.plans.base import TICKS_SQL, query, table, ticks
from quaylight.sources import quotes
from quaylight.sources.buckets import Buckets
from quaylight.sources.scratch import Scratch
from quaylight.streaming import streams, windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream(spark, f"{sf_dir}/events.parquet", "ts")


@query(f"""WITH {TICKS_SQL}, b AS (SELECT symbol, (epoch_us(ts) // 3600000000) * 3600 AS bucket_s, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low, arg_max(close, ts) AS close, count(*) AS n FROM ticks GROUP BY ALL)
SELECT b.* FROM b WHERE bucket_s + 3600 <= (SELECT epoch_ms(max(ts)) / 1000 FROM ticks) - 3600""")
def stm01_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"))
    return streams.run_into(streams.rollup(ticks, 3600), Scratch(spark, "stm01"), "bars")


@query("""SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL""")
def stm05_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("user_id", "event_type", "ts")
    kept = streams.run_into(streams.once(events, ["user_id", "event_type"], within="60 days"), Scratch(spark, "stm05"), "kept")
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT job, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, 'score' AS job FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'alert' FROM events WHERE value >= 90
UNION ALL SELECT event_id, 'review' FROM events WHERE event_type IN ('error', 'signup')) GROUP BY job""")
def stm07_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = streams.run_into(streams.routed(_events(spark, sf_dir)), Scratch(spark, "stm07"), "jobs")
    return jobs.groupBy("job").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id""")
def stm09_last_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stm09")
    latest = Buckets(spark, scratch.path("quotes"), ["user_id"], 16)
    streams.keep_last(_events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), latest, [F.desc("ts")], scratch.path("state"))
    return latest.read().select("user_id", "event_id", "value")


@query("""SELECT 'fx:' || event_type AS symbol, max(ts) AS at, arg_max(value, ts) AS price FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_type <> 'error' GROUP BY event_type""")
def src06_latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of price messages, read as a stream; heartbeats, unknown instruments and prices of one side don't count."""
    scratch, k = Scratch(spark, "src06"), F.col("event_id")
    side = F.array(F.struct(F.col("value").cast("string").alias("price"), F.lit(1).alias("liquidity")))
    message = F.to_json(F.struct(F.when(k % 7 == 0, "HEARTBEAT").otherwise("PRICE").alias("type"), F.upper("event_type").alias("instrument"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'").alias("time"), side.alias("bids"), F.when(k % 11 != 0, side).alias("asks")))
    table(spark, sf_dir, "events").select(F.when(k % 13 == 0, F.concat(message, F.lit("\n{not json"))).otherwise(message).alias("value")).write.text(scratch.path("log"))
    latest = Buckets(spark, scratch.path("quotes"), ["symbol"], 8)
    symbols = {name: f"fx:{name.lower()}" for name in ("VIEW", "SIGNUP", "PURCHASE", "CLICK")}
    streams.keep_last(quotes.quotes(spark, scratch.path("log"), symbols), latest, [F.desc("at"), F.desc("log"), F.desc("line")], scratch.path("state"))
    return latest.read().select("symbol", F.col("at").cast("timestamp_ntz").alias("at"), "price")


@query(f"""WITH {TICKS_SQL}, w AS (SELECT event_id AS window_id, symbol, ts + INTERVAL 1 HOUR AS target_at FROM ticks WHERE event_id % 20 = 0),
f AS (SELECT window_id, max(t.ts) AS tick_at, arg_max(close, (t.ts, close)) AS price FROM w JOIN ticks t ON t.symbol = w.symbol AND t.ts <= target_at AND t.ts >= target_at - INTERVAL 30 MINUTE GROUP BY window_id)
SELECT window_id, symbol, target_at, tick_at, price, CASE WHEN target_at >= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR THEN 'pending' WHEN price IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM w LEFT JOIN f USING (window_id)""")
def stm04_window_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as a stream of ticks and windows in four batches; state holds the open ones and ends with them."""
    scratch, t = Scratch(spark, "stm04"), ticks(spark, sf_dir)
    tick = t.select(F.lit("tick").alias("kind"), F.lit(None).cast("long").alias("window_id"), "symbol", "ts", "close", F.col("ts").alias("at"))
    asked = t.filter("event_id % 20 = 0").select(F.lit("window").alias("kind"), F.col("event_id").alias("window_id"), "symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(None).cast("double").alias("close"), F.col("ts").alias("at"))
    rows, days = tick.unionByName(asked), ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2030-01-01")
    state = windows.PendingWindows(spark, scratch.path("state"), 1800, 3600, 8)
    for a, b in zip(days, days[1:], strict=False):
        # all files that have come since the last run are one batch
        rows.filter(f"at >= TIMESTAMP_NTZ '{a}' AND at < TIMESTAMP_NTZ '{b}'").drop("at").write.mode("append").parquet(scratch.path("rows"))
        windows.run_windows(streams.stream(spark, scratch.path("rows")), state, scratch.path("checkpoint"))
    return state.result()


@query()
def stm10_cluster_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories in keyed state: order decides, so there is no SQL form; a test holds it to the batch operator."""
    docs = streams.stream(spark, f"{sf_dir}/documents.parquet").filter("text is not null")
    title = F.substring_index("text", "\n", 1)
    items = docs.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") * 3600.0).alias("at"), text.title_tokens(title).alias("tokens"), "source", stories.is_denial(title).alias("denial"),
        F.array("source").alias("entities"), F.array_compact(F.array("lang")).alias("markets"), F.coalesce("lang", F.lit("")).alias("block"),
    )
    return streams.run_into(streams.cluster_stories(items, ["block"], 259200.0, 0.55), Scratch(spark, "stm10"), "clusters")
