"""Reactions to events: windows, moves, directions, paths, matched volatility, sessions, confirmation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions.times import business_days, micros, week_window
from quaylight.operators import asof, reaction
from quaylight.plans.base import CALENDAR_SQL, TICKS_SQL, query, table, ticks

INSTRUMENTS = ("click", "view")
HORIZONS_SQL = "(VALUES " + ", ".join(f"('{n}', {m})" for n, m in reaction.HORIZONS) + ") h(horizon, minutes)"
ASKS_SQL = TICKS_SQL + """,
asks AS (SELECT event_id, ts, i.symbol FROM (SELECT event_id, ts FROM ticks WHERE symbol = 'signup'), (VALUES ('click'), ('view')) i(symbol))"""
#: Baseline and target of each event, instrument and horizon; one million and one makes the newest tick of a key win.
MOVES_SQL = ASKS_SQL + f""",
b AS (SELECT a.event_id, a.ts, a.symbol, t.ts AS baseline_at, t.close AS baseline FROM asks a LEFT JOIN LATERAL
  (SELECT ts, close FROM ticks t WHERE t.symbol = a.symbol AND t.ts < a.ts AND t.ts >= a.ts - INTERVAL 2 HOUR ORDER BY t.ts DESC LIMIT 1) t ON true),
m AS (SELECT b.*, h.horizon, h.minutes, t.ts AS target_at, t.close AS target FROM b CROSS JOIN {HORIZONS_SQL} LEFT JOIN LATERAL
  (SELECT ts, close FROM ticks t WHERE t.symbol = b.symbol AND t.ts >= b.ts + to_minutes(h.minutes) AND t.ts <= b.ts + to_minutes(h.minutes + 5) ORDER BY t.ts LIMIT 1) t ON true),
moves AS (SELECT event_id, ts, symbol, horizon, minutes, baseline_at, baseline, target_at, target, CASE WHEN baseline IS NULL THEN 'missing_baseline' WHEN target IS NULL THEN 'missing_target'
  WHEN baseline = 0 THEN 'zero_baseline' WHEN target = 0 THEN 'zero_target' END AS missing_reason FROM m)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).filter("symbol = 'signup'").select("event_id", "ts")


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in INSTRUMENTS], "symbol string")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.reactions(events(spark, sf_dir), instruments(spark), ticks(spark, sf_dir).select("symbol", "ts", "close"))


@query(f"""WITH {ASKS_SQL} SELECT event_id, symbol, horizon, ts + to_minutes(minutes) AS target_at FROM asks CROSS JOIN {HORIZONS_SQL}""")
def rxn01_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reaction.windows(events(spark, sf_dir), instruments(spark))
    return out.select("event_id", "symbol", "horizon", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes"))).alias("target_at"))


@query(f"""WITH {MOVES_SQL} SELECT symbol, horizon, count(baseline_at) AS with_baseline, count(target_at) AS with_target,
  count(*) FILTER (target_at = ts + to_minutes(minutes)) AS exact, min(target_at) AS first_target FROM moves GROUP BY ALL""")
def rxn03_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir).join(F.broadcast(spark.createDataFrame(list(reaction.HORIZONS), "horizon string, minutes int")), "horizon")
    on_time = F.col("target_at") == F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes"))
    return m.groupBy("symbol", "horizon").agg(F.count("baseline_at").alias("with_baseline"), F.count("target_at").alias("with_target"), F.count_if(on_time).alias("exact"), F.min("target_at").alias("first_target"))


@query(f"""WITH {MOVES_SQL} SELECT event_id, symbol, horizon, CASE WHEN us < 0 THEN floor(us / 1e6) ELSE round_even(us / 1e6, 0) END::BIGINT AS offset_s
FROM (SELECT *, epoch_us(baseline_at) - epoch_us(ts) AS us FROM moves) WHERE us IS NOT NULL""")
def rxn05_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir).filter("baseline_at is not null")
    return m.select("event_id", "symbol", "horizon", reaction.offset_seconds(micros("baseline_at") - micros("ts")).alias("offset_s"))


@query(f"""WITH {MOVES_SQL} SELECT event_id, symbol, horizon, baseline, target, missing_reason, CASE WHEN missing_reason IS NULL THEN round(target - baseline, 8) END AS move,
  CASE WHEN missing_reason IS NULL THEN round(100 * (target - baseline) / abs(baseline), 6) END AS move_percent FROM moves""")
def rxn06_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir)
    return m.select("event_id", "symbol", "horizon", "baseline", "target", "missing_reason", F.round("move", 8).alias("move"), F.round("move_percent", 6).alias("move_percent"))


@query(f"""WITH {MOVES_SQL}, d AS (SELECT *, CASE WHEN missing_reason IS NULL THEN target - baseline END AS move, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS expected FROM moves)
SELECT symbol, horizon, CASE WHEN move IS NULL OR expected IS NULL THEN 'unknown' WHEN abs(move) <= 1 THEN 'neutral' WHEN sign(move) = expected THEN 'aligned' ELSE 'opposed' END AS direction, count(*) AS n
FROM d GROUP BY ALL""")
def rxn07_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, -1)
    out = moves(spark, sf_dir).withColumn("direction", reaction.direction(F.col("move"), expected, 1.0))
    return out.groupBy("symbol", "horizon", "direction").agg(F.count("*").alias("n"))


@query(f"""WITH {MOVES_SQL}, s AS (SELECT event_id, symbol, minutes, sign(target - baseline)::INT AS s FROM moves WHERE missing_reason IS NULL),
g AS (SELECT a.event_id, a.symbol, arg_min(s, minutes) FILTER (s <> 0) AS f, arg_max(s, minutes) FILTER (s <> 0) AS l, count(*) FILTER (s > 0) AS up, count(*) FILTER (s < 0) AS down
  FROM asks a LEFT JOIN s USING (event_id, symbol) GROUP BY ALL)
SELECT event_id, symbol, CASE WHEN f IS NULL THEN 'pending' WHEN f <> l THEN 'reversal' WHEN up > 0 AND down > 0 THEN 'mixed' ELSE 'persistence' END AS path_state, up, down FROM g""")
def rxn08_path_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir).join(F.broadcast(spark.createDataFrame(list(reaction.HORIZONS), "horizon string, minutes int")), "horizon")
    return reaction.path_states(m, ["event_id", "symbol"], "minutes")


@query(f"""WITH {ASKS_SQL}, s AS (SELECT a.event_id, a.symbol, epoch_us(t.ts) // 900000000 AS slot, t.ts, t.close FROM asks a JOIN ticks t ON t.symbol = a.symbol AND t.ts < a.ts AND t.ts >= a.ts - INTERVAL 3 HOUR)
SELECT event_id, symbol, slot * 900 AS slot_s, arg_max(close, ts) AS close FROM s GROUP BY ALL""")
def rxn09_bucket_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = events(spark, sf_dir).crossJoin(F.broadcast(instruments(spark)))
    s = asof.slot_lasts(asks, ticks(spark, sf_dir).select("symbol", "ts", "close"), ["symbol"], ["event_id", "symbol"], "ts", "close", 3 * 3600, 900)
    return s.select("event_id", "symbol", (F.col("slot") * 900).alias("slot_s"), "close")


@query()
def rxn10_matched_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of non-overlapping hourly moves before each event: greedy pairing has no SQL form; tests hold it to a loop."""
    asks = events(spark, sf_dir).crossJoin(F.broadcast(instruments(spark)))
    found = reaction.matched_volatility_before(asks, ticks(spark, sf_dir).select("symbol", "ts", "close"), ["symbol"], "ts", 24 * 3600, 3600)
    return found.select("event_id", "symbol", "pairs", "volatility")


@query(f"""WITH {MOVES_SQL} SELECT missing_reason, horizon, count(*) AS n FROM moves GROUP BY ALL""")
def rxn11_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).groupBy("missing_reason", "horizon").agg(F.count("*").alias("n"))


@query(f"""WITH {MOVES_SQL} SELECT event_id, symbol, horizon FROM moves WHERE target_at IS NULL AND ts + to_minutes(minutes) <= TIMESTAMP '2024-01-20'""")
def rxn12_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir).join(F.broadcast(spark.createDataFrame(list(reaction.HORIZONS), "horizon string, minutes int")), "horizon")
    due = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes")) <= F.lit("2024-01-20").cast("timestamp_ntz")
    return m.filter(F.col("target_at").isNull() & due).select("event_id", "symbol", "horizon")


@query(f"""WITH {CALENDAR_SQL}, e AS (SELECT event_id, ts, ts::DATE AS day FROM events WHERE event_type = 'signup')
SELECT event_id, e.day, CASE WHEN open THEN greatest(0, 960 - greatest(hour(ts) * 60 + minute(ts), 570)) ELSE 0 END AS minutes_left, coalesce(open, false) AS trading_day FROM e LEFT JOIN calendar c ON c.day = e.day""")
def rxn13_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading minutes from each event to its session's close."""
    calendar = reaction.sessions(spark, dt.date(2023, 12, 1), dt.date(2024, 3, 1))
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts")).join(F.broadcast(calendar), "day", "left")
    minute = F.hour("ts") * 60 + F.minute("ts")
    left = F.greatest(F.lit(0), F.col("close_minute") - F.greatest(minute, F.col("open_minute")))
    return e.select("event_id", "day", F.coalesce(left, F.lit(0)).alias("minutes_left"), F.col("venue").isNotNull().alias("trading_day"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate + to_days((o_orderkey % 40)::INT))::DATE AS b FROM orders)
SELECT o_orderkey, (SELECT count(*) FROM range(0, (b - a) + 1) r(i) WHERE isodow(a + i::INT) < 6) AS days FROM d""")
def fn09_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", business_days(a, F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))).alias("days"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), f AS (SELECT day, CASE WHEN isodow(day) < 6 THEN day ELSE day + (8 - isodow(day))::INT END AS first FROM d)
SELECT day, first, first + (5 - isodow(first))::INT AS last FROM f""")
def fn08_week_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.withColumn("w", week_window(F.col("day"))).select("day", "w.first", "w.last")


NEAR_SQL = """LEFT JOIN LATERAL (SELECT close, ts FROM ticks t WHERE t.symbol = a.symbol AND abs(epoch_us(t.ts) - epoch_us(a.ts + INTERVAL ({m}) MINUTE)) <= 900000000
  ORDER BY abs(epoch_us(t.ts) - epoch_us(a.ts + INTERVAL ({m}) MINUTE)), t.ts LIMIT 1) p{k} ON true"""


@query(f"""WITH {ASKS_SQL}, p AS (SELECT a.event_id, a.symbol, p0.close AS base, p1.close AS before, p2.close AS m5, p3.close AS m30 FROM asks a {NEAR_SQL.format(m=0, k=0)}
  {NEAR_SQL.format(m=-30, k=1)} {NEAR_SQL.format(m=5, k=2)} {NEAR_SQL.format(m=30, k=3)}),
m AS (SELECT event_id, symbol, (base / nullif(before, 0) - 1) * 100 AS pre, (m5 / nullif(base, 0) - 1) * 100 AS move_5m, (m30 / nullif(base, 0) - 1) * 100 AS move_30m FROM p),
f AS (SELECT event_id, count(move_5m) + count(move_30m) AS n, bool_or(coalesce(abs(move_5m) >= 20 OR abs(move_30m) >= 20, false)) AS hit, bool_or(coalesce(abs(pre) >= 20, false)) AS moved,
  bool_or(coalesce(move_5m >= 20, false)) AND bool_or(coalesce(move_5m <= -20, false)) OR bool_or(coalesce(move_30m >= 20, false)) AND bool_or(coalesce(move_30m <= -20, false)) AS apart,
  bool_or(coalesce(abs(move_5m) >= 20 AND abs(move_30m) >= 20 AND move_5m * move_30m < 0, false)) AS turned, bool_or(pre IS NULL OR move_5m IS NULL OR move_30m IS NULL) AS lacks FROM m GROUP BY event_id)
SELECT event_id, concat_ws(',', CASE WHEN hit THEN 'confirmed_by_market' END, CASE WHEN n > 0 AND NOT hit THEN 'no_material_reaction' END, CASE WHEN moved THEN 'market_moved_before_headline' END,
  CASE WHEN apart THEN 'cross_asset_divergence' END, CASE WHEN turned THEN 'initial_move_reversed' END, CASE WHEN n = 0 OR lacks THEN 'insufficient_market_data' END) AS flags FROM f""")
def sty06_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.confirmation(events(spark, sf_dir), instruments(spark), ticks(spark, sf_dir).select("symbol", "ts", "close"), threshold_percent=20.0)


@query("""SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 21 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 21 HOUR ELSE date_trunc('day', ts) + INTERVAL 45 HOUR END AS target FROM events""")
def sty08_session_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", reaction.session_target(F.col("ts")).alias("target"))
