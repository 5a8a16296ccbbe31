"""Market state: bars, returns, volatility, correlation, breadth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.numeric import clamp, finite, is_finite, pearson, ratio, simple_return
from quaylight.functions.times import bucket
from quaylight.sources.buckets import Buckets


def ohlc(ticks: DataFrame, seconds: int) -> DataFrame:
    """Bars of finite ticks: ``symbol, bucket_s, open, high, low, close, n``."""
    ticks = ticks.filter(is_finite("close")).withColumn("bucket_s", bucket("ts", seconds))
    return ticks.groupBy("symbol", "bucket_s").agg(
        F.min_by("close", "ts").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "ts").alias("close"), F.count("*").alias("n")
    )


def coarser(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars of a multiple of the given bars' width, without the ticks."""
    wide = bars.withColumn("wide_s", F.floor(F.col("bucket_s") / seconds) * seconds).groupBy("symbol", F.col("wide_s").alias("bucket_s"))
    return wide.agg(F.min_by("open", bars["bucket_s"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", bars["bucket_s"]).alias("close"), F.sum("n").alias("n"))


def realized_volatility(bars: DataFrame, by: str = "symbol", ts: str = "bucket_s", price: str = "close") -> DataFrame:
    """Root of the summed squared log returns; null for fewer than two prices or a price that isn't positive."""
    before = F.lag(price).over(Window.partitionBy(by).orderBy(ts))
    step = F.when((F.col(price) > 0) & (before > 0), F.log(F.col(price) / before))
    stepped = bars.filter(is_finite(price)).withColumn("__step", step)
    return stepped.groupBy(by).agg(F.when((F.count("*") >= 2) & (F.min(price) > 0), F.sqrt(F.sum(F.col("__step") * F.col("__step")))).alias("volatility"), F.count("*").alias("n"))


def zscore_of_last(ticks: DataFrame, by: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    """Distance of the last value from the mean in population standard deviations; null if these are 0."""
    some = ticks.filter(is_finite(price)).groupBy(by).agg(F.max_by(price, ts).alias("last"), F.avg(price).alias("mean"), F.stddev_pop(price).alias("sd"), F.count("*").alias("n"))
    return some.select(by, F.when((F.col("n") >= 2) & (F.col("sd") > 0), (F.col("last") - F.col("mean")) / F.col("sd")).alias("zscore"), "n")


def high_low_position(bars: DataFrame) -> DataFrame:
    """Where the last price of a span lies between its lowest (0) and highest (1)."""
    return bars.withColumn("position", ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")))


def returns(bars: DataFrame, by: str = "symbol", ts: str = "bucket_s", price: str = "close") -> DataFrame:
    """``by, ts, ret``: simple returns between neighbouring bars."""
    before = F.lag(price).over(Window.partitionBy(by).orderBy(ts))
    return bars.select(by, ts, simple_return(F.col(price), before).alias("ret")).filter("ret is not null")


def _block_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the shared times of each two symbols, one of each side: products of matrices of times by symbols."""
    first, second = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    times, at = np.unique(frame["t"].to_numpy(), return_inverse=True)

    def side(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = (frame["block"] == block).to_numpy()
        names, which = np.unique(frame["symbol"].to_numpy(dtype=object)[mine], return_inverse=True)
        there, values = (np.zeros((len(times), len(names))) for _ in range(2))
        there[at[mine], which], values[at[mine], which] = 1.0, frame["x"].to_numpy()[mine]
        return names, there, values

    names_a, has_a, x = side(first)
    names_b, has_b, y = (names_a, has_a, x) if first == second else side(second)
    sums = {"n": has_a.T @ has_b, "sx": x.T @ has_b, "sy": has_a.T @ y, "sxx": (x * x).T @ has_b, "syy": has_a.T @ (y * y), "sxy": x.T @ y}
    a, b = np.nonzero(sums["n"])
    if first == second:
        a, b = a[names_a[a] < names_a[b]], b[names_a[a] < names_a[b]]
    else:
        swap = names_a[a] > names_b[b]
        sums = {k: v[a, b] for k, v in sums.items()}
        for p, q in (("sx", "sy"), ("sxx", "syy")):
            sums[p], sums[q] = np.where(swap, sums[q], sums[p]), np.where(swap, sums[p], sums[q])
        return pd.DataFrame({"a": np.where(swap, names_b[b], names_a[a]), "b": np.where(swap, names_a[a], names_b[b]), **sums})
    return pd.DataFrame({"a": names_a[a], "b": names_a[b], **{k: v[a, b] for k, v in sums.items()}})


def pair_correlations(values: DataFrame, by: str = "symbol", ts: str = "bucket_s", value: str = "ret", least: int = 5, symbols: int = 256, times: int = 8192) -> DataFrame:
    """Correlation of each two symbols on shared times, with the reason where there is none.

    By blocks: symbols and times are dealt into blocks by their hashes, of about ``symbols`` and ``times``; a task has the
    values of two blocks of symbols in one of times and gives the sums of each two of them, which add up over times.  A value
    goes to as many tasks as there are blocks of symbols.  Values are taken from their symbol's mean, as sums of squares
    of large prices would lose digits.  Values that aren't finite don't count; of several at one time the largest does.
    """
    good = values.filter(is_finite(value)).groupBy(F.col(by).alias("symbol"), F.col(ts).alias("t")).agg(F.max(value).alias("x"))
    sizes = good.agg(F.approx_count_distinct("symbol").alias("symbols"), F.approx_count_distinct("t").alias("times")).first()
    blocks, spans = -(-sizes["symbols"] // symbols) or 1, -(-sizes["times"] // times) or 1
    means = good.groupBy("symbol").agg(F.avg("x").alias("mean"))
    dealt = good.join(means, "symbol").select("symbol", F.xxhash64("t").alias("t"), (F.col("x") - F.col("mean")).alias("x"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = dealt.withColumn("other", other).select("symbol", "t", "x", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.pmod(F.col("t"), F.lit(spans)).alias("span"))
    parts = dealt.groupBy("i", "j", "span").applyInPandas(_block_sums, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    both = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (F.col("sxx") - sx * sx / n) * (F.col("syy") - sy * sy / n)
    correlation = F.when((n >= least) & (spread > 1e-24), F.try_divide(F.col("sxy") - sx * sy / n, F.sqrt(F.greatest(spread, F.lit(0.0)))))
    reason = F.when(F.col("n") < least, "insufficient_paired_samples").when(F.col("correlation").isNull(), "constant_returns")
    return both.select("a", "b", n.cast("long").alias("n"), correlation.alias("correlation")).withColumn("reason", reason)


def breadth(changes: DataFrame, by: str, change: str = "change") -> DataFrame:
    """Members of each basket that advance, decline and stay, and the part that advances."""
    c = finite(change)
    out = changes.groupBy(by).agg(F.count_if(c > 0).alias("advancing"), F.count_if(c < 0).alias("declining"), F.count_if(c == 0).alias("unchanged"), F.count(c).alias("total"))
    return out.withColumn("breadth", ratio("advancing", "total"))


def slope(values: Column, index: Column) -> Column:
    """Least-squares slope of values over an index, as an aggregate; null for fewer than two values."""
    n = F.count(values)
    x, y = F.when(values.isNotNull(), index.cast("double")), values
    return F.when(n >= 2, F.try_divide(F.sum(x * y) - F.sum(x) * F.sum(y) / n, F.sum(x * x) - F.sum(x) * F.sum(x) / n))


def liquidity(bars: DataFrame, last: int = 20) -> DataFrame:
    """Median turnover of the last bars of each symbol, on a scale from 0 (a million) to 1 (a thousand million)."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bucket_s")))
    recent = bars.withColumn("__rank", rank).filter(F.col("__rank") <= last)
    out = recent.groupBy("symbol").agg(F.median(F.col("close") * F.col("n")).alias("turnover"))
    return out.withColumn("score", F.when(F.col("turnover") > 0, clamp((F.log10("turnover") - 6) / 3)))


def features(ticks: DataFrame, as_of: str, trend_ticks: int = 20) -> DataFrame:
    """One row of features for each symbol from ticks up to ``as_of`` (a timestamp literal, without time zone).

    One aggregate reads the ticks once: last price, the close before the day, the session's open, high and low, as-of
    prices before 1, 5 and 30 minutes and a day, and the earlier high and low.  The trend's ticks are trimmed to
    ``trend_ticks`` for each symbol before they are shuffled.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    ticks = ticks.filter(is_finite("close") & (F.col("ts") <= now)).select("symbol", "ts", "close")
    on = lambda f, c: f(F.when(c, F.col("close")), F.when(c, F.col("ts")))
    today, past = F.col("ts") >= day, F.col("ts") < day
    before = lambda minutes: F.col("ts") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    out = ticks.groupBy("symbol").agg(
        F.max_by("close", "ts").alias("last"), on(F.max_by, past).alias("previous_close"), on(F.min_by, today).alias("session_open"),
        F.max(F.when(today, F.col("close"))).alias("session_high"), F.min(F.when(today, F.col("close"))).alias("session_low"),
        F.max(F.when(past, F.col("close"))).alias("prior_high"), F.min(F.when(past, F.col("close"))).alias("prior_low"),
        *[on(F.max_by, before(m)).alias(f"at_{m}m") for m in (1, 5, 30, 1440)],
    )
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    recent = ticks.withColumn("__rank", rank).filter(F.col("__rank") <= trend_ticks)
    out = out.join(recent.groupBy("symbol").agg(slope(F.col("close"), -F.col("__rank")).alias("slope")), "symbol")
    unknown = F.col("session_high").isNull() | F.col("prior_high").isNull()
    broke = F.when(unknown, "unknown").when(F.col("session_high") > F.col("prior_high"), "breakout_up").when(F.col("session_low") < F.col("prior_low"), "breakout_down").otherwise("inside")
    trend = F.when(F.col("slope").isNull(), None).when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat")
    return out.select(
        "symbol", "last", "previous_close", (F.col("last") - F.col("previous_close")).alias("change"), "session_open", "session_high", "session_low",
        ratio(F.col("last") - F.col("session_low"), F.col("session_high") - F.col("session_low")).alias("position"),
        *[simple_return("last", f"at_{m}m").alias(f"return_{m}m") for m in (1, 5, 30, 1440)], trend.alias("trend"), broke.alias("session_break"),
    )


#: Figures of a snapshot, by the reason that explains a missing one: no price to take it from, or a range of zero.
_FIGURES = ("last", "previous_close", "change", "session_open", "session_high", "session_low", "position", "return_1m", "return_5m", "return_30m", "return_1440m", "realized_volatility")


def snapshots(ticks: DataFrame, as_of: str, source_event_id: str, high_volatility: float, trend_ticks: int = 20, volatility_ticks: int = 30) -> DataFrame:
    """``symbol, as_of, source_event_id, features, labels, unavailable, provenance`` of each symbol at a moment.

    ``features`` maps figures to values, ``unavailable`` those that are missing to why, ``labels`` names trend, break and the
    level of volatility, which is that of the last ``volatility_ticks`` prices.  ``provenance`` is what the snapshot was made
    with.  A symbol without a finite price by then has no snapshot.
    """
    out = features(ticks, as_of, trend_ticks)
    known = ticks.filter(is_finite("close") & (F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))).select("symbol", "ts", "close")
    last = known.withColumn("__rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter(F.col("__rank") <= volatility_ticks)
    out = out.join(realized_volatility(last, ts="ts").select("symbol", F.col("volatility").alias("realized_volatility")), "symbol", "left")
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in _FIGURES])
    flat = F.col("session_high") == F.col("session_low")
    reason = lambda n: F.when(flat, "zero_denominator").otherwise("missing_data") if n == "position" else F.lit("non_positive_or_missing_data" if n == "realized_volatility" else "missing_data")
    missing = F.array(*[F.when(F.col(n).isNull(), F.struct(F.lit(n).alias("key"), reason(n).alias("value"))) for n in _FIGURES])
    level = F.when(F.col("realized_volatility").isNull(), "unavailable").when(F.col("realized_volatility") >= high_volatility, "high").otherwise("normal")
    there = lambda c: F.filter(c, lambda x: x["value"].isNotNull())
    return out.select(
        "symbol", F.lit(as_of).cast("timestamp_ntz").alias("as_of"), F.lit(source_event_id).alias("source_event_id"), F.map_from_entries(there(pairs)).alias("features"),
        F.create_map(F.lit("trend"), "trend", F.lit("session_break"), "session_break", F.lit("volatility_level"), level).alias("labels"), F.map_from_entries(F.filter(missing, lambda x: x.isNotNull())).alias("unavailable"),
        F.create_map(F.lit("trend_ticks"), F.lit(str(trend_ticks)), F.lit("volatility_ticks"), F.lit(str(volatility_ticks)), F.lit("high_volatility"), F.lit(str(high_volatility))).alias("provenance"),
    )


def save_snapshots(made: DataFrame, table: Buckets, writer: str | None = None, batch: int | None = None) -> None:
    """Writes snapshots; one of the same symbol, moment and event is replaced.  ``table`` is by those three columns."""
    if list(table.by) != ["symbol", "as_of", "source_event_id"]:
        raise ValueError("snapshots are kept by symbol, as_of and source_event_id")
    table.upsert(made.filter("symbol is not null and source_event_id <> ''"), writer=writer, batch=batch)


def grid(ticks: DataFrame, bars: DataFrame, recent: int = 12) -> DataFrame:
    """``symbol, last, ago_5m, day_open, samples, vol_state``: a watch list's row for each symbol.

    ``vol_state`` compares the summed ranges of the last ``recent`` bars with those of as many before: elevated from 1.5
    on, quiet up to 0.66, unknown without both.
    """
    ticks = ticks.filter(is_finite("close"))
    last = ticks.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    near = ticks.join(last, "symbol")
    ago = F.when(F.col("ts") <= F.col("last_ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5)), F.col("ts"))
    day = F.when(F.col("ts") >= F.date_trunc("day", "last_ts").cast("timestamp_ntz"), F.col("ts"))
    out = near.groupBy("symbol").agg(F.max_by("close", "ts").alias("last"), F.max_by("close", ago).alias("ago_5m"), F.min_by("close", day).alias("day_open"), F.count(day).alias("samples"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bucket_s")))
    ranked = bars.withColumn("__rank", rank).filter(F.col("__rank") <= 2 * recent).withColumn("__range", F.col("high") - F.col("low"))
    part = lambda c: F.sum(F.when(c, F.col("__range")))
    ranges = ranked.groupBy("symbol").agg(part(F.col("__rank") <= recent).alias("new"), part(F.col("__rank") > recent).alias("old"))
    share = ratio("new", "old")
    state = F.when(share.isNull(), "unknown").when(share >= 1.5, "elevated").when(share <= 0.66, "quiet").otherwise("normal")
    return out.join(ranges, "symbol", "left").select("symbol", "last", "ago_5m", "day_open", "samples", state.alias("vol_state"))


def last_two(bars: DataFrame) -> DataFrame:
    """``symbol, bucket_s, close, previous, change_percent`` of each symbol's last bar."""
    w = Window.partitionBy("symbol").orderBy(F.desc("bucket_s"))
    two = bars.select("symbol", "bucket_s", "close").withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= 2)
    at = lambda c, k: F.max(F.when(F.col("__rank") == k, F.col(c)))
    out = two.groupBy("symbol").agg(at("bucket_s", 1).alias("bucket_s"), at("close", 1).alias("close"), at("close", 2).alias("previous"))
    return out.withColumn("change_percent", 100 * ratio(F.col("close") - F.col("previous"), F.abs("previous")))


def term_structure(bars_by_name: dict[str, DataFrame]) -> DataFrame:
    """``resolution, range_percent, symbols``: mean range of the symbols' last bars at each resolution."""
    out = None
    for name, bars in bars_by_name.items():
        last = bars.groupBy("symbol").agg(F.max_by(F.struct("high", "low", "close"), "bucket_s").alias("b"))
        part = last.select(F.lit(name).alias("resolution"), (100 * ratio(F.col("b.high") - F.col("b.low"), F.col("b.close"))).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("resolution").agg(F.avg("x").alias("range_percent"), F.count("x").alias("symbols"))


def rolling_correlation(values: DataFrame, a: str, b: str, window: int = 20, by: str = "symbol", ts: str = "bucket_s", value: str = "ret") -> DataFrame:
    """``days, current, prior``: correlation over the last ``window`` aligned times and over as many before.

    Null without enough times: ``window`` for the current one, twice as many for the prior one.
    """
    side = lambda name, to: values.filter(F.col(by) == name).select(ts, F.col(value).alias(to))
    both = side(a, "x").join(side(b, "y"), ts).orderBy(F.desc(ts)).limit(2 * window)
    rank = both.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc(ts))))
    now, then = F.col("__rank") <= window, F.col("__rank") > window
    part = lambda c: pearson(F.when(c, F.col("x")), F.when(c, F.col("y")), window)
    return rank.agg(F.count("*").alias("days"), part(now).alias("current"), part(then).alias("prior"))


def session_returns(bars: DataFrame, sessions: tuple[int, ...] = (5, 20, 60), volatility: int = 20, keep: int = 63) -> DataFrame:
    """Returns over numbers of sessions and the spread of the last log returns, from each symbol's ``keep`` last bars."""
    w = Window.partitionBy("symbol").orderBy(F.desc("bucket_s"))
    ranked = bars.filter(F.col("close") > 0).select("symbol", "bucket_s", "close").withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= keep)
    step = F.log(F.col("close") / F.lead("close").over(w))
    at = lambda k: F.max(F.when(F.col("__rank") == k, F.col("close")))
    g = ranked.withColumn("__step", step).groupBy("symbol")
    steps = F.when(F.col("__rank") <= volatility, F.col("__step"))
    return g.agg(F.count("*").alias("bars"), *[simple_return(at(1), at(n + 1)).alias(f"return_{n}") for n in sessions], F.when(F.count(steps) >= 2, F.stddev_samp(steps)).alias("volatility"))


def spreads(latest: DataFrame, definitions: dict[str, tuple[str, str]], key: str = "series_id", value: str = "value") -> DataFrame:
    """``label, spread, reason``: long less short value of each definition, a short list; ``missing_data`` without both."""
    spark = latest.sparkSession
    wanted = spark.createDataFrame([(k, a, b) for k, (a, b) in definitions.items()], "label string, long_id string, short_id string")
    one = latest.select(F.col(key).alias("long_id"), finite(value).alias("a"))
    two = latest.select(F.col(key).alias("short_id"), finite(value).alias("b"))
    both = wanted.join(one, "long_id", "left").join(two, "short_id", "left")
    spread = F.col("a") - F.col("b")
    return both.select("label", spread.alias("spread"), F.when(spread.isNull(), "missing_data").alias("reason"))
