"""Reaction of instruments to events: windows, moves, directions, paths, matched volatility, sessions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions.numeric import percent_change
from quaylight.functions.times import micros
from quaylight.operators import asof

#: Minutes after an event at which its reaction is read.
HORIZONS = (("1m", 1), ("5m", 5), ("15m", 15), ("30m", 30), ("60m", 60))


def windows(events: DataFrame, instruments: DataFrame, horizons: Sequence[tuple[str, int]] = HORIZONS) -> DataFrame:
    """Each event with each instrument and horizon; instruments and horizons are short lists, given by the caller."""
    spark = events.sparkSession
    times = spark.createDataFrame(list(horizons), "horizon string, minutes int")
    return events.crossJoin(F.broadcast(instruments)).crossJoin(F.broadcast(times))


def offset_seconds(micros: Column) -> Column:
    """Whole seconds: floor before the event, to the nearest (of two, the even one) after it."""
    seconds = micros / 1_000_000
    return F.when(micros < 0, F.floor(seconds)).otherwise(F.bround(seconds)).cast("long")


def reactions(events: DataFrame, instruments: DataFrame, ticks: DataFrame, horizons: Sequence[tuple[str, int]] = HORIZONS, tolerance_seconds: int = 300, baseline_seconds: int = 7200) -> DataFrame:
    """One row for each event, instrument and horizon: baseline, target, move and why one is missing.

    ``events``: ``event_id, ts``; ``instruments``: ``symbol``; ``ticks``: ``symbol, ts, close``.  The baseline is the last
    tick before the event, the target the first one from the horizon on within the tolerance.
    """
    asks = events.select("event_id", "ts").crossJoin(F.broadcast(instruments.select("symbol")))
    base = asof.asof_before(asks, ticks, ["symbol"], "ts", ["close"], seconds=baseline_seconds).withColumnsRenamed({"tick_ts": "baseline_at", "close": "baseline"})
    times = events.sparkSession.createDataFrame(list(horizons), "horizon string, minutes int")
    asked = base.crossJoin(F.broadcast(times))
    out = asof.asof_after(asked, ticks, ["symbol"], "ts", ["close"], tolerance_seconds, F.col("minutes").cast("long") * 60)
    out = out.withColumnsRenamed({"tick_ts": "target_at", "close": "target"}).drop("minutes")
    reason = (
        F.when(F.col("baseline").isNull(), "missing_baseline").when(F.col("target").isNull(), "missing_target")
        .when(F.col("baseline") == 0, "zero_baseline").when(F.col("target") == 0, "zero_target")
    )
    out = out.withColumn("missing_reason", reason)
    known = F.col("missing_reason").isNull()
    return out.withColumns({"move": F.when(known, F.col("target") - F.col("baseline")), "move_percent": F.when(known, percent_change("target", "baseline"))})


def direction(move: Column, expected: Column, tolerance: float = 0.0) -> Column:
    """aligned, opposed, neutral or unknown against an expected sign."""
    return F.when(move.isNull() | expected.isNull() | (expected == 0), "unknown").when(F.abs(move) <= tolerance, "neutral").when(F.signum(move) == F.signum(expected), "aligned").otherwise("opposed")


def path_states(moves: DataFrame, by: Sequence[str], order: str, move: str = "move") -> DataFrame:
    """pending, persistence, reversal or mixed: the first and last sign of a path that isn't zero, and those between."""
    sign = F.signum(move)
    moved = F.when(sign != 0, sign)
    g = moves.groupBy(*by).agg(F.min_by(moved, F.when(moved.isNotNull(), F.col(order))).alias("first"), F.max_by(moved, F.when(moved.isNotNull(), F.col(order))).alias("last"), F.count_if(sign > 0).alias("up"), F.count_if(sign < 0).alias("down"))
    state = F.when(F.col("first").isNull(), "pending").when(F.col("first") != F.col("last"), "reversal").when((F.col("up") > 0) & (F.col("down") > 0), "mixed").otherwise("persistence")
    return g.select(*by, state.alias("path_state"), "up", "down")


def session_target(ts: Column, close_hour: int = 21) -> Column:
    """The day's close if it lies after the moment, else the next day's."""
    close = F.date_trunc("day", ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(close_hour))
    return F.when(close > ts, close).otherwise(close + F.make_dt_interval(F.lit(1)))


#: Prices that confirm a headline: minutes from it on.
CONFIRMATION = {"before": -30, "base": 0, "m5": 5, "m30": 30}


def confirmation(events: DataFrame, instruments: DataFrame, ticks: DataFrame, threshold_percent: float = 0.5, tolerance_seconds: int = 900) -> DataFrame:
    """``event_id, flags``: what prices near each event say, over all instruments, as a comma-joined list.

    All prices of an event and instrument are found by one join on nearest ticks, and pivoted.
    """
    points = events.sparkSession.createDataFrame(list(CONFIRMATION.items()), "point string, minutes int")
    asks = events.select("event_id", "ts").crossJoin(F.broadcast(instruments.select("symbol"))).crossJoin(F.broadcast(points))
    found = asof.nearest(asks, ticks, ["symbol"], "ts", ["close"], tolerance_seconds, F.col("minutes").cast("long") * 60)
    p = found.groupBy("event_id", "symbol").agg(*[F.max(F.when(F.col("point") == c, F.col("close"))).alias(c) for c in CONFIRMATION])
    change = lambda a, b: 100 * (F.try_divide(F.col(a), F.col(b)) - 1)
    p = p.select("event_id", change("base", "before").alias("pre"), change("m5", "base").alias("a"), change("m30", "base").alias("b"))
    large = lambda c: F.coalesce(F.abs(c) >= threshold_percent, F.lit(False))
    both = lambda c: F.coalesce(F.bool_or(F.col(c) >= threshold_percent), F.lit(False)) & F.coalesce(F.bool_or(F.col(c) <= -threshold_percent), F.lit(False))
    f = p.groupBy("event_id").agg(
        (F.count("a") + F.count("b")).alias("n"), F.bool_or(large("a") | large("b")).alias("hit"), F.bool_or(large("pre")).alias("moved"), (both("a") | both("b")).alias("apart"),
        F.bool_or(large("a") & large("b") & F.coalesce(F.col("a") * F.col("b") < 0, F.lit(False))).alias("turned"), F.bool_or(F.col("pre").isNull() | F.col("a").isNull() | F.col("b").isNull()).alias("lacks"),
    )
    flags = (
        (F.col("hit"), "confirmed_by_market"), ((F.col("n") > 0) & ~F.col("hit"), "no_material_reaction"), (F.col("moved"), "market_moved_before_headline"),
        (F.col("apart"), "cross_asset_divergence"), (F.col("turned"), "initial_move_reversed"), ((F.col("n") == 0) | F.col("lacks"), "insufficient_market_data"),
    )
    return f.select("event_id", F.concat_ws(",", *[F.when(c, name) for c, name in flags]).alias("flags"))


def _matched(prices: np.ndarray, times: np.ndarray, horizon: int) -> tuple[int, float | None]:
    """(pairs, volatility): anchors from the first sample on, each with the first sample from the horizon on.

    A pair counts if its second sample is at most a median gap late; the next anchor is the pair's second sample, so
    pairs don't overlap.
    """
    if len(times) < 2:
        return 0, None
    gap = float(np.median(np.diff(times)))
    moves, at = [], 0
    while at < len(times):
        to = int(np.searchsorted(times, times[at] + horizon))
        if to >= len(times):
            break
        if times[to] - times[at] - horizon <= gap and prices[at] != 0:
            moves.append((prices[to] / prices[at] - 1) * 100)
            at = to
        else:
            at += 1
    return len(moves), float(np.std(moves)) if len(moves) >= 2 else None


def matched_volatility(samples: DataFrame, by: Sequence[str], horizon_seconds: int) -> DataFrame:
    """``by..., pairs, volatility``: spread of non-overlapping moves over a horizon, of ``at`` (seconds) and ``close``.

    Each pair depends on the one before, so a group is read in order; a group is one window before one event, whose
    samples are bounded by the lookback and the cadence.  Samples of one time count once; missing prices are left out.
    """
    keys = list(by)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[np.isfinite(frame["close"])].sort_values(["at", "close"]).drop_duplicates("at")
        pairs, volatility = _matched(frame["close"].to_numpy(), frame["at"].to_numpy(), horizon_seconds)
        return frame[keys].head(1).assign(pairs=pairs, volatility=volatility)

    types = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    return samples.groupBy(*keys).applyInPandas(run, f"{types}, pairs long, volatility double")


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The median of ``values[low:high]`` of each range, none of them empty.

    Ranks are split by their bits from the highest on, as in a wavelet matrix, and all ranges go down together, so the
    cost of a range doesn't depend on its length.
    """
    levels, rank = np.unique(values, return_inverse=True)
    count = high - low
    a, b = np.tile(low, 2), np.tile(high, 2)
    k = np.concatenate([(count - 1) // 2, count // 2])
    found = np.zeros(len(k), dtype=np.int64)
    for bit in reversed(range(max(1, int(len(levels) - 1).bit_length()))):
        zero = (rank >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        left, right = before[a], before[b]
        low_half = k < right - left
        found = np.where(low_half, found, found | (1 << bit))
        k = np.where(low_half, k, k - (right - left))
        a, b = np.where(low_half, left, before[-1] + a - left), np.where(low_half, right, before[-1] + b - right)
        rank = np.concatenate([rank[zero], rank[~zero]])
    middle = levels[found]
    return (middle[: len(count)] + middle[len(count) :]) / 2


def _matched_windows(prices: np.ndarray, times: np.ndarray, low: np.ndarray, high: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, volatility, nan if null): ``_matched`` of each window ``low:high`` of the samples; all windows step together."""
    pairs, volatility = np.zeros(len(low), dtype=np.int64), np.full(len(low), np.nan)
    to = np.searchsorted(times, times + horizon)
    slack = np.where(to < len(times), times[np.minimum(to, len(times) - 1)] - times - horizon, np.inf)
    window = np.flatnonzero(high - low >= 2)
    if not len(window):
        return pairs, volatility
    at, end, gap = low[window], high[window], _middle(np.diff(times), low[window], high[window] - 1)
    owners, moves = [], []
    while len(window):
        inside = (at < end) & (to[np.minimum(at, len(times) - 1)] < end)
        window, at, end, gap = window[inside], at[inside], end[inside], gap[inside]
        fits = (slack[at] <= gap) & (prices[at] != 0)
        owners.append(window[fits])
        moves.append((prices[to[at[fits]]] / prices[at[fits]] - 1) * 100)
        at = np.where(fits, to[at], at + 1)
    owner, move = np.concatenate(owners), np.concatenate(moves)
    pairs = np.bincount(owner, minlength=len(low))
    mean = np.bincount(owner, move, len(low)) / np.maximum(pairs, 1)
    square = np.bincount(owner, (move - mean[owner]) ** 2, len(low)) / np.maximum(pairs, 1)
    return pairs, np.where(pairs >= 2, np.sqrt(square), np.nan)


def matched_volatility_before(asks: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, seconds: int, horizon_seconds: int) -> DataFrame:
    """``asks`` with ``pairs, volatility`` of the ``seconds`` before each one's time, as of ``matched_volatility``.

    ``ticks``: ``by..., ts, close``; a tick at the ask's own time is left out, asks without a tick have no row, equal rows
    of ``asks`` count once.  Asks meet ticks by stretches of ``seconds``: a task holds two stretches of one key's ticks and
    reads each window where it lies, so windows are never written out.
    """
    keys, size, columns = list(by), seconds * 1_000_000, asks.columns
    finite = F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < float("inf"))
    tick = ticks.filter(finite).groupBy(*keys, micros(ts).alias("__at")).agg(F.min(F.col("close").cast("double")).alias("__close"))
    slot = F.floor(F.col("__at") / size)
    tick = tick.select(*keys, "__at", "__close", F.explode(F.array(slot, slot + 1)).alias("__slot"))
    ask = asks.distinct().withColumn("__at", micros(ts)).withColumn("__slot", slot)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    def run(group: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
        samples = samples.sort_values("__at")
        at, moment = samples["__at"].to_numpy(), group["__at"].to_numpy()
        low, high = np.searchsorted(at, moment - size), np.searchsorted(at, moment)
        some = high > low
        group, low, high = group[some], low[some], high[some]
        pairs, volatility = _matched_windows(samples["__close"].to_numpy(), at / 1_000_000, low, high, horizon_seconds)
        return group[columns].assign(pairs=pairs, volatility=volatility)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema)
    groups = [df.groupBy(*keys, "__slot") for df in (ask.filter(known), tick.filter(known))]
    return groups[0].cogroup(groups[1]).applyInPandas(run, f"{types}, pairs long, volatility double")


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar, from the golden number, the century's epact and the Sunday letter."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    # the paschal full moon, in days after 21 March; two late epacts move a day earlier
    moon = epact - (epact == 29 or (epact == 28 and golden > 10))
    full = dt.date(year, 3, 21) + dt.timedelta(moon)
    return full + dt.timedelta(7 - (full.weekday() + 1) % 7)


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday (0: Monday) of a month; from the end where n is negative."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (dt.date(year + month // 12, month % 12 + 1, 1)) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7 + 7 * (-n - 1))


def _observed(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def us_holidays(year: int) -> set[dt.date]:
    """Days on which United States equity venues stay closed."""
    fixed = [dt.date(year, 1, 1), dt.date(year, 7, 4), dt.date(year, 12, 25)] + ([dt.date(year, 6, 19)] if year >= 2022 else [])
    moving = [(1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (11, 3, 4)]
    days = {_observed(d) for d in fixed if not (d.month == 1 and d.weekday() == 5)}
    return days | {_nth_weekday(year, m, w, n) for m, w, n in moving} | {easter(year) - dt.timedelta(2)}


def us_early_closes(year: int) -> set[dt.date]:
    """Days that end at 13:00: before Independence Day and Christmas, after Thanksgiving; weekdays only."""
    days = {dt.date(year, 7, 3), dt.date(year, 12, 24), _nth_weekday(year, 11, 3, 4) + dt.timedelta(1)}
    return {d for d in days if d.weekday() < 5} - us_holidays(year)


def session_rows(first: dt.date, last: dt.date) -> Iterator[tuple[str, dt.date, int, int]]:
    day = first
    while day <= last:
        if day.weekday() < 5 and day not in us_holidays(day.year):
            yield "us_equity", day, 9 * 60 + 30, 13 * 60 if day in us_early_closes(day.year) else 16 * 60
        day += dt.timedelta(1)


def sessions(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """``venue, day, open_minute, close_minute, minutes, minutes_before``: the venue's sessions, in local time.

    ``minutes_before`` counts trading minutes since the first session, so trading time between two moments is a difference
    of two look-ups.
    """
    rows, before = [], 0
    for venue, day, open_, close in session_rows(first, last):
        rows.append((venue, day, open_, close, close - open_, before))
        before += close - open_
    return spark.createDataFrame(rows, "venue string, day date, open_minute int, close_minute int, minutes int, minutes_before long")


def session_close_after(calendar: DataFrame, rows: DataFrame, ts: str) -> DataFrame:
    """``rows`` with ``target``: the first close of the venue after the moment; null beyond the calendar.

    Each day of the calendar gets its own close and that of the next session, so rows look up one bounded table by day.
    """
    days = calendar.select("day", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("close_minute"))).alias("close"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left")
    later = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    table = span.select("day", "close", F.min("close").over(later).alias("next_close"))
    asked = rows.withColumn("day", F.to_date(ts)).join(F.broadcast(table), "day", "left")
    return asked.withColumn("target", F.when(F.col("close") > F.col(ts), F.col("close")).otherwise(F.col("next_close"))).drop("day", "close", "next_close")
