"""As-of joins: the tick before, after or nearest to an event.

Ticks and events are bucketed by time besides their key, so one busy key spreads over many tasks.  What a bucket can't
answer comes from a summary of the buckets before it, which has one row for each key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.times import micros

DAY = 86_400


def _last_tick(events: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], seconds: int | None, offset_seconds: int | Column = 0, strict: bool = False, forward: bool = False, least: bool = False, bucket_seconds: int = DAY) -> DataFrame:
    """Event rows with the last tick up to each one's time plus the offset, or, ``forward``, with the first from there on.

    Looking forward is looking back along time run backwards.  Of ticks at one time the one with the greatest values
    counts, or the ``least``.
    """
    by, size, sign = list(by), bucket_seconds * 1_000_000, -1 if forward else 1
    picked = F.struct(F.col(ts).alias("tick_ts"), *values)
    tick = ticks.select(*by, (micros(ts) * sign).alias("__at"), picked.alias("__tick"))
    tick = tick.groupBy(*by, "__at").agg((F.min if least else F.max)("__tick").alias("__tick")).withColumn("__bucket", F.floor(F.col("__at") / size))
    columns = events.columns
    event = events.withColumns({"__at": (micros(ts) + offset_seconds * 1_000_000) * sign, "__row": F.struct(*columns)}).withColumn("__bucket", F.floor(F.col("__at") / size))
    # at one time, a tick counts for the event only if it may be as late as the event
    both = tick.select(*by, "__bucket", "__at", "__tick", F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(event.schema["__row"].dataType).alias("__row"))
    both = both.unionByName(event.select(*by, "__bucket", "__at", F.lit(None).cast(tick.schema["__tick"].dataType).alias("__tick"), F.lit(0 if strict else 1).alias("__side"), "__row"))
    w = Window.partitionBy(*by, "__bucket").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__tick", F.last("__tick", ignorenulls=True).over(w)).filter(F.col("__row").isNotNull())
    # the last tick of each bucket, and for each bucket with events the last one before it
    last = tick.groupBy(*by, "__bucket").agg(F.max_by("__tick", "__at").alias("__tick"))
    ends = last.withColumn("__asks", F.lit(False)).unionByName(event.select(*by, "__bucket").distinct().withColumns({"__tick": F.lit(None).cast(tick.schema["__tick"].dataType), "__asks": F.lit(True)}))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__tick", ignorenulls=True).over(earlier)).filter("__asks").select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate([*by, "__bucket"])], "__carried")
    on = [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate([*by, "__bucket"])]
    out = found.join(carried, on, "left").withColumn("__tick", F.coalesce("__tick", "__carried"))
    if seconds is not None:
        age = F.col("__at") - F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', __tick.tick_ts)") * sign
        out = out.withColumn("__tick", F.when(age <= seconds * 1_000_000, F.col("__tick")))
    return out.select(*[F.col("__row")[c].alias(c) for c in columns], *[F.col("__tick")[c].alias(c) for c in ("tick_ts", *values)])


def asof_before(events: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], strict: bool = True, seconds: int | None = None, bucket_seconds: int = DAY) -> DataFrame:
    """``events`` with the ``values`` and time (``tick_ts``) of the last tick before each (or at it, if not ``strict``).

    ``seconds`` bounds the tick's age, the bound included.  Without a tick the added columns are null.  Of ticks at one
    time the one with the greatest values counts.
    """
    return _last_tick(events, ticks, by, ts, values, seconds, strict=strict, bucket_seconds=bucket_seconds)


def asof_after(events: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], seconds: int, offset_seconds: int | Column = 0) -> DataFrame:
    """The first tick from ``offset_seconds`` after each event on, up to ``seconds`` later, both bounds included."""
    return _last_tick(events, ticks, by, ts, values, seconds, offset_seconds, forward=True, least=True)


def asof_until(events: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], seconds: int, offset_seconds: int | Column = 0) -> DataFrame:
    """The last tick up to ``offset_seconds`` after each event, no more than ``seconds`` earlier, both bounds included."""
    return _last_tick(events, ticks, by, ts, values, seconds, offset_seconds, least=True)


def nearest(events: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], seconds: int, offset_seconds: int | Column = 0, bucket_seconds: int = DAY) -> DataFrame:
    """The tick nearest to ``offset_seconds`` after each event within ``seconds``; of two as near, the earlier.

    Both neighbours come from one union of ticks and events, dealt once and sorted along time and against it, and from one
    summary with the ends of each bucket.
    """
    by, size, columns = list(by), bucket_seconds * 1_000_000, events.columns
    tick = ticks.select(*by, micros(ts).alias("__at"), F.struct(F.col(ts).alias("tick_ts"), *values).alias("__tick")).groupBy(*by, "__at").agg(F.min("__tick").alias("__tick"))
    tick = tick.withColumn("__bucket", F.floor(F.col("__at") / size))
    event = events.withColumns({"__at": micros(ts) + offset_seconds * 1_000_000, "__row": F.struct(*columns)}).withColumn("__bucket", F.floor(F.col("__at") / size))
    kind = tick.schema["__tick"].dataType
    no_tick, no_row = F.lit(None).cast(kind), F.lit(None).cast(event.schema["__row"].dataType)
    both = tick.select(*by, "__bucket", "__at", "__tick", F.lit(0).alias("__side"), no_row.alias("__row")).unionByName(event.select(*by, "__bucket", "__at", no_tick.alias("__tick"), F.lit(1).alias("__side"), "__row"))
    # a tick at the event's own time sorts before it: it is found from there and is nearest
    inside, up_to = Window.partitionBy(*by, "__bucket"), (Window.unboundedPreceding, 0)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    found = both.withColumns({"__before": last("__tick", inside.orderBy("__at", "__side").rowsBetween(*up_to)), "__after": last("__tick", inside.orderBy(F.desc("__at"), F.desc("__side")).rowsBetween(*up_to))}).filter(F.col("__row").isNotNull())
    ends = tick.groupBy(*by, "__bucket").agg(F.max_by("__tick", "__at").alias("__last"), F.min_by("__tick", "__at").alias("__first")).withColumn("__asks", F.lit(False))
    ends = ends.unionByName(event.select(*by, "__bucket").distinct().withColumns({"__last": no_tick, "__first": no_tick, "__asks": F.lit(True)}))
    key, others = Window.partitionBy(*by), (Window.unboundedPreceding, -1)
    carried = ends.withColumns({"__earlier": last("__last", key.orderBy("__bucket").rangeBetween(*others)), "__later": last("__first", key.orderBy(-F.col("__bucket")).rangeBetween(*others))}).filter("__asks")
    carried = carried.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate([*by, "__bucket"])], "__earlier", "__later")
    out = found.join(carried, [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate([*by, "__bucket"])], "left")
    gap = lambda t: F.abs(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {t}.tick_ts)") - F.col("__at"))
    out = out.withColumns({"__before": F.coalesce("__before", "__earlier"), "__after": F.coalesce("__after", "__later")}).withColumns({"__gap_before": gap("__before"), "__gap_after": gap("__after")})
    least = F.least("__gap_before", "__gap_after")
    chosen = F.when(least <= seconds * 1_000_000, F.when(F.col("__gap_before") <= F.coalesce("__gap_after", "__gap_before"), F.col("__before")).otherwise(F.col("__after")))
    return out.withColumn("__tick", chosen).select(*[F.col("__row")[c].alias(c) for c in columns], *[F.col("__tick")[c].alias(c) for c in ("tick_ts", *values)])


def ticks_before(events: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], seconds: int) -> DataFrame:
    """All ticks up to ``seconds`` before each event, the event's own time left out; events without any have no row."""
    size = seconds * 1_000_000
    event = events.withColumns({"__at": micros(ts), "__row": F.struct(*events.columns)})
    last = F.floor(F.col("__at") / size)
    event = event.select(*by, "__at", "__row", F.explode(F.array(last - 1, last)).alias("__bucket"))
    tick = ticks.select(*by, micros(ts).alias("__tick_at"), F.col(ts).alias("tick_ts"), *values).withColumn("__bucket", F.floor(F.col("__tick_at") / size))
    joined = event.join(tick, [*by, "__bucket"]).filter((F.col("__tick_at") < F.col("__at")) & (F.col("__tick_at") >= F.col("__at") - size))
    return joined.select(*[F.col("__row")[c].alias(c) for c in events.columns], "tick_ts", *values)


def slot_lasts(events: DataFrame, ticks: DataFrame, by: Sequence[str], ids: Sequence[str], ts: str, value: str, seconds: int, slot_seconds: int) -> DataFrame:
    """``ids..., slot, value``: the last known value of each slot of time in the ``seconds`` before each event.

    The event's own time is left out; a slot without ticks in there has no row, one whose values are all null has null.
    Slots count from 1970.  Events of equal ``ids`` (``by`` among them) are one, with all their stretches.  Ticks are cut to
    one row for each slot first; an event reads those of the slots before its own, and only its own slot as of its time.
    """
    keys, ids, size, back = list(by), list(ids), slot_seconds * 1_000_000, seconds * 1_000_000
    slot = lambda at: F.floor(at / size)
    tick = ticks.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias("__v")).withColumn("__at", micros(ts)).withColumn("__slot", slot(F.col("__at")))
    so_far = Window.partitionBy(*keys, "__slot").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("__v").isNotNull(), F.struct("__at", F.col("__v").alias("v"))), ignorenulls=True).over(so_far)
    tick = tick.withColumn("__known", known)
    last = tick.groupBy(*keys, "__slot").agg(F.max_by(F.struct("__at", "__known"), "__at").alias("__last"))
    asked = asof_before(events.select(*ids, ts).distinct(), tick.select(*keys, ts, "__known"), keys, ts, ["__known"], seconds=seconds)
    asked = asked.select(*ids, F.struct(micros(ts).alias("at"), micros("tick_ts").alias("tick_at"), F.col("__known").alias("known")).alias("__w")).filter("__w.at is not null")
    asked = asked.groupBy(*ids).agg(F.collect_list("__w").alias("__w"))
    slots = F.array_distinct(F.flatten(F.transform("__w", lambda w: F.sequence(slot(w["at"] - back), slot(w["at"] - 1)))))
    both = asked.withColumn("__slot", F.explode(slots)).join(last, [*keys, "__slot"])

    def seen(w: Column) -> Column:
        since, here = w["at"] - back, slot(w["at"]) == F.col("__slot")
        found = F.when(here, F.struct(w["tick_at"].alias("__at"), w["known"].alias("__known"))).otherwise(F.col("__last"))
        inside = (found["__at"] >= since) & (slot(found["__at"]) == F.col("__slot")) & (slot(w["at"]) >= F.col("__slot"))
        return F.when(inside, F.struct(F.when(found["__known"]["__at"] >= since, found["__known"]).alias("k")))

    best = both.withColumn("__best", F.array_max(F.transform("__w", seen))).filter("__best is not null")
    return best.select(*ids, F.col("__slot").alias("slot"), F.col("__best.k.v").alias(value))
