"""Windows that wait for a price: state that ticks and new windows change batch by batch, and that ends with a window."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.sources.buckets import Buckets
from quaylight.sources.scratch import Scratch
from quaylight.sources.sinks import Table

WINDOW = "window_id long, symbol string, target_at timestamp_ntz"
_STATE = f"{WINDOW}, tick_at timestamp_ntz, price double"
_CLOCK = "clock timestamp_ntz, batch long"


class PendingWindows:
    """Windows of ``WINDOW`` that take the last price up to their target, ``seconds`` old at most.

    ``advance`` takes a batch of ticks and of new windows, in any order of time.  The clock is the latest time seen less
    ``late`` seconds.  A window whose target the clock has passed is settled, with a price or without, and leaves the
    state; ticks that no window can need any more leave it too.  A tick behind the clock is late and counts for windows
    still open; a window that comes when the ticks for it may be gone is settled by those that are left.

    State lies in bucketed tables, so a batch reads and rewrites the buckets of its symbols: windows by symbol and day of
    the target, ticks likewise.  A batch that is run again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: int, late: int, buckets: int = 16):
        self.spark, self.seconds, self.late = spark, seconds, late
        self.waiting = Buckets(spark, f"{folder}/waiting", ["window_id"], buckets)
        self.ticks = Buckets(spark, f"{folder}/ticks", ["symbol", "slot"], buckets)
        self.settled = Buckets(spark, f"{folder}/settled", ["window_id"], buckets)
        self.clock = Table(spark, f"{folder}/clock")

    def now(self) -> tuple[datetime | None, int]:
        """(clock, number of the last batch)."""
        rows = self.clock.read()
        last = rows.first() if rows is not None else None
        return (last["clock"], last["batch"]) if last else (None, -1)

    def _slot(self, at: str) -> Column:
        return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (1_000_000 * self.seconds)).cast("long")

    def _matched(self, windows: DataFrame, ticks: DataFrame) -> DataFrame:
        """Windows with ``best``, their last tick by (time, price), or null.

        Ticks and windows lie in one line for each symbol and stretch of time, which begins with the last tick of the stretch
        before; so no window is paired with ticks, and each tick is one row however many windows hold it.
        """
        dealt = ticks.repartition("symbol", "slot").groupBy("symbol", "slot", "tick_at").agg(F.max("price").alias("price"))
        last = dealt.groupBy("symbol", F.col("slot") + 1).agg(F.max_by("price", "tick_at").alias("price"), F.max("tick_at").alias("tick_at")).toDF("symbol", "slot", "price", "tick_at")
        known = dealt.unionByName(last).select("symbol", "slot", F.col("tick_at").alias("at"), F.struct("tick_at", "price").alias("tick"))
        asked = windows.select("symbol", self._slot("target_at").alias("slot"), F.col("target_at").alias("at"), F.struct(*windows.columns).alias("window"))
        # a tick at the target itself counts, so ticks come first
        line = Window.partitionBy("symbol", "slot").orderBy("at", F.col("window").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = known.unionByName(asked, allowMissingColumns=True).withColumn("best", F.last("tick", ignorenulls=True).over(line)).filter("window is not null")
        inside = F.col("best.tick_at") >= F.col("at") - F.make_dt_interval(secs=F.lit(self.seconds).cast("decimal(18,6)"))
        return rows.select("window.*", F.when(inside, F.col("best")).alias("best"))

    def advance(self, batch: int, ticks: DataFrame, windows: DataFrame) -> None:
        """``ticks``: ``symbol, ts, close``; ``windows``: ``WINDOW``.  A window that is known already stays as it is."""
        clock, last = self.now()
        if batch <= last:
            return
        fresh = ticks.filter("symbol is not null and ts is not null and close is not null").select("symbol", F.col("ts").cast("timestamp_ntz").alias("tick_at"), F.col("close").alias("price"))
        # dealt before repeated ticks go, so a task holds its own stretches and not its split of the input
        fresh = fresh.withColumn("slot", self._slot("tick_at")).repartition("symbol", "slot").groupBy("symbol", "slot", "tick_at").agg(F.max("price").alias("price"))
        step = Scratch(self.spark, "windows")
        fresh = step.put("ticks", fresh)
        seen = fresh.agg(F.max("tick_at").alias("t")).first()["t"]
        waiting, done = self.waiting.read(), self.settled.read()
        new = windows.filter("window_id is not null and symbol is not null and target_at is not null").dropDuplicates(["window_id"]).select("window_id", "symbol", F.col("target_at").cast("timestamp_ntz").alias("target_at"))
        for known in (waiting, done):
            if known is not None:
                new = new.join(known.select("window_id"), "window_id", "left_anti")
        empty = self.spark.createDataFrame([], _STATE)
        blank = new.withColumns({"tick_at": F.lit(None).cast("timestamp_ntz"), "price": F.lit(None).cast("double"), "new": F.lit(True)})
        state = (empty if waiting is None else waiting.select(*empty.columns)).withColumn("new", F.lit(False)).unionByName(blank)
        kept = self.ticks.read()
        found = self._matched(state, fresh if kept is None else fresh.unionByName(kept.select(*fresh.columns)))
        held = F.struct("tick_at", "price")
        better = F.col("best").isNotNull() & (F.col("tick_at").isNull() | (F.col("best") > held))
        found = found.withColumn("better", better).withColumn("b", F.when(F.col("better"), F.col("best")).otherwise(held))
        found = found.select("window_id", "symbol", "target_at", F.col("b.tick_at").alias("tick_at"), F.col("b.price").alias("price"), (F.col("new") | F.col("better")).alias("changed"))
        time = max((t for t in (clock, seen and seen - timedelta(seconds=self.late)) if t is not None), default=None)
        due = F.lit(False) if time is None else F.col("target_at") < F.lit(time).cast("timestamp_ntz")
        # what the batch changes: new windows, those with a later tick, those that end
        found = step.put("found", found.withColumn("due", due).filter("changed or due").drop("changed"))
        ended = found.filter("due").drop("due").withColumn("status", F.when(F.col("price").isNull(), "unresolved").otherwise("resolved"))
        self.settled.keep_latest(ended, [F.col("tick_at").desc_nulls_last(), F.col("price").desc_nulls_last()], "windows", batch)
        self._replace(found, batch)
        self.ticks.change(fresh, lambda old, rows: self._pruned(rows if old is None else old.unionByName(rows).distinct(), time), "windows", batch)
        self.clock.write(self.spark.createDataFrame([(time, batch)], _CLOCK).coalesce(1))
        step.drop("ticks", "found")

    def _pruned(self, ticks: DataFrame, time: datetime | None) -> DataFrame:
        return ticks if time is None else ticks.filter(F.col("tick_at") >= F.lit(time - timedelta(seconds=self.seconds)).cast("timestamp_ntz"))

    def _replace(self, found: DataFrame, batch: int) -> None:
        """Windows that the batch changed come anew, those that ended leave."""

        def combine(old: DataFrame | None, rows: DataFrame) -> DataFrame:
            still = rows.filter("not due").drop("due")
            return still if old is None else old.join(rows.select("window_id"), "window_id", "left_anti").unionByName(still)

        self.waiting.change(found, combine, "windows", batch)

    def result(self) -> DataFrame:
        """``window_id, symbol, target_at, tick_at, price, status`` of all windows, pending ones among them."""
        done, waiting = self.settled.read(), self.waiting.read()
        parts = [done] if done is not None else []
        if waiting is not None:
            parts.append(waiting.withColumn("status", F.lit("pending")))
        out = self.spark.createDataFrame([], f"{_STATE}, status string")
        for p in parts:
            out = out.unionByName(p.select(*out.columns))
        return out


def run_windows(events: DataFrame, windows: PendingWindows, state: str, columns: Sequence[str] = ("kind", "window_id", "symbol", "ts", "close")) -> None:
    """Runs a stream of ticks (``kind`` ``tick``) and windows (``window``, ``ts`` is the target) into the state."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns)
        windows.advance(number, rows.filter("kind = 'tick'").select("symbol", "ts", "close"), rows.filter("kind = 'window'").select("window_id", "symbol", F.col("ts").alias("target_at")))

    events.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
