"""Structured Streaming: rollups, idempotent intake, last quotes, routing, story clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaylight.operators import stories
from quaylight.sources.buckets import Buckets
from quaylight.sources.scratch import Scratch


def stream(spark: SparkSession, path: str, ts: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream; ``ts`` becomes a timestamp, as watermarks need.

    The path is given as a pattern, since a stream's plain path must be a folder.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = reader.parquet(f"{path}*")
    return out.withColumn(ts, F.col(ts).cast("timestamp")) if ts else out


def rollup(ticks: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Bars by symbol; a bar is final once the watermark has passed its end, and later ticks are dropped."""
    w = F.window("ts", f"{seconds} seconds")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(
        F.min_by("close", "ts").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "ts").alias("close"), F.count("*").alias("n")
    )
    return bars.select("symbol", F.unix_seconds("window.start").alias("bucket_s"), "open", "high", "low", "close", "n")


def once(events: DataFrame, by: Sequence[str], ts: str = "ts", within: str = "1 day") -> DataFrame:
    """The first event of each key; repeats within the watermark are dropped."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(by))


def routed(events: DataFrame) -> DataFrame:
    """A row for each job that an event starts, by its type and weight."""
    jobs = F.array_compact(F.array(F.when(F.col("event_type") == "purchase", "score"), F.when(F.col("value") >= 90, "alert"), F.when(F.col("event_type").isin("error", "signup"), "review")))
    return events.select("event_id", "ts", F.explode(jobs).alias("job"))


def run_into(df: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table of the scratch folder, with its checkpoint beside it."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", scratch.path(f"{name}-state")).trigger(availableNow=True).start(scratch.path(name))
    query.awaitTermination()
    return scratch.spark.read.schema(df.schema).parquet(scratch.path(name))


def keep_last(df: DataFrame, table: Buckets, order: Sequence[Column], state: str, writer: str = "stream") -> None:
    """Runs a stream into a table with the first row of each key by ``order``.

    A batch rewrites the buckets that its keys are in; one that is run again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.keep_latest(batch, order, writer, number)

    df.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def cluster_stories(items: DataFrame, block: Sequence[str], window_seconds: float, threshold: float) -> DataFrame:
    """``id, cluster, contribution, score``: items join stories of their block; state holds the stories inside the window.

    ``items``: the columns of ``stories.ITEM`` and the block's.  Within a batch items are taken by (at, id).
    """
    sets = ("tokens", "sources", "entities", "markets")
    state_type = "ids array<long>, seen array<double>, " + ", ".join(f"{x} array<array<string>>" for x in sets)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = []
        if state.exists:
            live = [{"id": int(i), "seen": float(s), **{x: (set if x == "sources" else frozenset)(v) for x, v in zip(sets, of, strict=True)}} for i, s, *of in zip(*state.get, strict=True)]
        clusters = stories.Clusters(window_seconds, threshold, live)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = [stories.add_item(clusters, r) for r in rows.itertuples(index=False)]
        now = clusters.stories
        state.update(([s["id"] for s in now], [s["seen"] for s in now], *([sorted(s[x]) for s in now] for x in sets)))
        yield pd.DataFrame(out, columns=["id", "cluster", "contribution", "score"])

    return items.groupBy(*block).applyInPandasWithState(run, "id long, cluster long, contribution string, score double", state_type, "append", GroupStateTimeout.NoTimeout)
