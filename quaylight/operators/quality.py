"""Data quality: freshness, gaps, duplicates, anomalies, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.times import business_days, micros

STEPS = {"daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH", "quarterly": "INTERVAL 3 MONTH"}


def freshness(rows: DataFrame, by: str, ts: str, now: str, max_hours: float, daily: bool = False) -> DataFrame:
    """``by, latest_at, age_hours, state``: fresh, stale or future; daily series age in business days of 24 hours."""
    at = F.lit(now).cast("timestamp_ntz")
    g = rows.groupBy(by).agg(F.max(ts).alias("latest_at")).withColumn("__now", at)
    days = F.greatest(F.lit(0), business_days(F.to_date("latest_at"), F.to_date("__now")) - 1) * 24.0
    hours = (micros("__now") - micros("latest_at")) / 3_600_000_000
    age = F.when(F.col("latest_at") > F.col("__now"), 0.0).otherwise(days if daily else hours)
    state = F.when(F.col("latest_at").isNull(), "no data").when(F.col("latest_at") > F.col("__now"), "future").when(F.col("age_hours") > max_hours, "stale").otherwise("fresh")
    return g.withColumn("age_hours", age).select(by, "latest_at", "age_hours", state.alias("state"))


def gaps(rows: DataFrame, by: str, period: str, step: str) -> DataFrame:
    """``by, period`` of each missing period between a key's first and last one; ``period`` holds first days."""
    have = rows.select(by, period).distinct()
    ends = have.groupBy(by).agg(F.min(period).alias("__a"), F.max(period).alias("__b"))
    wanted = ends.select(by, F.explode(F.sequence("__a", "__b", F.expr(STEPS[step]))).alias(period))
    return wanted.join(have, [by, period], "left_anti")


def duplicates(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """``by, total, distinct_rows, repeats``; tuples with nulls count as tuples."""
    one = rows.groupBy(by, *columns).agg(F.count("*").alias("__n"))
    return one.groupBy(by).agg(F.sum("__n").alias("total"), F.count("*").alias("distinct_rows"), (F.sum("__n") - F.count("*")).alias("repeats"))


def anomalies(rows: DataFrame, by: str, ts: str, value: str, threshold: float = 5.0, recent: int = 5) -> DataFrame:
    """``by, n, anomalies``: of the last ``recent`` values those over ``threshold`` sample deviations from the mean.

    Fewer than five values or none that differ show no anomaly.
    """
    rows = rows.filter(F.col(value).isNotNull())
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    w = Window.partitionBy(by).orderBy(F.desc(ts), F.desc(value))
    last = rows.select(by, value, F.row_number().over(w).alias("__rank")).filter(F.col("__rank") <= recent)
    odd = (F.col("n") >= 5) & (F.col("__sd") > 0) & (F.abs(F.col(value) - F.col("__mean")) > threshold * F.col("__sd"))
    return last.join(g, by).groupBy(by, "n").agg(F.count_if(odd).alias("anomalies"))


def verdicts(results: DataFrame, required: DataFrame, by: str) -> DataFrame:
    """``by, verdict``: degraded if a required check fails, unknown if one is missing, else healthy.

    ``results``: ``by, check, healthy``; ``required``: ``by, check``.  A missing check outweighs a failed one.
    """
    both = required.join(results.select(by, "check", "healthy", F.lit(True).alias("__there")), [by, "check"], "left")
    there = F.coalesce("__there", F.lit(False))
    verdict = F.when(F.bool_or(~there), "unknown").when(F.bool_or(F.coalesce(~F.col("healthy"), F.lit(False))), "degraded").when(F.bool_or(F.col("healthy").isNull()), "unknown").otherwise("healthy")
    return both.groupBy(by).agg(verdict.alias("verdict"))


def stage_status(rows: DataFrame, by: str, status: str = "status") -> DataFrame:
    """failed, partial, running, completed or skipped: what the statuses of a key's stages add up to."""
    any_, all_ = (lambda s: F.bool_or(F.col(status) == s)), (lambda s: F.bool_and(F.col(status) == s))
    out = F.when(all_("failed"), "failed").when(any_("running"), "running").when(any_("failed"), "partial").when(all_("skipped"), "skipped").otherwise("completed")
    return rows.groupBy(by).agg(out.alias("state"), F.count("*").alias("stages"))


def materiality(components: Sequence[Column]) -> Column:
    """Product of components in 0 to 1, to 15 places; null if one is missing or out of range."""
    ok, product = F.lit(True), F.lit(1.0)
    for c in components:
        ok, product = ok & c.isNotNull() & c.between(0, 1), product * c
    return F.when(F.coalesce(ok, F.lit(False)), F.round(product, 15))


def novelty(exact: Column, similarity: Column, count: Column, default: float = 1.0) -> Column:
    """0 for exact copies, else one less the similarity, else by the number of near copies, else the default."""
    return F.when(F.coalesce(exact, F.lit(False)), 0.0).when(similarity.isNotNull(), 1 - similarity).when(count.isNotNull(), F.try_divide(F.lit(1.0), 1 + count)).otherwise(default)
