"""Macro series: trend signals, surprises, consensus, regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.numeric import ratio, sign_state

DIRECTIONS = ("higher", "lower", "unchanged")


def year_over_year(series: DataFrame, lag: int = 12) -> DataFrame:
    """Adds ``yoy``: the change against the value ``lag`` observations earlier, by place, not by date; null if that is 0."""
    before = F.lag("value", lag).over(Window.partitionBy("series_id").orderBy("observed_at"))
    return series.withColumn("yoy", ratio(F.col("value") - before, before))


def transition(now: Column, before: Column) -> Column:
    """How a direction follows the one of the window before."""
    same = F.when(before == "unchanged", "stable").otherwise("stalled")
    moved = F.when(before == now, "persisting").when(before == "unchanged", "emerging").otherwise("reversal")
    return F.when(before.isNull(), "not_comparable").when(now == "unchanged", same).otherwise(moved)


def trend_signals(series: DataFrame, lag: int, tolerance: float) -> DataFrame:
    """``series_id, observed_at, latest, reference, delta, direction, transition`` of each series' last observation.

    The reference lies ``lag`` observations earlier, or one where the series is shorter.  Only the last ``2 lag + 1``
    observations of each series are shuffled.
    """
    w = Window.partitionBy("series_id").orderBy(F.desc("observed_at"))
    some = series.filter("value is not null").withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= 2 * lag + 1)
    at = lambda k: F.max(F.when(F.col("__rank") == k, F.col("value")))
    g = some.groupBy("series_id").agg(
        F.count("*").alias("n"), F.max("observed_at").alias("observed_at"), at(1).alias("latest"), at(2).alias("second"), at(3).alias("third"), at(lag + 1).alias("far"), at(2 * lag + 1).alias("farther"),
    ).filter("n > 1")
    long_ = F.col("n") > lag
    g = g.withColumns({"reference": F.when(long_, F.col("far")).otherwise(F.col("second")), "earlier": F.when(long_, F.col("farther")).otherwise(F.col("third"))})
    delta = F.col("latest") - F.col("reference")
    g = g.withColumn("delta", delta).withColumn("direction", sign_state("delta", tolerance, DIRECTIONS))
    before = sign_state(F.col("reference") - F.col("earlier"), tolerance, DIRECTIONS)
    return g.select("series_id", "observed_at", "latest", "reference", "delta", "direction", transition(F.col("direction"), before).alias("transition"))


def consensus(signals: DataFrame, domain: str, higher: str, lower: str) -> DataFrame:
    """``domain, state``: what the series of a domain agree on; unchanged ones don't vote."""
    up, down = F.bool_or(F.col("direction") == "higher"), F.bool_or(F.col("direction") == "lower")
    state = F.when(up & down, "conflicting").when(up, higher).when(down, lower).otherwise("stable")
    return signals.groupBy(domain).agg(state.alias("state"))


def composite(policy: Column, growth: Column, inflation: Column, labor: Column, financial: Column) -> Column:
    """Regime from the states of five domains, by the first rule that fits; too few known domains give no regime."""
    known = sum((F.when(c.isNotNull() & (c != "insufficient_data"), 1).otherwise(0) for c in (policy, growth, inflation, labor, financial)), F.lit(0))
    firm = lambda c: c.isin("stable", "strengthening")
    return (
        F.when(known < 3, "insufficient_coverage").when((policy == "easing") & (financial == "tightening"), "policy_easing_with_market_stress")
        .when((inflation == "heating") & (financial == "tightening"), "inflationary_tightening")
        .when((inflation == "cooling") & ((labor == "weakening") | (growth == "weakening")), "disinflationary_slowdown")
        .when((inflation == "cooling") & firm(growth) & firm(labor) & financial.isin("stable", "easing"), "soft_landing_configuration").otherwise("mixed_transition")
    )


def surprises(releases: DataFrame, key: str, ts: str) -> DataFrame:
    """Adds ``surprise`` and ``zscore``: against the population of the key's earlier surprises, two at least."""
    s = releases.withColumn("surprise", F.col("actual") - F.col("consensus"))
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    sd = F.stddev_pop("surprise").over(w)
    z = F.when((F.count("surprise").over(w) >= 2) & (sd > 0), (F.col("surprise") - F.avg("surprise").over(w)) / sd)
    return s.withColumn("zscore", z)


STAGES = ("developing", "t0", "reaction", "final")


def advance_stage(current: Column, observed: Column) -> Column:
    """The later of two stages; a stage never goes back."""
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STAGES]), c), F.lit(0)), F.lit(1))
    return F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.greatest(place(current), place(observed)).cast("int"))


def bands(value: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    """Name of the first band whose upper bound, left out, lies above the value."""
    out = F.lit(last)
    for bound, name in reversed(cuts):
        out = F.when(value < bound, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def statements(series: DataFrame, by: list[str], at: str, value: str, still: float) -> DataFrame:
    """``by, at, statement``: each observation in words against the one before it; less than ``still`` is no move."""
    w = Window.partitionBy(*by).orderBy(at)
    before, since, now = F.lag(value).over(w), F.lag(at).over(w), F.col(value)
    whole = lambda c: F.round(c).cast("long").cast("string")
    held = F.concat(F.lit(" held at "), whole(now), F.lit(" versus "), whole(before), F.lit(" over the prior observation"))
    moved = F.concat(F.when(now > before, " rose ").otherwise(" fell "), whole(F.abs(now - before)), F.lit(" over the prior observation to "), whole(now), F.lit(" from "), whole(before))
    said = F.when(before.isNull(), " has no prior observation").when(F.abs(now - before) < still, held).otherwise(moved)
    span = F.coalesce(F.concat(F.lit(" ("), since.cast("string"), F.lit(" to "), F.col(at).cast("string"), F.lit(")")), F.lit(""))
    return series.select(*by, at, F.concat(*by, said, span, F.lit(".")).alias("statement"))
