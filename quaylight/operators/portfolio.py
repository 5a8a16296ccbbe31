"""Portfolio context and what is known of cases and valuations: exposures, schedules, cohorts, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.numeric import is_finite, ratio

#: States of a case in order; the ones from which each milestone counts as reached.  Fixed values.
STATES = ("candidate", "forming", "corroborated", "research_ready", "mature", "weakening", "archived")
REACHED = {"forming": ("forming", "corroborated", "research_ready", "mature"), "corroborated": ("corroborated",), "research_ready": ("research_ready", "mature"), "mature": ("mature",)}
EVER = {"corroborated": ("corroborated", "research_ready", "mature"), "research_ready": ("research_ready", "mature"), "mature": ("mature",)}
#: How far a valuation by discounted cash goes; fixed values.
DCF = ("calculated", "enterprise_value_only", "unavailable")


def exposures(holdings: DataFrame, themes: DataFrame, dimensions: Sequence[str] = ("sector", "country", "currency"), tags: str = "theme_tags", weight: str = "weight", limit: int = 20) -> DataFrame:
    """``dimension, bucket, exposure, holdings``: the summed positive weights by each dimension and by tag, the largest ``limit`` of each.

    Tags that aren't a ``name`` of ``themes`` don't count; a holding counts for each of its tags, as often as it has it.
    A null bucket is a bucket.  Weights that aren't above 0 don't count.
    """
    held = holdings.filter(F.col(weight) > 0)
    by = [held.select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket"), weight) for d in dimensions]
    tagged = held.select(F.lit("theme").alias("dimension"), F.explode(tags).alias("bucket"), weight).join(themes.select(F.col("name").alias("bucket")).distinct(), "bucket", "left_semi")
    sums = reduce(DataFrame.unionByName, [*by, tagged.select("dimension", "bucket", weight)]).groupBy("dimension", "bucket").agg(F.sum(weight).alias("exposure"), F.count("*").alias("holdings"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("exposure").desc(), F.col("bucket").asc_nulls_last()))
    return sums.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def pending_catalysts(catalysts: DataFrame, theses: DataFrame, limit: int = 20) -> DataFrame:
    """Pending catalysts with the company of their thesis, the next ones first; those without a time come last, new before old."""
    both = catalysts.filter("state = 'pending'").join(theses.select(F.col("id").alias("thesis_id"), "theme_id", "company"), "thesis_id")
    return both.orderBy(F.col("expected_at").asc_nulls_last(), F.col("created_at").desc(), "id").limit(limit)


def review_schedule(theses: DataFrame, themes: DataFrame, limit: int = 20) -> DataFrame:
    """``kind, id, title, review_at, status, created_at`` of theses and themes with a date of review, the next ones first."""
    of = lambda df, kind, title: df.filter("review_at is not null").select(F.lit(kind).alias("kind"), "id", F.col(title).alias("title"), "review_at", "status", "created_at")
    return of(theses, "thesis", "claim").unionByName(of(themes, "theme", "name")).orderBy("review_at", F.col("created_at").desc(), "kind", "id").limit(limit)


def cohorts(cases: DataFrame, snapshots: DataFrame, since: Column) -> DataFrame:
    """A row for each month in which cases began from ``since`` on: how many got how far, how fast, and where they are now.

    ``cases``: ``case_id, first_seen_at, last_evidence_at, state``; ``snapshots``: ``case_id, at, state``.  A milestone is
    reached at the first snapshot in one of its states; days are never below 0, those of survival whole ones; medians are null where no case
    got there.  Rates of a step are null where none reached the step before.
    """
    first = lambda states: F.min(F.when(F.col("state").isin(*states), F.col("at")))
    ever = lambda states: F.coalesce(F.bool_or(F.col("state").isin(*states)), F.lit(False))
    reached = snapshots.groupBy("case_id").agg(*[first(s).alias(f"first_{name}") for name, s in REACHED.items()], *[ever(s).alias(f"ever_{name}") for name, s in EVER.items()])
    each = cases.filter(F.col("first_seen_at") >= since).join(reached, "case_id", "left")
    days = lambda c: F.greatest(F.lit(0.0), (F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("first_seen_at").cast("timestamp"))) / 86_400_000_000)
    was = lambda name: F.coalesce(F.col(f"ever_{name}"), F.lit(False))
    gone = F.col("state") == "archived"
    out = each.groupBy(F.date_format("first_seen_at", "yyyy-MM").alias("cohort")).agg(
        F.count("*").alias("case_count"), F.count("first_forming").alias("formed_count"), *[F.count_if(was(n)).alias(f"{n}_count") for n in EVER], F.count_if(gone).alias("archived_count"),
        F.count_if(gone & ~was("corroborated")).alias("weak_case_archived_count"), F.count_if(gone & was("research_ready")).alias("research_ready_then_archived_count"),
        F.median(F.floor(days("last_evidence_at"))).alias("median_survival_days"), *[F.median(F.when(F.col(f"first_{n}").isNotNull(), days(f"first_{n}"))).alias(f"median_days_to_{n}") for n in REACHED], *[F.count_if(F.col("state") == s).alias(f"now_{s}") for s in STATES],
    )
    part = lambda a, b: ratio(f"{a}_count", b)
    rates = {
        "forming_to_corroborated_rate": part("corroborated", "formed_count"), "corroborated_to_research_ready_rate": part("research_ready", "corroborated_count"), "research_ready_rate": part("research_ready", "case_count"),
        "mature_rate": part("mature", "case_count"), "archived_rate": part("archived", "case_count"), "weak_case_archived_rate": part("weak_case_archived", "case_count"),
    }
    return out.withColumns(rates)


def valuation_coverage(analyses: DataFrame) -> DataFrame:
    """One row: how many analyses have which valuation.

    ``analyses``: ``dcf_status, per_share, enterprise_value, market_price, metric_price, pe, margin_of_safety``.  A status
    that isn't one of ``DCF`` follows from the values.  Ratios count beside a market price above 0 only, a margin of safety
    also needs a value per share above 0.
    """
    number = lambda c: F.when(is_finite(c), F.col(c))
    given = F.lower(F.coalesce("dcf_status", F.lit("")))
    status = F.when(given.isin(*DCF), given).when(number("per_share").isNotNull(), DCF[0]).when(number("enterprise_value").isNotNull(), DCF[1]).otherwise(DCF[2])
    priced = F.coalesce(F.coalesce(number("market_price"), number("metric_price")) > 0, F.lit(False))
    safe = priced & number("margin_of_safety").isNotNull() & F.coalesce(number("per_share") > 0, F.lit(False))
    return analyses.agg(*[F.count_if(status == s).alias(f"dcf_{s}_count") for s in DCF], F.count_if(priced).alias("market_price_count"), F.count_if(priced & number("pe").isNotNull()).alias("pe_ratio_count"), F.count_if(safe).alias("margin_of_safety_count"))
