"""Evidence, scenarios and ranked opportunities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.numeric import clamp, ratio

#: Shares of the confidence blend, and how much contradiction damps it; fixed values.
CONFIDENCE = {"support": 0.30, "quality": 0.20, "diversity": 0.15, "freshness": 0.15, "entailment": 0.20}
DAMPING = 0.75
#: Least value of each component of an opportunity (downside: the greatest), and its share; fixed values.
GATES = {"evidence": 0.30, "confidence": 0.40, "neglect": 0.20, "catalyst": 0.25, "liquidity": 0.20, "downside": 0.50}
SHARES = {"evidence": 0.30, "confidence": 0.25, "neglect": 0.15, "catalyst": 0.10, "liquidity": 0.10, "downside": 0.10}
#: Groups and kinds of evidence that make it fully diverse.
FULL_GROUPS, FULL_KINDS = 4, 3


def with_weight(evidence: DataFrame) -> DataFrame:
    """Adds ``weight``: the product of the scores, 0.5 where one is missing, and of the effective weight, 1 if missing."""
    score = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    return evidence.withColumn("weight", score("quality_score") * score("entailment_score") * score("freshness_score") * F.coalesce("effective_weight", F.lit(1.0)))


def distinct_evidence(evidence: DataFrame, key: str = "thesis_id") -> DataFrame:
    """Of rows with one fingerprint the one of greatest weight, then of least id; without a fingerprint, all."""
    print_ = F.coalesce(F.concat(F.lit("f:"), "fingerprint"), F.concat(F.lit("i:"), F.col("evidence_id").cast("string")))
    w = Window.partitionBy(key, "__print").orderBy(F.desc("weight"), "evidence_id")
    return with_weight(evidence).withColumn("__print", print_).withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__print")


def with_decay(evidence: DataFrame, key: str = "thesis_id", decay: float = 0.5) -> DataFrame:
    """Adds ``group_key`` and ``share``: the n-th evidence of a group of one origin counts ``decay ** (n - 1)``."""
    id_ = F.col("evidence_id").cast("string")
    group = F.coalesce(F.concat(F.lit("independence:"), "independence_key"), F.concat(F.lit("family:"), "source_family"), F.concat(F.lit("unique:"), id_))
    w = Window.partitionBy(key, "group_key").orderBy(F.desc("weight"), "evidence_id")
    return evidence.withColumn("group_key", group).withColumn("share", F.pow(F.lit(decay), F.row_number().over(w) - 1))


def is_auditable() -> Column:
    """Support and contradiction count with positive scores for quality and entailment and an excerpt that isn't blank."""
    scored = (F.col("quality_score") > 0) & (F.col("entailment_score") > 0)
    return F.coalesce(F.col("relationship").isin("supports", "contradicts") & scored & (F.trim(F.coalesce("excerpt", F.lit(""))) != ""), F.lit(False))


def assess_evidence(evidence: DataFrame, key: str = "thesis_id") -> DataFrame:
    """One row for each thesis: masses for and against, diversity and confidence; null confidence without evidence that counts."""
    once = distinct_evidence(evidence, key)
    counted = with_decay(once.filter(is_auditable()), key)
    mass = lambda kind: F.coalesce(F.sum(F.when(F.col("relationship") == kind, F.col("weight") * F.col("share"))), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.5))
    g = counted.groupBy(key).agg(
        F.count_if(F.col("relationship") == "supports").alias("n_support"), F.count_if(F.col("relationship") == "contradicts").alias("n_contradict"),
        (1 - F.exp(-mass("supports"))).alias("support"), (1 - F.exp(-mass("contradicts"))).alias("contradiction"), F.countDistinct("group_key").alias("groups"),
        F.countDistinct("evidence_type").alias("kinds"), *[mean(f"{c}_score").alias(c) for c in ("quality", "freshness", "entailment")],
    )
    part = lambda c, full: F.least(F.lit(1.0), F.col(c) / F.lit(float(full)))
    g = g.withColumn("diversity", clamp(0.5 * part("groups", FULL_GROUPS) + 0.5 * part("kinds", FULL_KINDS)))
    blend = sum((share * F.col(c) for c, share in CONFIDENCE.items()), F.lit(0.0))
    g = g.withColumn("confidence", clamp(blend * (1 - DAMPING * F.col("contradiction"))))
    total = once.groupBy(key).agg(F.count("*").alias("n_unique"))
    out = total.join(g, key, "left")
    return out.select(key, "n_unique", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_support", "n_contradict", "groups")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("support", "contradiction", "diversity")], "confidence")


def neglect(attention: Column, crowding: Column) -> Column:
    """Mean of what is missing of attention and of crowding, over the known ones; null without either."""
    known = F.when(attention.isNotNull(), 1).otherwise(0) + F.when(crowding.isNotNull(), 1).otherwise(0)
    return F.when(known > 0, clamp((F.coalesce(1 - attention, F.lit(0.0)) + F.coalesce(1 - crowding, F.lit(0.0))) / known))


def catalyst_readiness(state: Column, days_until: Column, horizon_days: int = 90) -> Column:
    """1 if confirmed, 0 if missed or expired; pending ones by how near they are, 0.5 without a date."""
    pending = F.when(days_until.isNull(), 0.5).otherwise(clamp(1 - days_until / horizon_days))
    return F.when(state == "confirmed", 1.0).when(state == "pending", pending).otherwise(0.0)


def scenario_values(scenarios: DataFrame, key: str = "thesis_id", cost: float = 0.0) -> DataFrame:
    """Expected value and shortfall of each thesis's scenarios, whether probabilities sum to one, and the best label."""
    part = F.col("probability") * F.col("expected_return")
    g = scenarios.groupBy(key).agg(
        (F.coalesce(F.sum(part), F.lit(0.0)) - cost).alias("expected_value"), F.coalesce(-F.sum(F.when(part < 0, part)), F.lit(0.0)).alias("expected_shortfall"), F.coalesce(F.sum("probability"), F.lit(0.0)).alias("probability_sum"),
        F.count("*").alias("scenarios"), F.count("probability").alias("priced"), F.min_by("label", F.struct(-part, "label")).alias("best"),
    )
    return g.withColumn("sums_to_one", F.abs(F.col("probability_sum") - 1) < 1e-9)


def opportunity(components: dict[str, Column]) -> Column:
    """``{score, blocked_by}``: 0 with the names of failed gates, else the blend of the components."""
    ok = {c: F.coalesce(x <= GATES[c] if c == "downside" else x >= GATES[c], F.lit(False)) for c, x in components.items()}
    blocked = F.concat_ws(",", *[F.when(~ok[c], c) for c in GATES])
    blend = sum((SHARES[c] * (1 - x if c == "downside" else x) for c, x in components.items()), F.lit(0.0))
    return F.struct(F.when(blocked == "", blend).otherwise(0.0).alias("score"), blocked.alias("blocked_by"))


def subject_key(symbol: str = "symbol", company: str = "company") -> Column:
    """One key for a thesis's subject: its symbol, or its company where the symbol is blank; null without either."""
    s, c = (F.lower(F.trim(F.coalesce(F.col(x), F.lit("")))) for x in (symbol, company))
    return F.when(s != "", F.concat(F.lit("s:"), s)).when(c != "", F.concat(F.lit("c:"), c))


def opposed(theses: DataFrame) -> DataFrame:
    """``thesis_id``s that face an eligible thesis on the same subject and horizon in the other direction.

    ``theses``: ``thesis_id, subject, horizon, direction, eligible``.  Subject, horizon and the direction looked for are
    equal on both sides, so this is an equi-join.
    """
    other = theses.filter("eligible").select("subject", "horizon", F.when(F.col("direction") == "long", "short").when(F.col("direction") == "short", "long").alias("direction")).distinct()
    return theses.join(other, ["subject", "horizon", "direction"], "left_semi").select("thesis_id")


#: Gates that a thesis passes by itself; the last one, opposition, takes another thesis.
OWN_GATES = ("status_ok", "score_ok", "scenarios_ok", "risks_ok", "evidence_ok", "falsification_ok", "actionability_ok")


def order() -> list[Column]:
    """Best theses first: by whether there is an opportunity, eligibility, then six measures; unknown ones last."""
    measures = ("expected_value", "opportunity", "confidence", "catalyst", "neglect", "last_evaluated")
    return [(F.col("opportunity") > 0).desc_nulls_last(), F.col("eligible").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in measures], F.asc("thesis_id")]


def rank(theses: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first thesis of each subject, direction and horizon, by the given order; the best ``limit`` with their ``place``."""
    first = Window.partitionBy("subject", "direction", "horizon").orderBy(*order)
    out = theses.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank").orderBy(*order).limit(limit)
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def calibration(forecasts: DataFrame) -> DataFrame:
    """``bin, n, mean_probability, hit_rate, brier``: five bins of the scenarios of complete, resolved sets.

    ``forecasts``: ``set_id, name, probability, target_value, actual_value``.  A set counts with three scenarios of
    different names whose probabilities sum to one; the scenario nearest to the actual value came true.
    """
    sets = forecasts.groupBy("set_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.sum("probability").alias("p"))
    whole = sets.filter((F.col("n") == 3) & (F.col("names") == 3) & (F.abs(F.col("p") - 1) < 1e-9)).select("set_id")
    w = Window.partitionBy("set_id").orderBy(F.abs(F.col("target_value") - F.col("actual_value")), "name")
    hit = F.when(F.row_number().over(w) == 1, 1.0).otherwise(0.0)
    scored = forecasts.join(whole, "set_id", "left_semi").withColumn("hit", hit)
    gap = F.col("probability") - F.col("hit")
    bin_ = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("probability") * 5))).cast("int").alias("bin")
    return scored.groupBy(bin_).agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg("hit").alias("hit_rate"), F.avg(gap * gap).alias("brier"))


def holds(op: Column, value: Column, low: Column, high: Column) -> Column:
    """Whether a falsification condition holds: above and below leave the bound out, at_least and at_most include it."""
    return (
        F.when(op == "above", value > low).when(op == "at_least", value >= low).when(op == "below", value < low).when(op == "at_most", value <= low)
        .when(op == "between", value.between(low, high)).when(op == "outside", ~value.between(low, high))
    )


def neglected_share(part: Column, whole: Column) -> Column:
    return 1 - F.coalesce(ratio(part, whole), F.lit(0.0))
