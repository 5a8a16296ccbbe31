"""Theses, macro, options, companies and data quality over stand-ins built from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions.numeric import percent_change, ratio
from quaylight.operators import companies, keys, macro, options, quality, theses
from quaylight.plans.base import CHAIN_SQL, SERIES_SQL, chain, query, series, table

EVIDENCE_SQL = """ev AS (SELECT o_custkey AS thesis_id, o_orderkey AS evidence_id, o_orderpriority AS evidence_type,
  CASE o_orderkey % 5 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'context' ELSE 'supports' END AS relationship,
  CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 10) / 10.0 END AS quality_score, (o_orderkey % 7) / 7.0 AS entailment_score, (o_orderkey % 13) / 13.0 AS freshness_score,
  CASE WHEN o_orderkey % 17 <> 0 THEN 1.5 END AS effective_weight, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || (o_orderkey % 40) END AS fingerprint,
  CASE WHEN o_orderkey % 4 = 0 THEN 'k' || (o_orderkey % 3) END AS independence_key, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus END AS source_family,
  CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'x' END AS excerpt FROM orders),
w AS (SELECT *, coalesce(quality_score, 0.5) * coalesce(entailment_score, 0.5) * coalesce(freshness_score, 0.5) * coalesce(effective_weight, 1) AS weight FROM ev),
once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY thesis_id, coalesce('f:' || fingerprint, 'i:' || evidence_id) ORDER BY weight DESC, evidence_id) AS rn FROM w) WHERE rn = 1),
grouped AS (SELECT *, coalesce('independence:' || independence_key, 'family:' || source_family, 'unique:' || evidence_id) AS group_key FROM once)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tag = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("thesis_id"), k.alias("evidence_id"), F.col("o_orderpriority").alias("evidence_type"),
        F.when(k % 5 == 0, "contradicts").when(k % 5 == 1, "context").otherwise("supports").alias("relationship"),
        F.when(k % 11 != 0, (k % 10) / 10.0).alias("quality_score"), ((k % 7) / 7.0).alias("entailment_score"), ((k % 13) / 13.0).alias("freshness_score"),
        F.when(k % 17 != 0, 1.5).alias("effective_weight"), F.when(k % 3 == 0, tag("f", 40)).alias("fingerprint"), F.when(k % 4 == 0, tag("k", 3)).alias("independence_key"),
        F.when(k % 4 == 1, F.col("o_orderstatus")).alias("source_family"), F.when(k % 9 == 0, " ").otherwise("x").alias("excerpt"),
    )


@query(f"WITH {EVIDENCE_SQL} SELECT thesis_id, evidence_id, round(weight, 8) AS weight FROM once")
def ths01_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theses.distinct_evidence(evidence(spark, sf_dir)).select("thesis_id", "evidence_id", F.round("weight", 8).alias("weight"))


@query(f"""WITH {EVIDENCE_SQL}, d AS (SELECT *, pow(0.5, row_number() OVER (PARTITION BY thesis_id, group_key ORDER BY weight DESC, evidence_id) - 1) AS share FROM grouped)
SELECT thesis_id, group_key, count(*) AS members, round(sum(weight * share), 8) AS total_weight FROM d GROUP BY ALL""")
def ths02_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = theses.with_decay(theses.distinct_evidence(evidence(spark, sf_dir)))
    return d.groupBy("thesis_id", "group_key").agg(F.count("*").alias("members"), F.round(F.sum(F.col("weight") * F.col("share")), 8).alias("total_weight"))


@query(f"""WITH {EVIDENCE_SQL}, a AS (SELECT * FROM grouped WHERE relationship IN ('supports', 'contradicts') AND quality_score > 0 AND entailment_score > 0 AND trim(excerpt) <> ''),
d AS (SELECT *, pow(0.5, row_number() OVER (PARTITION BY thesis_id, group_key ORDER BY weight DESC, evidence_id) - 1) AS share FROM a),
g AS (SELECT thesis_id, count(*) FILTER (relationship = 'supports') AS n_support, count(*) FILTER (relationship = 'contradicts') AS n_contradict,
  1 - exp(-coalesce(sum(weight * share) FILTER (relationship = 'supports'), 0)) AS support, 1 - exp(-coalesce(sum(weight * share) FILTER (relationship = 'contradicts'), 0)) AS contradiction,
  count(DISTINCT group_key) AS groups, 0.5 * least(1, count(DISTINCT group_key) / 4) + 0.5 * least(1, count(DISTINCT evidence_type) / 3) AS diversity,
  avg(quality_score) AS q, coalesce(avg(freshness_score), 0.5) AS f, coalesce(avg(entailment_score), 0.5) AS e FROM d GROUP BY thesis_id),
n AS (SELECT thesis_id, count(*) AS n_unique FROM once GROUP BY thesis_id)
SELECT thesis_id, n_unique, coalesce(n_support, 0) AS n_support, coalesce(n_contradict, 0) AS n_contradict, coalesce(groups, 0) AS groups, round(coalesce(support, 0), 8) AS support,
  round(coalesce(contradiction, 0), 8) AS contradiction, round(coalesce(diversity, 0), 8) AS diversity,
  round((0.3 * support + 0.2 * q + 0.15 * diversity + 0.15 * f + 0.2 * e) * (1 - 0.75 * contradiction), 8) AS confidence FROM n LEFT JOIN g USING (thesis_id)""")
def ths03_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = theses.assess_evidence(evidence(spark, sf_dir))
    return out.withColumns({c: F.round(c, 8) for c in ("support", "contradiction", "diversity", "confidence")})


@query("""WITH t AS (SELECT c_custkey AS thesis_id, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 10) / 10.0 END AS a, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 7) / 7.0 END AS c FROM customer)
SELECT thesis_id, round(CASE WHEN a IS NULL AND c IS NULL THEN NULL WHEN a IS NULL THEN 1 - c WHEN c IS NULL THEN 1 - a ELSE (2 - a - c) / 2 END, 8) AS neglect FROM t""")
def ths04_neglect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    n = theses.neglect(F.when(k % 3 != 0, (k % 10) / 10.0), F.when(k % 4 != 0, (k % 7) / 7.0))
    return table(spark, sf_dir, "customer").select(k.alias("thesis_id"), F.round(n, 8).alias("neglect"))


@query("""WITH c AS (SELECT o_custkey AS thesis_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'missed' END AS state,
  CASE WHEN o_orderkey % 6 <> 0 THEN date_diff('day', DATE '1996-06-01', o_orderdate::DATE) END AS days FROM orders)
SELECT thesis_id, round(avg(CASE state WHEN 'confirmed' THEN 1.0 WHEN 'missed' THEN 0.0 ELSE CASE WHEN days IS NULL THEN 0.5 ELSE least(1, greatest(0, 1 - days / 90)) END END), 8) AS readiness, count(*) AS catalysts FROM c GROUP BY thesis_id""")
def ths05_catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    state = F.when(s == "O", "pending").when(s == "F", "confirmed").otherwise("missed")
    days = F.when(F.col("o_orderkey") % 6 != 0, F.datediff(F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("thesis_id")).agg(F.round(F.avg(theses.catalyst_readiness(state, days)), 8).alias("readiness"), F.count("*").alias("catalysts"))


@query("""WITH s AS (SELECT l_orderkey AS thesis_id, l_linenumber AS label, CASE WHEN l_linenumber <> 4 THEN l_quantity / 100 END AS p, l_discount - 0.05 AS r FROM lineitem)
SELECT thesis_id, round(coalesce(sum(p * r), 0) - 0.01, 8) AS expected_value, round(coalesce(-sum(p * r) FILTER (p * r < 0), 0), 8) AS expected_shortfall, count(*) AS scenarios, count(p) AS priced,
  coalesce(abs(sum(p) - 1) < 1e-9, false) AS sums_to_one FROM s GROUP BY thesis_id""")
def ths06_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thesis_id"), F.col("l_linenumber").alias("label"), F.when(F.col("l_linenumber") != 4, F.col("l_quantity") / 100).alias("probability"), (F.col("l_discount") - 0.05).alias("expected_return"))
    out = theses.scenario_values(s, cost=0.01)
    return out.select("thesis_id", F.round("expected_value", 8).alias("expected_value"), F.round("expected_shortfall", 8).alias("expected_shortfall"), "scenarios", "priced", "sums_to_one")


_COMPONENT = {"evidence": 10, "confidence": 9, "neglect": 8, "catalyst": 7, "liquidity": 6, "downside": 11}
_GATE_SQL = {c: f"NOT coalesce({c} {'<=' if c == 'downside' else '>='} {x}, false)" for c, x in theses.GATES.items()}


@query(f"""WITH t AS (SELECT c_custkey AS thesis_id, {", ".join(f"CASE WHEN c_custkey % {20 + n} <> 0 THEN (c_custkey % {n}) / {n}.0 END AS {c}" for c, n in _COMPONENT.items())} FROM customer),
b AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {x} THEN '{c}' END" for c, x in _GATE_SQL.items())}) AS blocked_by FROM t)
SELECT thesis_id, blocked_by, CASE WHEN blocked_by = '' THEN round({" + ".join(f"{s} * {'(1 - downside)' if c == 'downside' else c}" for c, s in theses.SHARES.items())}, 8) ELSE 0.0 END AS score FROM b""")
def ths07_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    o = theses.opportunity({c: F.when(k % (20 + n) != 0, (k % n) / float(n)) for c, n in _COMPONENT.items()})
    return table(spark, sf_dir, "customer").select(k.alias("thesis_id"), o.alias("o")).select("thesis_id", "o.blocked_by", F.round("o.score", 8).alias("score"))


THESES_SQL = """t AS (SELECT c_custkey AS thesis_id, CASE WHEN c_custkey % 5 = 0 THEN 'c:' || lower(c_name) ELSE 's:s' || (c_custkey // 3) END AS subject, CASE WHEN c_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
  CASE WHEN c_custkey % 7 < 5 THEN 'near' ELSE 'far' END AS horizon, CASE WHEN c_custkey % 13 <> 0 THEN round(c_acctbal / 10) END AS expected_value, CASE WHEN c_custkey % 37 <> 0 THEN round(c_acctbal / 100) END AS opportunity,
  CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey % 17) / 17.0 END AS confidence, (c_custkey % 7) / 7.0 AS catalyst, CASE WHEN c_custkey % 23 <> 0 THEN (c_custkey % 11) / 11.0 END AS neglect,
  (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_evaluated, c_mktsegment <> 'MACHINERY' AS status_ok, coalesce(round(c_acctbal / 100) > 0 AND c_custkey % 37 <> 0, false) AS score_ok, c_custkey % 6 <> 0 AS actionability_ok FROM customer),
g AS (SELECT t.*, EXISTS (SELECT 1 FROM orders WHERE o_custkey = thesis_id AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') HAVING count(DISTINCT o_orderpriority) = 3) AS scenarios_ok,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey = thesis_id AND o_orderpriority = '4-NOT SPECIFIED') AS risks_ok,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey = thesis_id AND o_orderkey % 9 <> 0 AND o_orderkey % 10 > 2) AS evidence_ok,
  coalesce((SELECT arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = thesis_id) <> 'F', false) AS falsification_ok FROM t),
e AS (SELECT *, status_ok AND score_ok AND scenarios_ok AND risks_ok AND evidence_ok AND falsification_ok AND actionability_ok AS base FROM g),
o AS (SELECT *, EXISTS (SELECT 1 FROM e b WHERE b.thesis_id <> e.thesis_id AND b.base AND b.horizon = e.horizon AND b.subject = e.subject AND b.direction <> e.direction) AS opposition_ok FROM e)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theses with their gates; all that orders say of a thesis comes from one aggregate."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(
        k.alias("thesis_id"), F.when(k % 5 != 0, F.concat(F.lit("S"), F.floor(k / 3).cast("string"))).alias("symbol"), F.col("c_name").alias("company"), F.when(k % 2 == 0, "long").otherwise("short").alias("direction"),
        F.when(k % 7 < 5, "near").otherwise("far").alias("horizon"), F.when(k % 13 != 0, F.round(F.col("c_acctbal") / 10)).alias("expected_value"), F.when(k % 37 != 0, F.round(F.col("c_acctbal") / 100)).alias("opportunity"),
        F.when(k % 19 != 0, (k % 17) / 17.0).alias("confidence"), ((k % 7) / 7.0).alias("catalyst"), F.when(k % 23 != 0, (k % 11) / 11.0).alias("neglect"), (F.col("c_mktsegment") != "MACHINERY").alias("status_ok"), (k % 6 != 0).alias("actionability_ok"),
    ).withColumns({"subject": theses.subject_key(), "score_ok": F.col("opportunity") > 0})
    p = F.col("o_orderpriority")
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("thesis_id")).agg(
        (F.countDistinct(F.when(p.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), p)) == 3).alias("scenarios_ok"), F.bool_or(p == "4-NOT SPECIFIED").alias("risks_ok"), F.max("o_orderdate").alias("last_evaluated"), F.bool_or((F.col("o_orderkey") % 9 != 0) & (F.col("o_orderkey") % 10 > 2)).alias("evidence_ok"),
        (F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")) != "F").alias("falsification_ok"),
    )
    t = t.join(facts, "thesis_id", "left").withColumns({g: F.coalesce(g, F.lit(False)) for g in theses.OWN_GATES})
    t = t.withColumn("eligible", reduce(Column.__and__, [F.col(g) for g in theses.OWN_GATES]))
    facing = theses.opposed(t).withColumn("opposition_ok", F.lit(True))
    return t.join(facing, "thesis_id", "left").withColumn("opposition_ok", F.coalesce("opposition_ok", F.lit(False)))


@query(f"WITH {THESES_SQL} SELECT thesis_id, status_ok, score_ok, scenarios_ok, risks_ok, evidence_ok, falsification_ok, actionability_ok, opposition_ok, base AND opposition_ok AS eligible FROM o")
def ths08_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gated(spark, sf_dir)
    return g.select("thesis_id", *theses.OWN_GATES, "opposition_ok", (F.col("eligible") & F.col("opposition_ok")).alias("eligible"))


_RANK_SQL = "(opportunity > 0) DESC NULLS LAST, (base AND opposition_ok) DESC NULLS LAST, expected_value DESC NULLS LAST, opportunity DESC NULLS LAST, confidence DESC NULLS LAST, catalyst DESC NULLS LAST, neglect DESC NULLS LAST, last_evaluated DESC NULLS LAST, thesis_id"


@query(f"""WITH {THESES_SQL}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, direction, horizon ORDER BY {_RANK_SQL}) AS rn FROM o) WHERE rn = 1)
SELECT thesis_id, subject, direction, horizon, row_number() OVER (ORDER BY {_RANK_SQL}) AS place FROM c ORDER BY place LIMIT 50""")
def ths08_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = gated(spark, sf_dir).withColumn("eligible", F.col("eligible") & F.col("opposition_ok"))
    return theses.rank(t, theses.order(), 50).select("thesis_id", "subject", "direction", "horizon", "place")


@query("""SELECT c_mktsegment AS group_name, count(*) AS theses, count(*) FILTER (c_acctbal > 5000) AS strong, round(avg(c_acctbal), 6) AS mean_value, max(c_acctbal) AS best FROM customer GROUP BY 1""")
def ths09_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("group_name"))
    return g.agg(F.count("*").alias("theses"), F.count_if(F.col("c_acctbal") > 5000).alias("strong"), F.round(F.avg("c_acctbal"), 6).alias("mean_value"), F.max("c_acctbal").alias("best"))


@query("""WITH f AS (SELECT l_orderkey AS set_id, l_linenumber::VARCHAR AS name, CASE l_linenumber WHEN 1 THEN 0.2 WHEN 2 THEN 0.5 ELSE 0.3 END AS p, l_extendedprice AS t, l_orderkey * 1.0 AS a FROM lineitem),
s AS (SELECT set_id FROM f GROUP BY set_id HAVING count(*) = 3 AND count(DISTINCT name) = 3 AND abs(sum(p) - 1) < 1e-9),
r AS (SELECT p, CASE WHEN row_number() OVER (PARTITION BY set_id ORDER BY abs(t - a), name) = 1 THEN 1.0 ELSE 0.0 END AS hit FROM f JOIN s USING (set_id))
SELECT least(4, greatest(0, floor(p * 5)))::INT AS bin, count(*) AS n, round(avg(p), 8) AS mean_probability, round(avg(hit), 8) AS hit_rate, round(avg((p - hit) * (p - hit)), 8) AS brier FROM r GROUP BY 1""")
def ths10_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), n.cast("string").alias("name"), F.when(n == 1, 0.2).when(n == 2, 0.5).otherwise(0.3).alias("probability"), F.col("l_extendedprice").alias("target_value"), F.col("l_orderkey").cast("double").alias("actual_value"))
    out = theses.calibration(f)
    return out.withColumns({c: F.round(c, 8) for c in ("mean_probability", "hit_rate", "brier")})


@query("""WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice AS target, o_orderdate::DATE AS due FROM orders),
p AS (SELECT f.*, (SELECT arg_max(s.o_totalprice, (s.o_orderdate, s.o_orderkey)) FROM orders s WHERE s.o_custkey = f.o_custkey AND s.o_orderdate::DATE >= f.due - 7 AND s.o_orderdate::DATE <= f.due AND s.o_orderkey <> f.o_orderkey) AS actual FROM f)
SELECT CASE WHEN actual IS NULL THEN 'inconclusive' WHEN actual >= target THEN 'hit' ELSE 'miss' END AS status, count(*) AS n FROM p GROUP BY 1""")
def ths11_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("target"), F.to_date("o_orderdate").alias("due"), "o_orderdate")
    week = F.floor(F.datediff("due", F.lit("1970-01-01")) / 8)
    asks = o.select("o_orderkey", "o_custkey", "target", "due", F.explode(F.array(week - 1, week)).alias("week"))
    seen = o.select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("target").alias("price"), F.col("due").alias("day"), F.col("o_orderdate").alias("at"), week.alias("week"))
    near = asks.join(seen, ["o_custkey", "week"]).filter("day <= due AND day >= date_sub(due, 7) AND k <> o_orderkey")
    last = near.groupBy("o_orderkey").agg(F.max_by("price", F.struct("at", "k")).alias("actual"))
    status = F.when(F.col("actual").isNull(), "inconclusive").when(F.col("actual") >= F.col("target"), "hit").otherwise("miss")
    return o.join(last, "o_orderkey", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS thesis_id, round(least(1, count(DISTINCT o_orderpriority || o_orderstatus) / 10), 8) AS attention FROM orders GROUP BY 1""")
def ths12_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct(F.concat("o_orderpriority", "o_orderstatus")).alias("n"))
    return one.select(F.col("o_custkey").alias("thesis_id"), F.round(F.least(F.lit(1.0), F.col("n") / 10), 8).alias("attention"))


@query("""WITH t AS (SELECT *, sha256(concat_ws('|', lower(trim(c_mktsegment)), c_nationkey::VARCHAR)) AS k FROM customer)
SELECT k AS thesis_key, min(c_custkey) AS thesis_id, count(*) AS merged, max(c_acctbal) AS best FROM t GROUP BY k""")
def ths13_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat_ws("|", F.lower(F.trim("c_mktsegment")), F.col("c_nationkey").cast("string")), 256)
    return table(spark, sf_dir, "customer").groupBy(key.alias("thesis_key")).agg(F.min("c_custkey").alias("thesis_id"), F.count("*").alias("merged"), F.max("c_acctbal").alias("best"))


@query("""WITH c AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'above' WHEN 1 THEN 'at_least' WHEN 2 THEN 'below' WHEN 3 THEN 'at_most' WHEN 4 THEN 'between' ELSE 'outside' END AS op FROM orders)
SELECT op, count(*) AS n, count(*) FILTER (CASE op WHEN 'above' THEN o_totalprice > 100000 WHEN 'at_least' THEN o_totalprice >= 100000 WHEN 'below' THEN o_totalprice < 100000 WHEN 'at_most' THEN o_totalprice <= 100000
  WHEN 'between' THEN o_totalprice BETWEEN 100000 AND 200000 ELSE NOT (o_totalprice BETWEEN 100000 AND 200000) END) AS holds FROM c GROUP BY op""")
def ths14_falsification(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    op = F.when(k == 0, "above").when(k == 1, "at_least").when(k == 2, "below").when(k == 3, "at_most").when(k == 4, "between").otherwise("outside")
    c = table(spark, sf_dir, "orders").withColumn("op", op)
    return c.groupBy("op").agg(F.count("*").alias("n"), F.count_if(theses.holds(F.col("op"), F.col("o_totalprice"), F.lit(100000.0), F.lit(200000.0))).alias("holds"))


@query("""WITH m AS (SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS member, count(*) AS members, round(0.5 * least(1, count(*) / 100) + 0.3 * max(c_acctbal) / 10000 + 0.2 * count(DISTINCT c_mktsegment) / 5, 8) AS score FROM customer GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY score DESC, c_nationkey) AS place FROM m""")
def ths15_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("member"), F.count("*").alias("members"),
        F.round(0.5 * F.least(F.lit(1.0), F.count("*") / 100) + 0.3 * F.max("c_acctbal") / 10000 + 0.2 * F.countDistinct("c_mktsegment") / 5, 8).alias("score"),
    )
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "c_nationkey")))


@query(f"""WITH {SERIES_SQL} SELECT series_id, observed_at, round(value / nullif(lag(value, 12) OVER (PARTITION BY series_id ORDER BY observed_at), 0) - 1, 8) AS yoy FROM series""")
def mac05_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.year_over_year(series(spark, sf_dir)).select("series_id", "observed_at", F.round("yoy", 8).alias("yoy"))


SIGNALS_SQL = SERIES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observed_at DESC) AS rn FROM series),
g AS (SELECT series_id, max(observed_at) AS observed_at, max(value) FILTER (rn = 1) AS latest, max(value) FILTER (rn = 4) AS reference, max(value) FILTER (rn = 7) AS earlier FROM r WHERE rn <= 7 GROUP BY series_id),
d AS (SELECT *, CASE WHEN latest - reference > 2000 THEN 'higher' WHEN latest - reference < -2000 THEN 'lower' ELSE 'unchanged' END AS direction,
  CASE WHEN reference - earlier > 2000 THEN 'higher' WHEN reference - earlier < -2000 THEN 'lower' WHEN earlier IS NOT NULL THEN 'unchanged' END AS before FROM g),
signals AS (SELECT series_id, observed_at, latest, reference, round(latest - reference, 4) AS delta, direction, CASE WHEN before IS NULL THEN 'not_comparable' WHEN direction = 'unchanged' THEN CASE WHEN before = 'unchanged' THEN 'stable' ELSE 'stalled' END
  WHEN before = direction THEN 'persisting' WHEN before = 'unchanged' THEN 'emerging' ELSE 'reversal' END AS transition FROM d)"""


@query(f"WITH {SIGNALS_SQL} SELECT * FROM signals")
def mac04_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.trend_signals(series(spark, sf_dir), 3, 2000.0).withColumn("delta", F.round("delta", 4))


@query(f"""WITH {SIGNALS_SQL} SELECT CASE WHEN series_id < '3' THEN 'growth' ELSE 'inflation' END AS domain, CASE WHEN count(*) FILTER (direction = 'higher') > 0 AND count(*) FILTER (direction = 'lower') > 0 THEN 'conflicting'
  WHEN count(*) FILTER (direction = 'higher') > 0 THEN 'heating' WHEN count(*) FILTER (direction = 'lower') > 0 THEN 'cooling' ELSE 'stable' END AS state FROM signals GROUP BY 1""")
def mac07_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = macro.trend_signals(series(spark, sf_dir), 3, 2000.0).withColumn("domain", F.when(F.col("series_id") < "3", "growth").otherwise("inflation"))
    return macro.consensus(s, "domain", "heating", "cooling")


_STATES = {"policy": ("easing", "tightening", "stable"), "growth": ("weakening", "strengthening", "stable"), "inflation": ("cooling", "heating", "stable"), "labor": ("weakening", "strengthening", "insufficient_data"), "financial": ("easing", "tightening", "insufficient_data")}


@query(f"""WITH d AS (SELECT o_orderkey, {", ".join(f"CASE (o_orderkey // {3 ** i}) % 3 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END AS {n}" for i, (n, (a, b, c)) in enumerate(_STATES.items()))} FROM orders)
SELECT o_orderkey, CASE WHEN {" + ".join(f"({n} <> 'insufficient_data')::INT" for n in _STATES)} < 3 THEN 'insufficient_coverage' WHEN policy = 'easing' AND financial = 'tightening' THEN 'policy_easing_with_market_stress'
  WHEN inflation = 'heating' AND financial = 'tightening' THEN 'inflationary_tightening' WHEN inflation = 'cooling' AND (labor = 'weakening' OR growth = 'weakening') THEN 'disinflationary_slowdown'
  WHEN inflation = 'cooling' AND growth IN ('stable', 'strengthening') AND labor IN ('stable', 'strengthening') AND financial IN ('stable', 'easing') THEN 'soft_landing_configuration' ELSE 'mixed_transition' END AS regime FROM d""")
def mac08_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = {n: F.when(F.floor(k / 3**i) % 3 == 0, a).when(F.floor(k / 3**i) % 3 == 1, b).otherwise(c) for i, (n, (a, b, c)) in enumerate(_STATES.items())}
    return table(spark, sf_dir, "orders").select(k, macro.composite(**d).alias("regime"))


VIX = ((12.0, "very low"), (16.0, "low"), (20.0, "moderate"), (25.0, "elevated"), (30.0, "high"))


@query("""SELECT p_partkey, CASE WHEN p_size < 12 THEN 'very low' WHEN p_size < 16 THEN 'low' WHEN p_size < 20 THEN 'moderate' WHEN p_size < 25 THEN 'elevated' WHEN p_size < 30 THEN 'high' ELSE 'very high' END AS level FROM part""")
def mac06_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", macro.bands(F.col("p_size"), VIX, "very high").alias("level"))


@query(f"""WITH {SERIES_SQL}, s AS (SELECT series_id, observed_at, value - (150000 + n) AS surprise FROM series)
SELECT series_id, observed_at, round(surprise, 4) AS surprise, CASE WHEN count(surprise) OVER w >= 2 THEN round((surprise - avg(surprise) OVER w) / nullif(stddev_pop(surprise) OVER w, 0), 5) END AS zscore
FROM s WINDOW w AS (PARTITION BY series_id ORDER BY observed_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def mac01_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series(spark, sf_dir).select("series_id", "observed_at", F.col("value").alias("actual"), (F.lit(150000) + F.col("n")).cast("double").alias("consensus"))
    return macro.surprises(r, "series_id", "observed_at").select("series_id", "observed_at", F.round("surprise", 4).alias("surprise"), F.round("zscore", 5).alias("zscore"))


@query("""SELECT o_orderkey, CASE WHEN h IS NULL THEN 'unknown' WHEN h >= 0.75 THEN 'high' WHEN h >= 0.4 THEN 'medium' ELSE 'low' END AS impact, greatest(a, b) AS stage FROM
(SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 100) / 100.0 END AS h, o_orderkey % 4 AS a, (o_orderkey // 4) % 4 AS b FROM orders)""")
def mac02_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = lambda i: F.element_at(F.array(*[F.lit(s) for s in macro.STAGES]), (i % 4 + 1).cast("int"))
    h = F.when(k % 9 != 0, (k % 100) / 100.0)
    impact = F.when(h.isNull(), "unknown").when(h >= 0.75, "high").when(h >= 0.4, "medium").otherwise("low")
    place = F.array_position(F.array(*[F.lit(s) for s in macro.STAGES]), macro.advance_stage(at(k), at(F.floor(k / 4)))) - 1
    return table(spark, sf_dir, "orders").select(k, impact.alias("impact"), place.alias("stage"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderdate::DATE = DATE '1996-06-04' THEN 'today' ELSE 'rest_of_week' END AS part FROM orders
WHERE o_orderdate::DATE >= DATE '1996-06-04' AND o_orderdate::DATE <= DATE '1996-06-07' AND o_orderpriority < '4'""")
def mac14_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ'1996-06-04' AND o_orderdate < TIMESTAMP_NTZ'1996-06-08' AND o_orderpriority < '4'")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", day.alias("day"), F.when(day == F.lit("1996-06-04").cast("date"), "today").otherwise("rest_of_week").alias("part"))


@query(f"""WITH {SERIES_SQL} SELECT series_id, observed_at, value FROM series WHERE observed_at > (SELECT max(observed_at) FROM series) - 365""")
def mac12_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").agg(F.trunc(F.to_date(F.max("o_orderdate")), "month").alias("last"))
    return series(spark, sf_dir).join(F.broadcast(last)).filter("observed_at > date_sub(last, 365)").select("series_id", "observed_at", "value")


def spot_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    return c.join(c.groupBy("symbol").agg(F.round(F.avg("strike"), 4).alias("spot")), "symbol")


ATM_SQL = CHAIN_SQL + """, c AS (SELECT chain.*, spot FROM chain JOIN spot USING (symbol)),
near AS (SELECT *, row_number() OVER (PARTITION BY symbol, dte ORDER BY abs(strike - spot), strike) AS rn FROM c WHERE iv IS NOT NULL),
sides AS (SELECT n.symbol, n.dte, n.strike, c.kind, avg(c.iv) AS iv FROM near n JOIN c ON c.symbol = n.symbol AND c.dte = n.dte AND c.strike = n.strike AND c.iv IS NOT NULL WHERE rn = 1 GROUP BY ALL),
atm AS (SELECT symbol, dte, strike, avg(iv) AS iv, count(*) AS sides FROM sides GROUP BY symbol, dte, strike)"""


@query(f"WITH {ATM_SQL} SELECT symbol, dte, strike, round(iv, 8) AS iv, sides FROM atm")
def opt03_atm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.at_the_money(spot_chain(spark, sf_dir)).withColumn("iv", F.round("iv", 8))


@query(f"""WITH {ATM_SQL}, p AS (SELECT c.symbol, c.dte, spot, a.iv, kind, coalesce((bid + ask) / 2, last) AS mid, c.strike = a.strike AS here FROM c JOIN atm a USING (symbol, dte))
SELECT symbol, dte, round(max(mid) FILTER (kind = 'call' AND here) + max(mid) FILTER (kind = 'put' AND here), 6) AS straddle,
  round(100 * (max(mid) FILTER (kind = 'call' AND here) + max(mid) FILTER (kind = 'put' AND here)) / max(spot), 6) AS implied_move_percent, CASE WHEN dte > 0 THEN round(max(iv) * sqrt(dte / 365) * 100, 6) END AS iv_move_percent FROM p GROUP BY symbol, dte""")
def opt04_straddle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spot_chain(spark, sf_dir)
    out = options.straddles(c, options.at_the_money(c))
    return out.withColumns({x: F.round(x, 6) for x in ("straddle", "implied_move_percent", "iv_move_percent")})


@query(f"""WITH {ATM_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol, dte ORDER BY abs(strike - spot * 0.95), strike, iv) AS rn FROM c WHERE kind = 'put' AND strike < spot AND iv IS NOT NULL)
SELECT p.symbol, p.dte, p.strike AS otm_strike, round(p.iv - a.iv, 8) AS skew FROM p JOIN atm a USING (symbol, dte) WHERE rn = 1""")
def opt05_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spot_chain(spark, sf_dir)
    return options.put_skew(c, options.at_the_money(c)).withColumn("skew", F.round("skew", 8))


@query(f"WITH {CHAIN_SQL} SELECT symbol, dte, count(*) AS contracts, sum(volume)::BIGINT AS volume, count(volume) = count(*) AS complete FROM chain GROUP BY symbol, dte")
def opt06_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.totals(chain(spark, sf_dir))


@query(f"""WITH {ATM_SQL} SELECT symbol, count(*) AS expiries, array_to_string(list(dte ORDER BY dte), ',') AS curve, round(arg_max(iv, dte) - arg_min(iv, dte), 8) AS slope FROM atm GROUP BY symbol HAVING count(*) >= 2""")
def opt07_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = options.at_the_money(spot_chain(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("expiries"), F.array_join(F.array_sort(F.collect_list("dte")).cast("array<string>"), ",").alias("curve"), F.round(F.max_by("iv", "dte") - F.min_by("iv", "dte"), 8).alias("slope"))
    return g.filter("expiries >= 2")


@query("""WITH s AS (SELECT l_suppkey % 50 AS symbol, date_trunc('month', l_shipdate)::DATE AS captured_at, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),
l AS (SELECT symbol, max(captured_at) AS last, arg_max(volume, captured_at) AS now FROM s GROUP BY symbol), g AS (SELECT symbol, count(*) AS n, count(*) FILTER (volume <= now) AS below FROM s JOIN l USING (symbol) WHERE captured_at < last GROUP BY symbol)
SELECT symbol, CASE WHEN n >= 5 THEN 'ok' ELSE 'insufficient_history' END AS state, CASE WHEN n >= 5 THEN round(below / n, 8) END AS percentile, CASE WHEN n >= 5 THEN below / n >= 0.95 END AS unusual FROM g""")
def opt08_unusual(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("symbol"), F.trunc(F.to_date("l_shipdate"), "month").alias("captured_at")).agg(F.sum("l_quantity").alias("volume"))
    return options.unusual(s, "volume").withColumn("percentile", F.round("percentile", 8))


@query(f"""WITH {CHAIN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC NULLS LAST, contract) AS rn FROM chain)
SELECT symbol, count(*) AS contracts, count(*) FILTER (kind = 'put') AS puts, array_to_string(list(contract ORDER BY rn) FILTER (rn <= 5), ',') AS busiest FROM r GROUP BY symbol""")
def opt09_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir).select("symbol", "contract", "kind", "volume")
    top = keys.top_n(c, ["symbol"], [F.col("volume").desc_nulls_last(), F.asc("contract")], 5, rank="rn")
    listed = top.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rn", "contract")))["contract"].cast("array<string>"), ",").alias("busiest"))
    return c.groupBy("symbol").agg(F.count("*").alias("contracts"), F.count_if(F.col("kind") == "put").alias("puts")).join(listed, "symbol")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'ABC' END AS root, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE + 7300 END AS expiration, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100000) / 1000.0 END AS strike FROM orders""")
def src10_occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    symbol = F.concat(F.when(k % 3 == 0, "abc").otherwise("ABC"), F.date_format(F.date_add(F.to_date("o_orderdate"), 7300), "yyMMdd"), F.when(k % 2 == 0, "C").otherwise("P"), F.lpad((k % 100000).cast("string"), 8, "0"))
    return table(spark, sf_dir, "orders").select(k, options.occ_symbol(symbol).alias("s")).select("o_orderkey", "s.root", "s.expiration", "s.kind", "s.strike")


FACTS_SQL = """f AS (SELECT l_suppkey AS company, year(l_shipdate) AS y, sum(l_extendedprice) AS revenue, sum(l_extendedprice * l_discount) AS cost, sum(l_quantity) AS units FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL),
r AS (SELECT *, lag(revenue) OVER (PARTITION BY company ORDER BY y) AS prior, row_number() OVER (PARTITION BY company ORDER BY y DESC) AS rn FROM f),
co AS (SELECT company, y, revenue, prior, 100 * (revenue - prior) / nullif(abs(prior), 0) AS growth, 100 * (revenue - cost) / nullif(revenue, 0) AS margin, revenue / nullif(units, 0) AS price, company % 5 AS industry, s_acctbal AS score, s_nationkey FROM r JOIN supplier ON s_suppkey = company WHERE rn = 1)"""


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate is not null")
    f = li.groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("y")).agg(F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cost"), F.sum("l_quantity").alias("units"))
    two = keys.top_n(f, ["company"], [F.desc("y")], 2, rank="rn")
    at = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    g = two.groupBy("company").agg(*[at(c, 1).alias(c) for c in ("y", "revenue", "cost", "units")], at("revenue", 2).alias("prior"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company"), F.col("s_acctbal").alias("score"), "s_nationkey")
    return g.join(s, "company").select("company", "y", "revenue", "prior", percent_change("revenue", "prior").alias("growth"), (100 * ratio(F.col("revenue") - F.col("cost"), "revenue")).alias("margin"), ratio("revenue", "units").alias("price"), (F.col("company") % 5).alias("industry"), "score", "s_nationkey")


@query(f"WITH {FACTS_SQL} SELECT company, y, round(revenue, 2) AS revenue, round(prior, 2) AS prior, round(growth, 5) AS growth, round(margin, 5) AS margin FROM co")
def inv01_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company_facts(spark, sf_dir).select("company", "y", *[F.round(c, d).alias(c) for c, d in (("revenue", 2), ("prior", 2), ("growth", 5), ("margin", 5))])


def _dcf_sql(d: str = "0.09", t: str = "0.02") -> str:
    years = " + ".join(f"pow((1 + g) / (1 + {d}), {k})" for k in range(1, 6))
    return f"cash * ({years} + pow((1 + g) / (1 + {d}), 5) * (1 + {t}) / ({d} - {t}))"


@query(f"""WITH {FACTS_SQL}, x AS (SELECT company, revenue * 0.1 AS cash, least(0.2, greatest(-0.2, growth / 100)) AS g FROM co)
SELECT company, round(CASE WHEN cash > 0 AND g IS NOT NULL THEN {_dcf_sql()} END, 1) AS value FROM x""")
def inv02_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.least(F.lit(0.2), F.greatest(F.lit(-0.2), F.col("growth") / 100))
    growth = F.when(F.col("growth").isNotNull(), g)
    return company_facts(spark, sf_dir).select("company", F.round(companies.dcf(F.col("revenue") * 0.1, growth, F.lit(0.09), F.lit(0.02)), 1).alias("value"))


@query(f"""WITH {FACTS_SQL}, x AS (SELECT company, revenue * 0.1 AS cash, 0.03 AS g FROM co), v AS (SELECT company, {_dcf_sql("(0.09 + d * 0.01)", "(0.02 + t * 0.005)")} AS v FROM x, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(t))
SELECT company, round(min(v), 1) AS low, round(max(v), 1) AS high, count(v) AS cells FROM v GROUP BY company""")
def inv03_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = company_facts(spark, sf_dir).select("company", (F.col("revenue") * 0.1).alias("cash"), F.lit(0.03).alias("growth"), F.lit(0.09).alias("discount"), F.lit(0.02).alias("terminal"))
    return companies.sensitivity(x, "company").select("company", F.round("low", 1).alias("low"), F.round("high", 1).alias("high"), "cells")


@query(f"WITH {FACTS_SQL} SELECT industry, count(*) AS companies, count(DISTINCT s_nationkey) AS nations, round(avg(score), 6) AS score, round(avg(growth), 4) AS growth, max(y) AS latest FROM co GROUP BY industry")
def inv14_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = company_facts(spark, sf_dir).groupBy("industry")
    return g.agg(F.count("*").alias("companies"), F.countDistinct("s_nationkey").alias("nations"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("growth"), 4).alias("growth"), F.max("y").alias("latest"))


@query("""SELECT n_name, count(s_suppkey) AS companies, round(coalesce(avg(s_acctbal), 0), 6) AS score FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def inv15_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    out = companies.regions(s, n.select("n_nationkey"), "n_nationkey", "s_acctbal")
    return n.join(out, "n_nationkey").select("n_name", "companies", F.round("score", 6).alias("score"))


@query(f"""WITH {FACTS_SQL.replace("rn = 1)", "true)")} SELECT industry, y, count(DISTINCT company) AS companies, round(avg(growth), 4) AS growth, round(avg(margin), 4) AS margin FROM co GROUP BY ALL""")
def inv16_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate is not null")
    f = li.groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("y")).agg(F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("cost"))
    f = f.withColumn("prior", F.lag("revenue").over(Window.partitionBy("company").orderBy("y"))).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company")), "company", "left_semi")
    g = f.groupBy((F.col("company") % 5).alias("industry"), "y")
    return g.agg(F.countDistinct("company").alias("companies"), F.round(F.avg(percent_change("revenue", "prior")), 4).alias("growth"), F.round(F.avg(100 * ratio(F.col("revenue") - F.col("cost"), "revenue")), 4).alias("margin"))


PEER_METRICS = {"growth": 10.0, "margin": 10.0, "price": 100.0}
PEERS_SQL = FACTS_SQL + """, m AS (SELECT company, industry, growth, margin, price FROM co),
d AS (SELECT s.company AS subject, p.company AS peer, s.growth AS sg, p.growth AS pg, """ + ", ".join(f"least(2, abs(s.{m} - p.{m}) / greatest(abs(s.{m}), abs(p.{m}), {f})) AS d{i}" for i, (m, f) in enumerate(PEER_METRICS.items())) + """
  FROM m s JOIN m p ON s.industry = p.industry AND s.company <> p.company),
k AS (SELECT subject, peer, sg, pg, CASE WHEN d0 IS NULL OR d1 IS NULL OR d2 IS NULL THEN 10.0 ELSE (d0 + d1 + d2) / 3 END AS distance FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY distance, peer) AS place FROM k), near AS (SELECT * FROM n WHERE place <= 8)"""


def near_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = company_facts(spark, sf_dir)
    return companies.peers(f, f, "industry", "company", PEER_METRICS)


@query(f"WITH {PEERS_SQL} SELECT subject, peer, round(distance, 6) AS distance, place FROM near")
def inv17_peer_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_peers(spark, sf_dir).select("subject", "peer", F.round("distance", 6).alias("distance"), "place")


@query(f"""WITH {PEERS_SQL} SELECT subject, round(max(sg), 5) AS value, round(median(pg), 5) AS median, CASE WHEN count(pg) >= 2 AND max(sg) IS NOT NULL THEN round((count(*) FILTER (pg < sg) + 0.5 * count(*) FILTER (pg = sg)) / count(pg) * 100, 5) END AS percentile, count(pg) AS sample
FROM near GROUP BY subject""")
def inv18_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = companies.compare_with_peers(near_peers(spark, sf_dir), "growth")
    return out.select("subject", *[F.round(c, 5).alias(c) for c in ("value", "median", "percentile")], "sample")


@query(f"""WITH {PEERS_SQL}, o AS (SELECT a.subject, a.place, median(b.pg) AS m FROM near a JOIN near b ON a.subject = b.subject AND a.place <> b.place WHERE a.pg IS NOT NULL AND b.pg IS NOT NULL GROUP BY ALL)
SELECT subject, round(min(m), 5) AS low, round(max(m), 5) AS high FROM o GROUP BY subject HAVING count(*) >= 3""")
def inv18_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.leave_one_out(near_peers(spark, sf_dir), "growth").select("subject", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


NOW = "2024-01-31 00:00:00"


@query(f"""WITH g AS (SELECT event_type, max(ts) FILTER (ts < TIMESTAMP '2024-01-29' OR user_id % 2 = 0) AS latest_at FROM events GROUP BY 1)
SELECT event_type, latest_at, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(latest_at)) / 3600000000, 6) AS age_hours, CASE WHEN latest_at > TIMESTAMP '{NOW}' THEN 'future' WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(latest_at)) / 3600000000 > 24.5 THEN 'stale' ELSE 'fresh' END AS state FROM g""")
def dq01_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("ts < TIMESTAMP_NTZ'2024-01-29' OR user_id % 2 = 0")
    return quality.freshness(e, "event_type", "ts", NOW, 24.5).withColumn("age_hours", F.round("age_hours", 6))


@query(f"""WITH {SERIES_SQL}, h AS (SELECT series_id, observed_at FROM series WHERE (month(observed_at) + length(series_id)) % 5 <> 0), r AS (SELECT series_id, min(observed_at) AS a, max(observed_at) AS b FROM h GROUP BY 1),
x AS (SELECT series_id, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS observed_at FROM r) SELECT series_id, observed_at FROM x ANTI JOIN h USING (series_id, observed_at)""")
def dq02_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = series(spark, sf_dir).filter((F.month("observed_at") + F.length("series_id")) % 5 != 0)
    return quality.gaps(h, "series_id", "observed_at", "monthly")


@query("""SELECT l_returnflag, count(*) AS total, count(DISTINCT (l_suppkey, l_quantity)) AS distinct_rows, count(*) - count(DISTINCT (l_suppkey, l_quantity)) AS repeats FROM lineitem GROUP BY 1""")
def dq03_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_suppkey", "l_quantity"])


@query("""WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1), r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
SELECT user_id, n, count(*) FILTER (n >= 5 AND s > 0 AND abs(value - m) > 1.5 * s) AS anomalies FROM r JOIN g USING (user_id) WHERE rn <= 5 GROUP BY ALL""")
def dq04_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.anomalies(table(spark, sf_dir, "events"), "user_id", "ts", "value", 1.5)


@query("""WITH res AS (SELECT user_id, event_type AS chk, CASE WHEN max(value) > 99 THEN NULL ELSE max(value) > 50 END AS healthy FROM events WHERE user_id % 5 <> 0 OR event_type <> 'click' GROUP BY ALL),
req AS (SELECT DISTINCT user_id, c AS chk FROM events, (VALUES ('click'), ('view')) v(c))
SELECT user_id, CASE WHEN bool_or(res.chk IS NULL) THEN 'unknown' WHEN bool_or(coalesce(NOT healthy, false)) THEN 'degraded' WHEN bool_or(healthy IS NULL) THEN 'unknown' ELSE 'healthy' END AS verdict
FROM req LEFT JOIN res ON res.user_id = req.user_id AND res.chk = req.chk GROUP BY user_id""".replace("SELECT user_id, CASE WHEN bool_or", "SELECT req.user_id, CASE WHEN bool_or").replace("GROUP BY user_id", "GROUP BY req.user_id"))
def dq05_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    res = e.filter("user_id % 5 <> 0 or event_type <> 'click'").groupBy("user_id", F.col("event_type").alias("check")).agg(F.when(F.max("value") <= 99, F.max("value") > 50).alias("healthy"))
    req = e.select("user_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([("click",), ("view",)], "check string")))
    return quality.verdicts(res, req, "user_id")


@query("""WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE CASE WHEN l_linestatus = 'O' THEN 'skipped' ELSE 'running' END END AS s FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_and(s = 'failed') THEN 'failed' WHEN bool_or(s = 'running') THEN 'running' WHEN bool_or(s = 'failed') THEN 'partial' WHEN bool_and(s = 'skipped') THEN 'skipped' ELSE 'completed' END AS state, count(*) AS stages FROM s GROUP BY 1""")
def dq07_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "completed").when(F.col("l_linestatus") == "O", "skipped").otherwise("running")
    return quality.stage_status(table(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("status")), "l_orderkey")


@query("""WITH e AS (SELECT event_id, event_id % 20 = 0 AS exact, CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0 END AS sim, CASE WHEN event_id % 4 = 0 THEN event_id % 6 END AS n, CASE WHEN event_id % 31 <> 0 THEN value / 100 END AS importance FROM events),
v AS (SELECT event_id, importance, CASE WHEN exact THEN 0.0 WHEN sim IS NOT NULL THEN 1 - sim WHEN n IS NOT NULL THEN 1 / (1 + n) ELSE 1.0 END AS novelty FROM e)
SELECT event_id, round(novelty, 8) AS novelty, CASE WHEN importance BETWEEN 0 AND 1 THEN round(importance * novelty * 0.9, 8) END AS score, coalesce(importance BETWEEN 0 AND 1 AND importance * novelty * 0.9 >= 0.3, false) AS routed FROM v""")
def mat02_materiality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    n = quality.novelty(k % 20 == 0, F.when(k % 3 == 0, (k % 10) / 10.0), F.when(k % 4 == 0, k % 6))
    e = table(spark, sf_dir, "events").select(k, F.when(k % 31 != 0, F.col("value") / 100).alias("importance"), n.alias("novelty"))
    score = quality.materiality([F.col("importance"), F.col("novelty"), F.lit(0.9)])
    return e.withColumn("s", score).select("event_id", F.round("novelty", 8).alias("novelty"), F.round("s", 8).alias("score"), F.coalesce(F.col("s") >= 0.3, F.lit(False)).alias("routed"))


@query("""SELECT l_suppkey AS market_id, l_returnflag AS category, sum(l_quantity) FILTER (l_linestatus = 'O') AS longs, sum(l_quantity) FILTER (l_linestatus = 'F') AS shorts,
  round(100 * (coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) - coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0)) / nullif(sum(l_quantity), 0), 6) AS net_percent FROM lineitem GROUP BY ALL""")
def src07_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    zero = lambda s: F.coalesce(part(s), F.lit(0.0))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("market_id"), F.col("l_returnflag").alias("category"))
    return g.agg(part("O").alias("longs"), part("F").alias("shorts"), F.round(100 * ratio(zero("O") - zero("F"), F.sum("l_quantity")), 6).alias("net_percent"))
