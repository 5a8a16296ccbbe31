"""Portfolio context, cohorts of cases and coverage of valuations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.operators import portfolio
from quaylight.plans.base import query, table

_HELD_SQL = "h AS (SELECT c_custkey, c_mktsegment AS sector, n_name AS country, r_name AS currency, CAST(c_acctbal AS DECIMAL(18, 2)) AS weight, ['T' || (c_custkey % 7), 'T' || (c_custkey % 31)] AS tags FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0)"


@query(f"""WITH {_HELD_SQL}, b AS (SELECT 'sector' AS dimension, sector AS bucket, weight FROM h UNION ALL SELECT 'country', country, weight FROM h UNION ALL SELECT 'currency', currency, weight FROM h
  UNION ALL SELECT 'theme', tag, weight FROM (SELECT unnest(tags) AS tag, weight FROM h) WHERE tag IN (SELECT 'T' || n_nationkey FROM nation))
SELECT dimension, bucket, exposure::DOUBLE AS exposure, holdings FROM (SELECT dimension, bucket, sum(weight) AS exposure, count(*) AS holdings FROM b GROUP BY dimension, bucket) QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY exposure DESC, bucket) <= 20""")
def inv11_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as holdings: exposure by sector, country, currency and theme, the largest twenty of each."""
    k, t = F.col("c_custkey"), lambda name: table(spark, sf_dir, name)
    tag = lambda n: F.concat(F.lit("T"), k % n)
    held = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    held = held.select(F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country"), F.col("r_name").alias("currency"), F.col("c_acctbal").cast("decimal(18,2)").alias("weight"), F.array(tag(7), tag(31)).alias("theme_tags"))
    themes = t("nation").select(F.concat(F.lit("T"), "n_nationkey").alias("name"))
    return portfolio.exposures(held, themes).withColumn("exposure", F.col("exposure").cast("double"))


@query("""SELECT o_orderkey AS id, o_custkey AS thesis_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS expected_at, o_orderdate AS created_at, c_nationkey AS theme_id, c_name AS company FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'P' ORDER BY expected_at NULLS LAST, created_at DESC, id LIMIT 20""")
def inv11_catalysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    catalysts = o.select(k.alias("id"), F.col("o_custkey").alias("thesis_id"), F.when(k % 5 > 0, F.col("o_orderdate")).alias("expected_at"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("state"))
    theses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("theme_id"), F.col("c_name").alias("company"))
    return portfolio.pending_catalysts(catalysts, theses).select("id", "thesis_id", "expected_at", "created_at", "theme_id", "company")


@query("""SELECT * FROM (SELECT 'thesis' AS kind, o_orderkey AS id, o_orderpriority AS title, o_orderdate AS review_at, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'theme', l_orderkey * 10 + l_linenumber, l_linestatus, l_shipdate, l_returnflag, l_shipdate FROM lineitem WHERE l_linenumber = 1) ORDER BY review_at, created_at DESC, kind, id LIMIT 20""")
def inv11_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    theses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("claim"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("review_at"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    themes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linestatus").alias("name"), F.when(F.col("l_linenumber") == 1, F.col("l_shipdate")).alias("review_at"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("created_at"))
    return portfolio.review_schedule(theses, themes)


_STATE_SQL = "list_extract([" + ", ".join(f"'{s}'" for s in portfolio.STATES) + "], ({0} % 7)::INT + 1)"
_IN = {name: ", ".join(f"'{s}'" for s in states) for name, states in portfolio.REACHED.items()}
_EVER = {name: ", ".join(f"'{s}'" for s in states) for name, states in portfolio.EVER.items()}


@query(f"""WITH c AS (SELECT o_custkey AS id, min(o_orderdate) AS first, max(o_orderdate) AS last, {_STATE_SQL.format("o_custkey")} AS state FROM orders GROUP BY o_custkey), s AS (SELECT o_custkey AS id, o_orderdate AS moment, {_STATE_SQL.format("(o_orderkey // 3)")} AS state FROM orders WHERE o_orderstatus <> 'F'),
r AS (SELECT id, {", ".join(f"min(moment) FILTER (state IN ({x})) AS first_{n}" for n, x in _IN.items())}, {", ".join(f"bool_or(state IN ({x})) AS ever_{n}" for n, x in _EVER.items())} FROM s GROUP BY id),
e AS (SELECT c.*, r.* EXCLUDE (id), coalesce(ever_corroborated, false) AS ec, coalesce(ever_research_ready, false) AS er, coalesce(ever_mature, false) AS em FROM c LEFT JOIN r ON r.id = c.id WHERE first >= TIMESTAMP '1995-02-01'),
g AS (SELECT strftime(first, '%Y-%m') AS cohort, count(*) AS case_count, count(first_forming) AS formed_count, count(*) FILTER (ec) AS corroborated_count, count(*) FILTER (er) AS research_ready_count, count(*) FILTER (em) AS mature_count, count(*) FILTER (state = 'archived') AS archived_count,
  count(*) FILTER (state = 'archived' AND NOT ec) AS weak_case_archived_count, count(*) FILTER (state = 'archived' AND er) AS research_ready_then_archived_count, median(greatest(0, date_diff('day', first, last)))::DOUBLE AS median_survival_days,
  {", ".join(f"median(CASE WHEN first_{n} IS NOT NULL THEN greatest(0, date_diff('day', first, first_{n})) END)::DOUBLE AS median_days_to_{n}" for n in _IN)}, {", ".join(f"count(*) FILTER (state = '{s}') AS now_{s}" for s in portfolio.STATES)} FROM e GROUP BY 1)
SELECT *, corroborated_count / nullif(formed_count, 0) AS forming_to_corroborated_rate, research_ready_count / nullif(corroborated_count, 0) AS corroborated_to_research_ready_rate, research_ready_count / case_count AS research_ready_rate, mature_count / case_count AS mature_rate,
  archived_count / case_count AS archived_rate, weak_case_archived_count / case_count AS weak_case_archived_rate FROM g""")
def res09_month_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, their orders as snapshots: cohorts of months, from the second month on."""
    o = table(spark, sf_dir, "orders")
    state = lambda n: F.element_at(F.array(*[F.lit(s) for s in portfolio.STATES]), (n % 7 + 1).cast("int"))
    cases = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderdate").alias("first_seen_at"), F.max("o_orderdate").alias("last_evidence_at")).withColumn("state", state(F.col("case_id")))
    snapshots = o.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderdate").alias("at"), state(F.floor(F.col("o_orderkey") / 3)).alias("state"))
    return portfolio.cohorts(cases, snapshots, F.lit("1995-02-01").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'Calculated' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'other' END AS status, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice - 1000 END AS per_share, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 10 END AS ev,
  CASE WHEN p_partkey % 5 > 1 THEN p_retailprice WHEN p_partkey % 5 = 1 THEN 0 END AS price, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS listed, CASE WHEN p_size > 20 THEN p_size END AS pe, CASE WHEN p_size % 2 = 0 THEN 0.1 END AS margin FROM part),
b AS (SELECT *, CASE WHEN lower(status) IN ('calculated', 'enterprise_value_only', 'unavailable') THEN lower(status) WHEN per_share IS NOT NULL THEN 'calculated' WHEN ev IS NOT NULL THEN 'enterprise_value_only' ELSE 'unavailable' END AS s, coalesce(coalesce(price, listed) > 0, false) AS priced FROM a)
SELECT count(*) FILTER (s = 'calculated') AS dcf_calculated_count, count(*) FILTER (s = 'enterprise_value_only') AS dcf_enterprise_value_only_count, count(*) FILTER (s = 'unavailable') AS dcf_unavailable_count, count(*) FILTER (priced) AS market_price_count,
  count(*) FILTER (priced AND pe IS NOT NULL) AS pe_ratio_count, count(*) FILTER (priced AND margin IS NOT NULL AND per_share > 0) AS margin_of_safety_count FROM b""")
def inv19_valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    analyses = table(spark, sf_dir, "part").select(
        F.when(k % 6 == 0, "Calculated").when(k % 6 == 1, "unavailable").when(k % 6 == 2, "other").alias("dcf_status"), F.when(k % 3 == 0, price - 1000).alias("per_share"), F.when(k % 4 == 0, price * 10).alias("enterprise_value"),
        F.when(k % 5 > 1, price).when(k % 5 == 1, 0.0).alias("market_price"), F.when(k % 2 == 0, price).alias("metric_price"), F.when(F.col("p_size") > 20, F.col("p_size").cast("double")).alias("pe"), F.when(F.col("p_size") % 2 == 0, 0.1).alias("margin_of_safety"),
    )
    return portfolio.valuation_coverage(analyses)
