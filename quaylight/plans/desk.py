"""Companies, cases, claims, playbooks, releases and the desk's reads over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions import text
from quaylight.operators import companies, keys, macro, reaction, research, stories
from quaylight.plans.base import CALENDAR_SQL, CHAIN_SQL, SERIES_SQL, chain, query, series, table
from quaylight.plans.reactions import MOVES_SQL, moves
from quaylight.plans.texts import TITLES_SQL, titles

#: A supplier's figures of two years, from its sales; every so many lack a figure or have a zero.
FACTS_SQL = """years AS (SELECT l_suppkey AS company, year(l_shipdate) AS y, round(sum(l_extendedprice)) AS revenue, round(sum(l_extendedprice * l_discount)) AS costs, round(sum(l_extendedprice * l_tax)) AS capex, sum(l_quantity) AS inventory, count(*) AS backlog
  FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY ALL),
two AS (SELECT company, any_value(revenue) FILTER (y = 1997) AS revenue, any_value(revenue) FILTER (y = 1996) AS prior_revenue, any_value(costs) FILTER (y = 1997) AS costs, any_value(costs) FILTER (y = 1996) AS prior_costs,
  any_value(capex) FILTER (y = 1997) AS capex, any_value(capex) FILTER (y = 1996) AS prior_capex, any_value(inventory) FILTER (y = 1997) AS inventory, any_value(inventory) FILTER (y = 1996) AS prior_inventory,
  any_value(backlog) FILTER (y = 1997) AS backlog, any_value(backlog) FILTER (y = 1996) AS prior_backlog FROM years GROUP BY 1),
facts AS (SELECT s_suppkey AS company, two.* EXCLUDE (company), s_acctbal AS net_income, CASE WHEN s_suppkey % 7 <> 0 THEN round(s_acctbal) * 4 ELSE 0 END AS equity, round(abs(s_acctbal)) * 9 + 1 AS assets, CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey * 100.0 END AS debt,
  s_suppkey % 9 * 10.0 AS current_assets, s_suppkey % 5 * 10.0 AS current_liabilities, s_suppkey % 6 * 12.5 AS price, (s_suppkey % 8 - 2) / 2.0 AS eps, s_suppkey % 10 * 100.0 AS shares, CASE WHEN s_suppkey % 13 = 0 THEN 77777.0 END AS market_cap,
  s_suppkey % 4 * 250.0 AS net_debt, s_suppkey % 3 * 500.0 AS ebitda, 2 * costs - capex AS fcf, 2 * prior_costs - prior_capex AS prior_fcf FROM supplier LEFT JOIN two ON two.company = s_suppkey)"""


def facts(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    year, price = F.year("l_shipdate"), F.col("l_extendedprice")
    sums = {"revenue": F.sum(price), "costs": F.sum(price * F.col("l_discount")), "capex": F.sum(price * F.col("l_tax"))}
    years = table(spark, sf_dir, "lineitem").filter(year.isin(1996, 1997)).groupBy(F.col("l_suppkey").alias("company"), year.alias("y"))
    years = years.agg(*[F.round(v).alias(k) for k, v in sums.items()], F.sum("l_quantity").alias("inventory"), F.count("*").alias("backlog"))
    two = years.groupBy("company").agg(*[F.max(F.when(F.col("y") == y, F.col(c))).alias(f"{p}{c}") for c in (*sums, "inventory", "backlog") for y, p in ((1997, ""), (1996, "prior_"))])
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        k.alias("company"), F.col("s_acctbal").alias("net_income"), F.when(k % 7 != 0, F.round("s_acctbal") * 4).otherwise(0).alias("equity"), (F.round(F.abs("s_acctbal")) * 9 + 1).alias("assets"), F.when(k % 11 != 0, F.col("s_nationkey") * 100.0).alias("debt"),
        (k % 9 * 10.0).alias("current_assets"), (k % 5 * 10.0).alias("current_liabilities"), (k % 6 * 12.5).alias("price"), ((k % 8 - 2) / 2.0).alias("eps"), (k % 10 * 100.0).alias("shares"), F.when(k % 13 == 0, 77777.0).alias("market_cap"),
        (k % 4 * 250.0).alias("net_debt"), (k % 3 * 500.0).alias("ebitda"),
    )
    f = s.join(two, "company", "left")
    return f.withColumns({"fcf": 2 * F.col("costs") - F.col("capex"), "prior_fcf": 2 * F.col("prior_costs") - F.col("prior_capex")})


RATIOS_SQL = FACTS_SQL + """, v AS (SELECT *, coalesce(market_cap, nullif(price, 0) * nullif(shares, 0)) AS cap FROM facts),
ratios AS (SELECT *, net_income / nullif(equity, 0) AS roe, net_income / nullif(assets, 0) AS roa, debt / nullif(equity, 0) AS debt_to_equity, current_assets / nullif(current_liabilities, 0) AS current_ratio, fcf / nullif(net_income, 0) AS fcf_conversion,
  net_income / nullif(revenue, 0) * 100 AS net_margin_pct, CASE WHEN price <> 0 AND eps > 0 THEN price / eps WHEN cap <> 0 AND net_income > 0 THEN cap / net_income END AS pe, CASE WHEN cap <> 0 AND fcf > 0 THEN cap / fcf END AS pfcf,
  CASE WHEN cap + nullif(net_debt, 0) <> 0 AND ebitda > 0 THEN (cap + nullif(net_debt, 0)) / ebitda END AS ev_ebitda, CASE WHEN cap + nullif(net_debt, 0) <> 0 AND revenue > 0 THEN (cap + nullif(net_debt, 0)) / revenue END AS ev_revenue FROM v)"""
_RATIOS = ("roe", "roa", "debt_to_equity", "current_ratio", "fcf_conversion", "net_margin_pct", "pe", "pfcf", "ev_ebitda", "ev_revenue")


@query(f"WITH {RATIOS_SQL} SELECT company, {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)} FROM ratios")
def inv04_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return f.select("company", *[F.round(c, 6).alias(n) for n, c in companies.ratios({x: F.col(x) for x in f.columns}).items()])


_STRENGTH = {"ai_demand": 5, "data_centre_demand": 4, "supply_constraints": 6, "pricing_power": 3}
_SAID_SQL = {x: f"CASE company % {n} WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'weak' END" for x, n in _STRENGTH.items()}
_STEPS_SQL = "CASE WHEN {c} IS NULL THEN 0 WHEN {c} >= {high} THEN 2 WHEN {c} > 0 THEN 1 WHEN {c} < -10 THEN -2 ELSE -1 END"
_CHANGE_SQL = "({c} - prior_{c}) / nullif(abs(prior_{c}), 0) * 100"


@query(f"""WITH {RATIOS_SQL}, m AS (SELECT *, fcf / nullif(revenue, 0) AS margin, prior_fcf / nullif(prior_revenue, 0) AS prior_margin, (revenue - costs * 9) / nullif(revenue, 0) * 100 AS gross, (prior_revenue - prior_costs * 9) / nullif(prior_revenue, 0) * 100 AS prior_gross,
  {", ".join(f"{_CHANGE_SQL.format(c=c)} AS {c}_change" for c in ("revenue", "capex", "inventory", "backlog"))} FROM ratios),
s AS (SELECT *, {_STEPS_SQL.format(c="revenue_change", high=10)} AS s1, {_STEPS_SQL.format(c="capex_change", high=15)} AS s2,
  CASE WHEN margin > prior_margin THEN 2 WHEN fcf <> 0 AND prior_fcf <> 0 AND fcf > prior_fcf THEN 1 WHEN margin < prior_margin THEN -2 ELSE 0 END AS s3, CASE WHEN gross >= 60 OR gross > prior_gross THEN 1 WHEN gross < prior_gross THEN -1 ELSE 0 END AS s4,
  CASE WHEN inventory_change > revenue_change + 10 THEN -2 WHEN inventory_change <= revenue_change THEN 1 ELSE 0 END AS s5, CASE WHEN backlog_change > 0 THEN 1 WHEN backlog_change < 0 THEN -1 ELSE 0 END AS s6,
  {", ".join(f"CASE {_SAID_SQL[x]} WHEN 'strong' THEN 2 WHEN 'moderate' THEN {2 if x == 'ai_demand' else 1} ELSE 0 END AS q{k}" for k, x in enumerate(_STRENGTH))}, CASE company % 4 WHEN 1 THEN 2 WHEN 2 THEN -2 ELSE 0 END AS s11 FROM m),
t AS (SELECT *, greatest(0, least(10, s1 + s2 + s3 + s4 + s5 + s6 + q0 + q1 + q2 + q3 + s11)) AS score, revenue IS NOT NULL AND prior_revenue IS NOT NULL AND capex IS NOT NULL AND prior_capex IS NOT NULL AND fcf IS NOT NULL AND prior_fcf IS NOT NULL AND gross IS NOT NULL AS comparable FROM s),
b AS (SELECT *, CASE WHEN score < 2 THEN 'monitor' WHEN score < 5 OR NOT comparable THEN 'forming' WHEN score < 8 THEN 'confirmed' ELSE 'accelerating' END AS base FROM t)
SELECT company, concat_ws(',', s1, s2, s3, s4, s5, s6, q0, q1, q2, q3, s11) AS signals, score, CASE WHEN base IN ('confirmed', 'accelerating') AND company % 5 >= 2 AND company % 6 >= 3 AND coalesce(pe >= 25, false) THEN 'mature' ELSE base END AS stage FROM b""")
def inv05_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    gross = lambda p: F.when(F.col(f"{p}revenue") != 0, (F.col(f"{p}revenue") - F.col(f"{p}costs") * 9) / F.col(f"{p}revenue") * 100)
    f = f.withColumns({"fcf_margin": over("fcf", "revenue"), "prior_fcf_margin": over("prior_fcf", "prior_revenue"), "gross_margin": gross(""), "prior_gross_margin": gross("prior_")})
    m, k = {x: F.col(x) for x in f.columns}, F.col("company")
    said = {x: F.when(k % n == 0, "strong").when(k % n == 1, "moderate").when(k % n == 2, "weak") for x, n in _STRENGTH.items()}
    found = companies.signals(m, said, F.when(k % 4 == 1, "up").when(k % 4 == 2, "down"))
    total = sum(found.values(), F.lit(0))
    known = F.lit(True)
    for c in ("revenue", "prior_revenue", "capex", "prior_capex", "fcf", "prior_fcf", "gross_margin"):
        known = known & m[c].isNotNull()
    out = f.select("company", F.concat_ws(",", *[c.cast("string") for c in found.values()]).alias("signals"), F.greatest(F.lit(0), F.least(F.lit(10), total)).alias("score"), known.alias("known"), companies.ratios(m)["pe"].alias("pe"))
    return out.select("company", "signals", "score", companies.stage(F.col("score"), F.col("known"), k % 5, k % 6, F.col("pe")).alias("stage"))


@query(f"""WITH {RATIOS_SQL} SELECT count(*) AS companies, count(*) FILTER (pe IS NOT NULL) AS with_pe, count(*) FILTER (ev_ebitda IS NOT NULL) AS with_ev_ebitda, count(*) FILTER (pfcf IS NOT NULL) AS with_pfcf, count(*) FILTER (price <> 0) AS priced,
  count(*) FILTER (pe IS NULL AND ev_ebitda IS NULL AND pfcf IS NULL AND ev_revenue IS NULL) AS uncovered FROM ratios""")
def inv19_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many companies have which valuation: one aggregate."""
    f = facts(spark, sf_dir)
    r = companies.ratios({x: F.col(x) for x in f.columns})
    none = r["pe"].isNull() & r["ev_ebitda"].isNull() & r["pfcf"].isNull() & r["ev_revenue"].isNull()
    return f.agg(
        F.count("*").alias("companies"), F.count(r["pe"]).alias("with_pe"), F.count(r["ev_ebitda"]).alias("with_ev_ebitda"), F.count(r["pfcf"]).alias("with_pfcf"), F.count_if(F.col("price") != 0).alias("priced"), F.count_if(none).alias("uncovered"),
    )


_CONCEPTS, _UNITS = ("line5", "line1", "line3"), ("A", "N", "R")


@query(f"""WITH f AS (SELECT l_suppkey AS company, 'line' || l_linenumber AS concept, l_returnflag AS unit, l_shipdate::DATE AS period_start, (l_shipdate::DATE + (200 + l_partkey % 400)::INT) AS period_end, l_orderkey * 10 + l_linenumber AS filed, l_extendedprice AS value FROM lineitem),
p AS (SELECT *, list_position({list(_CONCEPTS)}, concept) AS c, list_position({list(_UNITS)}, unit) AS u FROM f WHERE concept IN {_CONCEPTS} AND period_end - period_start BETWEEN 270 AND 550),
b AS (SELECT company, min((c, u)) AS best FROM p GROUP BY 1), o AS (SELECT company, concept, unit, period_end, arg_max(value, filed) AS value FROM p JOIN b USING (company) WHERE (c, u) = best GROUP BY ALL)
SELECT company, concept, unit, period_end, value, prior FROM (SELECT *, lead(value) OVER w AS prior, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY company ORDER BY period_end DESC)) WHERE rn = 1""")
def inv22_annual_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("company"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("concept"), F.col("l_returnflag").alias("unit"), day.alias("period_start"), F.date_add(day, (200 + F.col("l_partkey") % 400).cast("int")).alias("period_end"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("filed"), F.col("l_extendedprice").alias("value"),
    )
    return companies.annual_facts(f, _CONCEPTS, _UNITS)


@query("""WITH h AS (SELECT o_custkey AS account, p_brand AS holding, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL), t AS (SELECT account, sum(q) AS total FROM h GROUP BY 1)
SELECT account, count(*) AS holdings, arg_max(holding, (q, holding)) AS largest, round(max(q) / any_value(total), 8) AS largest_share, round(sum(q * q) / (any_value(total) * any_value(total)), 8) AS concentration FROM h JOIN t USING (account) GROUP BY account""")
def inv11_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's holdings: how many, the largest and its share, and how concentrated they are."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account")), "l_orderkey")
    held = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("holding")), "l_partkey").groupBy("account", "holding").agg(F.sum("l_quantity").alias("q"))
    g = held.groupBy("account").agg(F.count("*").alias("holdings"), F.max_by("holding", F.struct("q", "holding")).alias("largest"), F.max("q").alias("most"), F.sum("q").alias("total"), F.sum(F.col("q") * F.col("q")).alias("squares"))
    return g.select("account", "holdings", "largest", F.round(F.col("most") / F.col("total"), 8).alias("largest_share"), F.round(F.col("squares") / (F.col("total") * F.col("total")), 8).alias("concentration"))


@query("""WITH l AS (SELECT p_brand AS theme, l_shipdate AS moment, l_extendedprice AS price, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT theme, id, row_number() OVER (PARTITION BY theme ORDER BY moment, id) AS rn FROM l WHERE moment > TIMESTAMP '1998-09-01'),
u AS (SELECT theme, string_agg(id::VARCHAR, ',' ORDER BY rn) AS upcoming FROM n WHERE rn <= 5 GROUP BY 1), i AS (SELECT theme, count(*) FILTER (moment <= TIMESTAMP '1998-09-01') AS seen, arg_max(price, (moment, id)) FILTER (moment <= TIMESTAMP '1998-09-01') AS indicator FROM l GROUP BY 1)
SELECT theme, seen, indicator, coalesce(upcoming, '') AS upcoming FROM i LEFT JOIN u USING (theme)""")
def inv12_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theme's latest indicator and its next five events."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("theme")), "l_partkey")  # noqa: E741
    l = l.select("theme", F.col("l_shipdate").alias("at"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))  # noqa: E741
    seen = F.col("at") <= F.lit("1998-09-01").cast("timestamp_ntz")
    known = l.groupBy("theme").agg(F.count_if(seen).alias("seen"), F.max_by(F.when(seen, F.col("price")), F.when(seen, F.struct("at", "id"))).alias("indicator"))
    following = keys.top_n(l.filter(~seen), ["theme"], [F.asc("at"), F.asc("id")], 5).groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("n"))
    out = known.join(following, "theme", "left")
    return out.select("theme", "seen", "indicator", F.coalesce(F.array_join(F.transform("n", lambda x: x["id"].cast("string")), ","), F.lit("")).alias("upcoming"))


@query("""SELECT source, arg_max(lang, doc_id) AS last_lang, max(doc_id) AS last_run, arg_max(n_chars, doc_id) AS fetched, CASE WHEN arg_max(n_chars, doc_id) > 1000 THEN 'complete' ELSE 'partial' END AS status FROM documents WHERE lang IS NOT NULL GROUP BY source""")
def inv21_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each filing source."""
    g = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("source")
    out = g.agg(F.max_by("lang", "doc_id").alias("last_lang"), F.max("doc_id").alias("last_run"), F.max_by("n_chars", "doc_id").alias("fetched"))
    return out.withColumn("status", F.when(F.col("fetched") > 1000, "complete").otherwise("partial"))


#: Cases are the documents; their names the first and the last line.  Fingerprints join language and the first words.
CASES_SQL = TITLES_SQL + f""", lines AS (SELECT doc_id AS id, string_split(text, chr(10))[-1] AS last_line FROM documents WHERE text IS NOT NULL),
alias AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(last_line), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)}))) AS other FROM lines),
cases AS (SELECT tok.id, tokens, other, coalesce(lang, '') || ':' || array_to_string(list_slice(list_sort(tokens), 1, 12), ' ') AS fingerprint FROM tok JOIN alias USING (id))"""


@query(f"""WITH {CASES_SQL}, asked AS (SELECT * FROM cases WHERE id % 100 = 0), held AS (SELECT * FROM cases WHERE id % 100 <> 0), exact AS (SELECT a.id, min(c.id) AS case_id FROM asked a JOIN held c USING (fingerprint) GROUP BY 1),
p AS (SELECT a.id, c.id AS case_id, greatest(len(list_intersect(a.tokens, c.tokens)) / nullif(len(list_distinct(a.tokens || c.tokens)), 0), len(list_intersect(a.tokens, c.other)) / nullif(len(list_distinct(a.tokens || c.other)), 0)) AS score FROM asked a JOIN held c ON true WHERE a.id NOT IN (SELECT id FROM exact)),
b AS (SELECT id, arg_max(case_id, (score, -case_id)) AS case_id, max(score) AS score FROM p WHERE score >= 0.12 GROUP BY 1)
SELECT id, case_id, 'fingerprint' AS how, 1.0 AS score FROM exact UNION ALL SELECT id, case_id, 'similarity', round(score, 8) FROM b""")
def res04_case_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda n: text.title_tokens(F.substring_index("text", "\n", n))
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "lang", line(1).alias("tokens"), line(-1).alias("other"))
    c = d.withColumn("fingerprint", F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.array_join(F.slice(F.array_sort("tokens"), 1, 12), " ")))
    found = research.match_cases(c.filter("id % 100 = 0").select("id", "fingerprint", "tokens"), c.filter("id % 100 <> 0").select(F.col("id").alias("case_id"), "fingerprint", F.array("tokens", "other").alias("names")), 0.12)
    return found.withColumn("score", F.round("score", 8))


_NUMBERS_SQL = "list_distinct(regexp_extract_all(coalesce({x}, ''), '" + research.NUMBER + "', 1))"
_PLAIN_SQL = "lower(trim(regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g')))"


@query(f"""WITH c AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 13 = 0 THEN -doc_id ELSE doc_id END AS evidence_id, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE source END AS subject, CASE doc_id % 5 WHEN 0 THEN 'UP' WHEN 1 THEN 'sideways' END AS direction,
  CASE WHEN doc_id % 7 = 0 THEN substring(text, 5, 60) || ' zzz' WHEN doc_id % 3 = 0 THEN '  ' || translate(substring(text, 5, 60), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE substring(text, 5, 60) END AS span, CASE WHEN doc_id % 4 = 0 THEN '7.5%' WHEN doc_id % 4 = 1 THEN 'many' END AS value, CASE WHEN doc_id % 6 = 0 THEN 'EUR' END AS unit FROM documents),
j AS (SELECT c.*, text, d.doc_id AS found FROM c LEFT JOIN documents d ON d.doc_id = evidence_id)
SELECT claim_id, CASE WHEN found IS NULL THEN 'unknown_evidence' WHEN trim(coalesce(subject, '')) = '' THEN 'missing_text' WHEN direction = 'sideways' THEN 'invalid_direction' WHEN trim(coalesce(span, '')) = '' THEN 'missing_span'
  WHEN NOT coalesce(contains({_PLAIN_SQL.format(x="text")}, {_PLAIN_SQL.format(x="span")}), false) THEN 'span_absent' WHEN len(list_filter({_NUMBERS_SQL.format(x="value")}, lambda n: NOT list_contains({_NUMBERS_SQL.format(x="span")}, n))) > 0 THEN 'number_absent'
  WHEN value IS NULL AND unit IS NOT NULL THEN 'unit_without_value' END AS fault FROM j""")
def res17_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, some = F.col("doc_id"), F.substring("text", 5, 60)
    d = table(spark, sf_dir, "documents")
    claims = d.select(
        k.alias("claim_id"), F.when(k % 13 == 0, -k).otherwise(k).alias("evidence_id"), F.when(k % 17 == 0, " ").otherwise(F.col("source")).alias("subject"), F.lit("says").alias("predicate"), F.when(k % 5 == 0, "UP").when(k % 5 == 1, "sideways").alias("direction"),
        F.when(k % 7 == 0, F.concat(some, F.lit(" zzz"))).when(k % 3 == 0, F.concat(F.lit("  "), F.translate(some, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).otherwise(some).alias("source_span"), F.when(k % 4 == 0, "7.5%").when(k % 4 == 1, "many").alias("object_value"), F.when(k % 6 == 0, "EUR").alias("unit"),
    )
    return research.claim_faults(claims, d.select(k.alias("evidence_id"), "text"), ("up", "down", "flat")).select("claim_id", "fault")


@query("""WITH u AS (SELECT user_id AS source, max(ts) AS attempt, max(ts) FILTER (event_type <> 'error') AS success, arg_max(event_type, (ts, event_id)) AS last_type, count(*) FILTER (ts > TIMESTAMP '2024-01-29') AS records FROM events GROUP BY 1),
s AS (SELECT *, CASE last_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN CASE WHEN source % 2 = 0 THEN 'throttled' ELSE 'cached' END WHEN 'click' THEN 'Success' END AS status, CASE WHEN source % 7 = 0 THEN 'fallback' END AS cache,
  CASE WHEN source % 19 <> 0 THEN make_timestamp((epoch_us(attempt) // 21600000000 + 1) * 21600000000) END AS following FROM u)
SELECT source, CASE WHEN source % 17 = 0 THEN 'disabled' WHEN status = 'throttled' THEN 'rate_limited' WHEN status = 'failed' THEN 'failed' WHEN status = 'cached' OR coalesce(cache = 'fallback' AND status = 'Success', false) THEN 'cached_fallback' WHEN following IS NULL THEN 'outside_schedule'
  WHEN cache = 'fallback' AND (status = 'Success' OR status IS NULL AND success IS NOT NULL) THEN 'cached_fallback' WHEN TIMESTAMP '2024-01-30 20:00:00' < following THEN CASE WHEN (status = 'Success' OR status IS NULL AND success IS NOT NULL) AND records = 0 THEN 'expected_idle' ELSE 'current' END
  WHEN epoch_us(TIMESTAMP '2024-01-30 20:00:00') - epoch_us(following) <= 14400000000 THEN 'delayed' ELSE 'stale' END AS state FROM s""")
def dq06_source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of sources that run every six hours; the schedule's next run after an attempt is computed beforehand."""
    kind, k = F.col("event_type"), F.col("source")
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(
        F.max("ts").alias("attempt"), F.max(F.when(kind != "error", F.col("ts"))).alias("success"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("ts") > F.lit("2024-01-29").cast("timestamp_ntz")).alias("records"))
    status = F.when(F.col("last") == "error", "failed").when(F.col("last") == "purchase", F.when(k % 2 == 0, "throttled").otherwise("cached")).when(F.col("last") == "click", "Success")
    following = F.timestamp_micros((F.floor(F.unix_micros(F.col("attempt").cast("timestamp")) / 21_600_000_000) + 1) * 21_600_000_000).cast("timestamp_ntz")
    state = research.freshness_state(k % 17 != 0, F.when(k % 19 != 0, following), F.col("attempt"), F.col("success"), F.lit(None), status, F.when(k % 7 == 0, "fallback"), F.col("records"), F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), 14_400)
    return u.select("source", state.alias("state"))


BOOKS_SQL = """books AS (SELECT p_partkey AS playbook_id, CASE p_size % 3 WHEN 0 THEN ['signup', 'Purchase '] WHEN 1 THEN ['view'] ELSE ['error', 'click'] END AS types, CASE WHEN p_partkey % 5 = 0 THEN [] ELSE [' U' || (p_partkey % 300), 'b' || (p_partkey % 7)] END AS entities,
  CASE WHEN p_partkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((p_size)::INT) END AS expected_at, CASE WHEN p_partkey % 6 = 0 THEN 1 END AS superseded_at FROM part)"""


def playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return table(spark, sf_dir, "part").select(
        k.alias("playbook_id"), F.when(size % 3 == 0, words("signup", "Purchase ")).when(size % 3 == 1, words("view")).otherwise(words("error", "click")).alias("event_types"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(" U"), (k % 300).cast("string")), F.concat(F.lit("b"), (k % 7).cast("string")))).alias("entities"),
        F.when(k % 4 != 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(size.cast("int"))).alias("expected_at"), F.when(k % 6 == 0, 1).alias("superseded_at"), k.alias("created_at"),
    )


@query(f"""WITH {BOOKS_SQL}, b AS (SELECT playbook_id, unnest(list_distinct(list_transform(types, lambda t: lower(trim(t))))) AS type, entities FROM books), p AS (SELECT playbook_id, type, unnest(list_transform(entities, lambda t: lower(trim(t)))) AS entity FROM b)
SELECT event_id, playbook_id, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM events JOIN p ON type = event_type AND entity = 'u' || user_id GROUP BY ALL""")
def ths16_playbook_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.array(F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(" "))).alias("entities"))
    return research.playbook_matches(e, playbooks(spark, sf_dir))


@query(f"""WITH {BOOKS_SQL} SELECT playbook_id, expected_at FROM books WHERE superseded_at IS NULL AND (expected_at IS NULL OR expected_at <= TIMESTAMP '2024-01-10') ORDER BY expected_at NULLS LAST, playbook_id LIMIT 100""")
def ths16_due_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.due_playbooks(playbooks(spark, sf_dir), F.lit("2024-01-10").cast("timestamp_ntz"), 100).select("playbook_id", "expected_at")


@query("""SELECT o_orderkey AS proposal_id, o_orderstatus AS status, o_totalprice AS score, lines, risks FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS risks FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def ths17_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of open proposals, best first, with what their parts say; only the page's parts are counted."""
    page = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("proposal_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "proposal_id").limit(50)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proposal_id"), "l_returnflag").join(F.broadcast(page.select("proposal_id")), "proposal_id", "left_semi")
    return page.join(lines.groupBy("proposal_id").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("risks")), "proposal_id", "left")


RELEASES_SQL = """releases AS (SELECT event_id AS id, ts AS moment, value, ' ' || upper(event_type) AS source, CASE WHEN user_id % 4 = 0 THEN 'R' || (user_id % 50) END AS explicit, CASE WHEN user_id % 3 <> 0 THEN 'cpi ' ELSE ' ' END AS name, strftime(ts, '%Y-%m') AS period, CASE WHEN value > 50 THEN 'beat' ELSE 'miss' END AS verdict FROM events)"""
_IDENTITY_SQL = "lower(trim(source)) || ':' || coalesce(nullif(trim(explicit), ''), coalesce(nullif(trim(name), ''), 'series' || id % 20) || ':' || period)"


@query(f"""WITH {RELEASES_SQL}, i AS (SELECT *, {_IDENTITY_SQL} AS identity FROM releases), c AS (SELECT *, lag(verdict) OVER (PARTITION BY identity ORDER BY moment, id) AS before FROM i)
SELECT identity, max((moment, id))[2] AS id, max(moment) AS "at", arg_max(verdict, (moment, id)) AS verdict, count(*) FILTER (before <> verdict) AS revisions FROM c GROUP BY identity""")
def mac03_release_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("value") > 50, "beat").otherwise("miss").alias("verdict"), research.release_identity(
        F.concat(F.lit(" "), F.upper("event_type")), F.when(u % 4 == 0, F.concat(F.lit("R"), (u % 50).cast("string"))), F.when(u % 3 != 0, "cpi ").otherwise(" "), F.concat(F.lit("series"), (F.col("event_id") % 20).cast("string")), F.date_format("ts", "yyyy-MM"),
    ).alias("identity"))
    return research.release_cards(e, ["verdict"])


@query(f"""WITH {SERIES_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY observed_at) AS before, lag(observed_at) OVER (PARTITION BY series_id ORDER BY observed_at) AS reference_at FROM series)
SELECT series_id, observed_at, series_id || CASE WHEN before IS NULL THEN ' has no prior observation' WHEN abs(value - before) < 500 THEN ' held at ' || round(value)::BIGINT || ' versus ' || round(before)::BIGINT || ' over the prior observation'
  ELSE CASE WHEN value > before THEN ' rose ' ELSE ' fell ' END || round(abs(value - before))::BIGINT || ' over the prior observation to ' || round(value)::BIGINT || ' from ' || round(before)::BIGINT END || coalesce(' (' || reference_at || ' to ' || observed_at || ')', '') || '.' AS statement FROM p""")
def mac09_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.statements(series(spark, sf_dir), ["series_id"], "observed_at", "value", still=500.0)


@query(f"""WITH {SERIES_SQL}, s AS (SELECT *, CASE WHEN value > 155000 THEN 'expansion' WHEN value > 148000 THEN 'neutral' ELSE 'slowdown' END AS regime FROM series), c AS (SELECT *, lag(regime) OVER (PARTITION BY series_id ORDER BY observed_at) AS before FROM s)
SELECT series_id, regime, observed_at AS since, lead(observed_at) OVER (PARTITION BY series_id ORDER BY observed_at) AS until FROM c WHERE regime IS DISTINCT FROM before""")
def mac10_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' regimes in order; the one without an end is current."""
    v = F.col("value")
    s = series(spark, sf_dir).withColumn("regime", F.when(v > 155000, "expansion").when(v > 148000, "neutral").otherwise("slowdown"))
    return research.state_changes(s, "series_id", "observed_at", "regime")


@query(f"""WITH {CHAIN_SQL}, q AS (SELECT symbol, contract, l_shipdate::DATE AS captured, l_extendedprice AS bid, l_orderkey * 10 + l_linenumber AS id FROM chain JOIN lineitem ON l_partkey = contract), n AS (SELECT symbol, max(captured) AS captured, count(DISTINCT captured) - 1 AS history FROM q GROUP BY 1)
SELECT symbol, contract, captured, arg_max(bid, id) AS bid, any_value(history) AS history FROM q JOIN n USING (symbol, captured) GROUP BY ALL""")
def opt01_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's latest snapshot, a contract once, and how many earlier ones there are."""
    q = chain(spark, sf_dir).select("symbol", "contract").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("contract"), F.to_date("l_shipdate").alias("captured"), F.col("l_extendedprice").alias("bid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), "contract")
    latest = q.groupBy("symbol").agg(F.max("captured").alias("captured"), (F.countDistinct("captured") - 1).alias("history"))
    return q.join(latest, ["symbol", "captured"]).groupBy("symbol", "contract", "captured", "history").agg(F.max_by("bid", "id").alias("bid"))


@query(f"""WITH {TITLES_SQL}, c AS (SELECT title, count(*) AS items, count(DISTINCT source) AS sources, min(id) AS first_id, max("at") AS last_seen FROM tok WHERE len(tokens) > 0 GROUP BY 1) SELECT first_id, items, sources, last_seen FROM c WHERE items >= 2 AND sources >= 2 AND last_seen >= 36000 ORDER BY last_seen DESC, first_id DESC LIMIT 50""")
def sty05_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that several sources report, those seen last first, by the filters of a listing."""
    c = titles(spark, sf_dir).filter(F.size("tokens") > 0).groupBy("title").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"), F.min("id").alias("first_id"), F.max("at").alias("last_seen"))
    return c.filter("items >= 2 and sources >= 2 and last_seen >= 36000").orderBy(F.desc("last_seen"), F.desc("first_id")).limit(50).select("first_id", "items", "sources", "last_seen")


@query()
def fn13_nfkc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after NFKC, which DuckDB lacks; a test holds it to plain Python."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(research.nfkc_tokens("text"), " ").alias("tokens"))


@query("""SELECT event_id, key, CASE WHEN json_type(props, '$.' || key) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN json_type(props, '$.' || key) = 'VARCHAR' THEN 'string' ELSE lower(json_type(props, '$.' || key)) END AS kind,
  json_extract_string(props, '$.' || key) AS value, len(json_keys(props)) AS size FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def arr03_json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry of an object with the kind of its value, and the object's size."""
    e = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"), F.size(F.json_object_keys("props")).alias("size"))
    entries = spark.sql("SELECT event_id, size, key, schema_of_variant(value) AS type, CAST(value AS STRING) AS value FROM {e}, LATERAL variant_explode(v) AS x(pos, key, value)", e=e)
    kind = F.when(F.col("type").isin("BIGINT", "DOUBLE") | F.col("type").startswith("DECIMAL"), "number").otherwise(F.lower("type"))
    return entries.select("event_id", "key", kind.alias("kind"), "value", "size")


@query("""SELECT event_type, count(*) FILTER (json_exists(props, '$.k')) AS with_k, count(*) FILTER (json_exists(props, '$.k') AND json_exists(props, '$.zzz')) AS with_both, count(*) FILTER (json_exists(props, '$.k') OR json_exists(props, '$.zzz')) AS with_any FROM events GROUP BY 1""")
def arr05_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an object has a key, all of some keys, or any of them."""
    has = lambda k: F.array_contains(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")), k)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(has("k")).alias("with_k"), F.count_if(has("k") & has("zzz")).alias("with_both"), F.count_if(has("k") | has("zzz")).alias("with_any"))


@query("""SELECT * FROM (SELECT event_id AS id, ts AS "at", CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, 'event' AS origin FROM events WHERE event_type IN ('error', 'signup') UNION ALL SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' THEN 'warning' ELSE 'info' END, 'order' FROM orders)
WHERE level <> 'info' ORDER BY "at" DESC, origin, id LIMIT 200""")
def ops03_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest lines of two logs above the asked level."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit("error").alias("level"), F.lit("event").alias("origin"))
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("warning").alias("level"), F.lit("order").alias("origin"))
    return e.unionByName(o).orderBy(F.desc("at"), "origin", "id").limit(200)


@query("""WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS stage, l_linestatus AS state, l_shipdate AS began, l_receiptdate AS ended FROM lineitem) SELECT run_id, count(*) AS stages, string_agg(stage || ':' || state, ',' ORDER BY stage, state) AS states, min(stage) FILTER (state <> 'F') AS open_at,
  date_diff('day', min(began)::DATE, max(ended)::DATE) AS days FROM s GROUP BY run_id""".replace("l_receiptdate", "l_shipdate"))
def ops03_run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's stages in order with their states, the first that isn't over, and the days that it took."""
    s = F.struct("l_linenumber", "l_linestatus")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count("*").alias("stages"), F.array_sort(F.collect_list(s)).alias("s"), F.min(F.when(F.col("l_linestatus") != "F", F.col("l_linenumber"))).alias("open_at"), F.datediff(F.max(F.to_date("l_shipdate")), F.min(F.to_date("l_shipdate"))).alias("days"))
    return g.select("run_id", "stages", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_linestatus"])), ",").alias("states"), "open_at", "days")


@query(f"""WITH {MOVES_SQL}, r AS (SELECT event_id, count(*) FILTER (missing_reason IS NULL) AS reactions, round(max(abs(target - baseline)) FILTER (missing_reason IS NULL), 6) AS largest FROM moves GROUP BY 1),
a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 95) SELECT e.event_id, e.ts, e.value >= 90 AS flagged, coalesce(reactions, 0) AS reactions, largest, a.user_id IS NOT NULL AS has_atom
FROM events e LEFT JOIN r ON r.event_id = e.event_id LEFT JOIN a ON a.user_id = e.user_id WHERE e.event_type = 'signup'""")
def ops09_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed events with what followed them: reactions, flags, and whether their entity has an atom."""
    events = table(spark, sf_dir, "events")
    known = F.col("missing_reason").isNull()
    r = moves(spark, sf_dir).groupBy("event_id").agg(F.count_if(known).alias("n"), F.round(F.max(F.when(known, F.abs(F.col("target") - F.col("baseline")))), 6).alias("largest"))
    atoms = events.filter("event_type = 'view' and value > 95").select("user_id", F.lit(True).alias("atom")).distinct()
    e = events.filter("event_type = 'signup'").join(r, "event_id", "left").join(atoms, "user_id", "left")
    return e.select("event_id", "ts", (F.col("value") >= 90).alias("flagged"), F.coalesce("n", F.lit(0)).alias("reactions"), "largest", F.col("atom").isNotNull().alias("has_atom"))


@query("""WITH c AS (SELECT o_custkey AS claim, date_trunc('month', o_orderdate) AS briefing, max(o_orderstatus) AS verdict FROM orders WHERE o_orderdate >= TIMESTAMP '1998-05-01' AND o_orderdate < TIMESTAMP '1998-07-01' GROUP BY ALL),
b AS (SELECT claim, any_value(verdict) FILTER (briefing = TIMESTAMP '1998-05-01') AS old, any_value(verdict) FILTER (briefing = TIMESTAMP '1998-06-01') AS new FROM c GROUP BY 1)
SELECT CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'dropped' WHEN old <> new THEN 'changed' ELSE 'kept' END AS delta, count(*) AS claims FROM b GROUP BY 1""")
def ops10_briefing_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a briefing adds to the one before it, drops and changes: one aggregate over both."""
    month = F.month("o_orderdate")
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ'1998-05-01' and o_orderdate < TIMESTAMP_NTZ'1998-07-01'")
    b = o.groupBy("o_custkey").agg(F.max(F.when(month == 5, F.col("o_orderstatus"))).alias("old"), F.max(F.when(month == 6, F.col("o_orderstatus"))).alias("new"))
    delta = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(F.col("old") != F.col("new"), "changed").otherwise("kept")
    return b.groupBy(delta.alias("delta")).agg(F.count("*").alias("claims"))


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS first_at FROM orders GROUP BY 1) SELECT year(first_at) AS cohort, (date_diff('month', first_at, o_orderdate) // 12) AS age, count(DISTINCT o_custkey) AS live, count(*) AS evidence FROM orders JOIN f USING (o_custkey) GROUP BY ALL""")
def res09_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by the year they began and their age in years: how many are live, and their evidence."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"))
    months = (F.year("o_orderdate") - F.year("first_at")) * 12 + F.month("o_orderdate") - F.month("first_at")
    g = o.join(first, "o_custkey").groupBy(F.year("first_at").alias("cohort"), F.floor(months / 12).alias("age"))
    return g.agg(F.countDistinct("o_custkey").alias("live"), F.count("*").alias("evidence"))


@query("""WITH v AS (SELECT user_id AS market, event_id AS version, ts, CASE WHEN value > 66 THEN 'up' WHEN value > 33 THEN 'flat' ELSE 'down' END AS driver FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts DESC, version DESC) AS rn, lead(driver) OVER (PARTITION BY market ORDER BY ts DESC, version DESC) AS prior FROM v)
SELECT market, version, driver, prior, coalesce(prior <> driver, true) AS changed FROM r WHERE rn = 1""")
def res10_market_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver of each market that nothing supersedes, and whether it differs from the one before: the two newest rows of a key."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("market"), F.col("event_id").alias("version"), "ts", F.when(v > 66, "up").when(v > 33, "flat").otherwise("down").alias("driver"))
    two = keys.top_n(e, ["market"], [F.desc("ts"), F.desc("version")], 2)
    g = two.groupBy("market").agg(F.max_by("version", F.struct("ts", "version")).alias("version"), F.max_by("driver", F.struct("ts", "version")).alias("driver"), F.min_by("driver", F.struct("ts", "version")).alias("older"), F.count("*").alias("n"))
    prior = F.when(F.col("n") > 1, F.col("older"))
    return g.select("market", "version", "driver", prior.alias("prior"), F.coalesce(prior != F.col("driver"), F.lit(True)).alias("changed"))


@query("""WITH v AS (SELECT o_custkey AS thesis_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1), e AS (SELECT o_custkey AS thesis_id, count(*) FILTER (l_returnflag = 'A') AS supports, count(*) FILTER (l_returnflag = 'R') AS contradicts, count(*) FILTER (l_returnflag = 'N') AS context FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_nationkey AS theme, c_custkey AS thesis_id, version, coalesce(supports, 0) AS supports, coalesce(contradicts, 0) AS contradicts, coalesce(context, 0) AS context FROM customer LEFT JOIN v ON v.thesis_id = c_custkey LEFT JOIN e ON e.thesis_id = c_custkey""")
def res18_theme_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theme's theses with their latest version and counts of evidence by its bearing; lines are counted by order first."""
    flag = F.col("l_returnflag")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(flag == "A").alias("a"), F.count_if(flag == "R").alias("r"), F.count_if(flag == "N").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("thesis_id"))
    g = o.agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version"), *[F.sum(c).alias(c) for c in ("a", "r", "n")])
    out = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("theme"), F.col("c_custkey").alias("thesis_id")).join(g, "thesis_id", "left")
    return out.select("theme", "thesis_id", "version", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("a", "supports"), ("r", "contradicts"), ("n", "context"))])


@query("""SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL""")
def stm08_ingestion_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.coalesce_jobs(table(spark, sf_dir, "events"), ["event_type"], "ts", 15)


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def stm11_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that change what is known of a key; repeats of the same content go."""
    return research.changed_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


_MINUTES_SQL = "(SELECT begun + CASE WHEN open THEN greatest(0, least(hour({t}) * 60 + minute({t}) + second({t}) / 60.0, 960) - 570) ELSE 0 END FROM calendar WHERE day = {t}::DATE)"


@query(f"""WITH {MOVES_SQL}, {CALENDAR_SQL}, one AS (SELECT DISTINCT event_id, symbol, ts, baseline_at FROM moves), spent AS (SELECT event_id, symbol, {_MINUTES_SQL.format(t="ts")} AS at_event, {_MINUTES_SQL.format(t="baseline_at")} AS at_baseline FROM one)
SELECT event_id, symbol, round(at_event - at_baseline, 6) AS trading_minutes, coalesce(at_event - at_baseline > 30, false) AS stale FROM spent""")
def rxn04_stale_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = reaction.sessions(spark, dt.date(2023, 12, 1), dt.date(2024, 3, 1))
    b = moves(spark, sf_dir).select("event_id", "symbol", "ts", "baseline_at").distinct()
    m = research.trading_minutes(calendar, research.trading_minutes(calendar, b, "ts", "at_event"), "baseline_at", "at_baseline")
    return m.select("event_id", "symbol", F.round(F.col("at_event") - F.col("at_baseline"), 6).alias("trading_minutes"), research.stale_baseline(F.col("at_event"), F.col("at_baseline"), 30).alias("stale"))


@query(f"""WITH {CALENDAR_SQL}, e AS (SELECT event_id, ts FROM events WHERE event_type = 'signup'), c AS (SELECT day + INTERVAL 16 HOUR AS close FROM calendar WHERE open) SELECT event_id, min(close) AS target FROM e JOIN c ON close > ts AND close <= ts + INTERVAL 8 DAY GROUP BY 1""")
def rxn02_session_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close of the session that an event falls in, else of the next one: closes are looked up by the event's day."""
    calendar = reaction.sessions(spark, dt.date(2023, 12, 1), dt.date(2024, 3, 1))
    return reaction.session_close_after(calendar, table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", "ts"), "ts").select("event_id", "target")
