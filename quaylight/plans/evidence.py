"""Evidence, filings, relationships, late and pending rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions import text
from quaylight.operators import evidence
from quaylight.plans.base import TICKS_SQL, query, table, ticks
from quaylight.plans.texts import STOP

WORDS_SQL = f"list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({STOP}) AND NOT regexp_full_match(w, '[0-9]+'))"
GROUPS_SQL = f"""it AS (SELECT id, md5(title) AS origin, id % 3 = 0 AS claim, coalesce(source, '') AS source, CASE WHEN id % 5 = 0 THEN 'story:s' || (id // 7 % 40) END AS story, 'entity:concept:' || lang AS entity, {WORDS_SQL} AS terms
  FROM (SELECT doc_id AS id, source, lang, string_split(text, chr(10))[1] AS title FROM documents WHERE text IS NOT NULL)),
w AS (SELECT DISTINCT id, origin, 'term' AS kind, 'term:' || unnest(terms) AS key FROM it UNION SELECT id, origin, 'phrase', unnest(list_filter(list_transform(terms[:-2], lambda x, i: CASE WHEN x <> terms[i + 1] THEN 'phrase:' || x || '-' || terms[i + 1] END), lambda y: y IS NOT NULL)) FROM it),
fr AS (SELECT key FROM (SELECT kind, key, count(DISTINCT origin) AS n FROM w GROUP BY ALL HAVING count(DISTINCT origin) >= 2) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) <= 120),
k AS (SELECT id, key FROM w WHERE key IN (SELECT key FROM fr) UNION SELECT id, story FROM it WHERE story IS NOT NULL UNION SELECT id, entity FROM it WHERE entity IS NOT NULL),
k20 AS (SELECT id, key FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY key) <= 20),
one AS (SELECT key, origin, id, source FROM k20 JOIN it USING (id) QUALIFY row_number() OVER (PARTITION BY key, origin ORDER BY claim, id) = 1),
kept AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) <= 20),
g AS (SELECT key, count(*) AS items, count(DISTINCT source) AS sources, max(id) AS latest, list(origin) AS origins, array_to_string(list_sort(list(id)), ',') AS ids, string_split(key, ':')[1] AS kind FROM kept GROUP BY key HAVING count(*) >= 3 AND count(DISTINCT source) >= 2),
r AS (SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'story' THEN 5 WHEN 'entity' THEN 4 WHEN 'industry' THEN 3 WHEN 'phrase' THEN 2 ELSE 1 END DESC, sources DESC, CASE WHEN kind IN ('term', 'phrase') THEN -items ELSE items END DESC, latest DESC, key DESC) AS place FROM g)"""


@query(f"WITH {GROUPS_SQL} SELECT key, ids, items, sources, latest FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.place < a.place AND list_has_all(b.origins, a.origins))")
def res02_candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, k = F.substring_index("text", "\n", 1), F.col("doc_id")
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) >= 4) & ~w.isin(*text.STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    items = table(spark, sf_dir, "documents").filter("text is not null").select(
        k.alias("id"), F.md5(title).alias("origin"), (k % 3 == 0).alias("is_claim"), k.alias("at"), F.coalesce("source", F.lit("")).alias("source"), F.when(k % 5 == 0, F.concat(F.lit("S"), F.floor(k / 7) % 40)).alias("story"),
        F.array_compact(F.array(F.concat(F.lit("concept:"), "lang"))).alias("entities"), F.array().cast("array<string>").alias("industries"), words.alias("terms"),
    )
    return evidence.candidate_groups(items, 3, 2).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""WITH refs AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'order:' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'customer:' || o_custkey ELSE 'lost:' || o_orderkey END AS ref FROM orders WHERE o_orderkey % 100 = 0),
ev AS (SELECT 'order' AS kind, o_orderkey || '' AS id, o_orderdate AS available_at FROM orders UNION ALL SELECT 'customer', o_custkey || '', min(o_orderdate) FROM orders GROUP BY ALL)
SELECT kind, id, available_at FROM ev WHERE kind || ':' || id IN (SELECT ref FROM refs) AND available_at <= TIMESTAMP '1996-06-30'""")
def res16_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ref = F.when(k % 3 == 0, F.concat(F.lit("order:"), k)).when(k % 3 == 1, F.concat(F.lit("customer:"), "o_custkey")).otherwise(F.concat(F.lit("lost:"), k))
    known = o.select(F.lit("order").alias("kind"), k.cast("string").alias("id"), F.col("o_orderdate").alias("available_at"))
    known = known.unionByName(o.groupBy(F.lit("customer").alias("kind"), F.col("o_custkey").cast("string").alias("id")).agg(F.min("o_orderdate").alias("available_at")))
    return evidence.evidence_by_reference(o.filter("o_orderkey % 100 = 0").select(ref.alias("ref")), known, F.lit("1996-06-30").cast("timestamp_ntz"))


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, o_orderdate, o_orderkey FROM orders QUALIFY place <= 5""")
def ops11_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.lineage(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate", ["o_orderkey"], 5)


def _sections_sql() -> str:
    """A row for each document and category, from the same patterns as the operator's."""
    any_ = "(?i)" + "|".join(evidence.SECTIONS.values()).replace("'", "''")
    parts = []
    for category, pattern in evidence.SECTIONS.items():
        p = "(?i)" + pattern.replace("'", "''")
        rest = f"substr(t, length(string_split_regex(t, '{p}')[1]) + length(regexp_extract(t, '{p}')) + 1)"
        parts.append(f"SELECT document_id, '{category}' AS category, lower(trim(regexp_replace(string_split_regex({rest}, '{any_}')[1], '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS body FROM filings WHERE regexp_matches(t, '{p}')")
    return " UNION ALL ".join(parts)


FILINGS_SQL = r"""filings AS (SELECT doc_id AS document_id, source AS company, lang AS document_type, doc_id // 40 AS report_date, doc_id % 40 AS created_at,
  'Intro' || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || 'OUTLOOK: ' || text ELSE '' END || chr(10) || 'Risk factors and ' || coalesce(source, '') || ' 4.5 %' || CASE WHEN doc_id % 2 = 0 THEN ' Dividend of ' || (doc_id // 80) || '%' ELSE '' END AS t FROM documents)"""
DELTAS_SQL = f"""WITH {FILINGS_SQL}, parts AS ({_sections_sql()}), days AS (SELECT company, document_type, report_date, arg_max(document_id, created_at) AS last_id FROM filings GROUP BY ALL),
lagged AS (SELECT *, lag(last_id) OVER (PARTITION BY company, document_type ORDER BY report_date) AS previous_id FROM days),
b AS (SELECT document_id, previous_id FROM filings f LEFT JOIN lagged l ON f.company IS NOT DISTINCT FROM l.company AND f.document_type IS NOT DISTINCT FROM l.document_type AND f.report_date = l.report_date),
o AS (SELECT b.document_id, category, body AS old FROM b JOIN parts p ON p.document_id = previous_id), j AS (SELECT document_id, category, body, old FROM parts FULL JOIN o USING (document_id, category)),
s AS (SELECT *, string_split(body, ' ') AS x, string_split(old, ' ') AS y FROM j),
d AS (SELECT *, list_distinct(list_transform(x, lambda w, i: w || coalesce(' ' || x[i + 1], ''))) AS xs, list_distinct(list_transform(y, lambda w, i: w || coalesce(' ' || y[i + 1], ''))) AS ys FROM s)
SELECT document_id, previous_id, category, CASE WHEN body IS NULL THEN 'removed' WHEN old IS NULL THEN 'new' WHEN old = body THEN 'unchanged' WHEN 2 * len(list_intersect(xs, ys)) / (len(xs) + len(ys)) >= 0.98 THEN 'unchanged' ELSE 'changed' END AS change,
  sha256(body) AS hash, sha256(old) AS previous_hash, coalesce(array_to_string(regexp_extract_all(body, '\\d+(?:\\.\\d+)?\\s?%'), ','), '') AS percents FROM d JOIN b USING (document_id)""".replace("\\\\", "\\")


@query(DELTAS_SQL)
def inv08_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    outlook = F.when(k % 3 != 0, F.concat(F.lit("\nOUTLOOK: "), "text")).when(k % 3 == 0, "")
    body = F.concat(F.lit("Intro"), outlook, F.lit("\nRisk factors and "), F.coalesce("source", F.lit("")), F.lit(" 4.5 %"), F.when(k % 2 == 0, F.concat(F.lit(" Dividend of "), F.floor(k / 80), F.lit("%"))).otherwise(""))
    filings = table(spark, sf_dir, "documents").select(k.alias("document_id"), F.col("source").alias("company"), F.col("lang").alias("document_type"), F.floor(k / 40).alias("report_date"), (k % 40).alias("created_at"), body.alias("text"))
    return evidence.filing_deltas(filings).drop("excerpt").withColumn("percents", F.array_join("percents", ","))


#: Headings and keywords of the made-up prose, in place of a filing's.
HEADINGS = [(3, "^ *(the|die) "), (2, "^ *(la|is) "), (-1, "^ *(es|it) ")]
KEYWORDS = " (und|and|que) "
EXCERPT_SQL = r"""WITH l AS (SELECT doc_id, length(text) AS size, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE length(text) > 0),
m AS (SELECT *, length(line) + 1 AS len, CASE WHEN trim(line) = '' OR length(ltrim(line)) > 120 THEN NULL WHEN regexp_matches(line, '(?i)^ *(the|die) ') THEN 3 WHEN regexp_matches(line, '(?i)^ *(la|is) ') THEN 2 WHEN regexp_matches(line, '(?i)^ *(es|it) ') THEN -1 END AS marker,
  len(regexp_extract_all(line, '(?i) (und|and|que) ')) AS hits FROM l),
s AS (SELECT *, sum(len) OVER w AS b, count(marker) OVER w AS section, coalesce(last_value(marker IGNORE NULLS) OVER w, 1) AS tier FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), t AS (SELECT *, b - len AS a FROM s),
u AS (SELECT *, min(a) OVER p AS top, tier * 100000 + least(sum(hits) OVER p, 100) AS quality, max(CASE WHEN hits > 0 THEN b END) OVER (PARTITION BY doc_id, section ORDER BY n) AS last_hit, min(CASE WHEN hits > 0 THEN a END) OVER (PARTITION BY doc_id, section ORDER BY n DESC) AS next_hit FROM t WINDOW p AS (PARTITION BY doc_id, section)),
v AS (SELECT *, CASE WHEN tier >= 2 AND a - top < 300 THEN 0 ELSE 10000000 - quality END AS phase FROM u WHERE size <= 1500 OR (tier >= 2 AND a - top < 300) OR coalesce(a - last_hit <= 200, false) OR coalesce(next_hit - b <= 100, false)),
x AS (SELECT * FROM (SELECT *, sum(len) OVER (PARTITION BY doc_id, section ORDER BY phase, n) AS spent FROM v) WHERE size <= 1500 OR spent <= 700),
y AS (SELECT * FROM (SELECT * EXCLUDE (spent), sum(len) OVER (PARTITION BY doc_id ORDER BY phase, n) AS spent FROM x) WHERE size <= 1500 OR spent <= 1500),
z AS (SELECT *, CASE WHEN a > lag(b) OVER (PARTITION BY doc_id ORDER BY n) + 300 THEN 1 ELSE 0 END AS fresh FROM y), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM z)
SELECT doc_id, min(a) AS a, least(max(b), max(size)) AS b FROM i GROUP BY doc_id, island"""


@query(EXCERPT_SQL)
def inv20_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.excerpts(table(spark, sf_dir, "documents"), HEADINGS, KEYWORDS, budget=1500, before=100, after=200, head=300, section_budget=700)


@query("""WITH f AS (SELECT c_custkey AS k, round(c_acctbal)::BIGINT || '' AS v FROM customer)
SELECT k AS company, 'rel:top_bottom:revenue:FY2024:' || CASE WHEN k % 2 = 0 THEN v ELSE '10' END || ':net_income:FY2024:' || k AS relationship_id, 'same_period_top_bottom_growth' AS kind, 1 AS priority FROM f WHERE k % 3 <> 0
UNION ALL SELECT k, 'rel:cash_gen:operating_cash_flow:FY2024:' || v || ':capex:FY2024:' || CASE WHEN k % 5 = 0 THEN '7' ELSE '5' END, 'cash_generation_vs_investment', 2 FROM f WHERE k % 4 <> 0
UNION ALL SELECT k, 'rel:ext:tariff:FY2024:' || v, 'external_effect_on_recipient', 3 FROM f WHERE k % 6 = 0""")
def inv06_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's balance stands for its figures; some lack one or have a second-best one only."""
    k, v = F.col("c_custkey"), F.round("c_acctbal").cast("long").cast("string")
    fact = lambda metric, value, role=None: F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value"), F.lit(role).cast("string").alias("role"))
    rows = F.array(
        fact("revenue_growth", F.when(k % 2 == 0, v)), fact("revenue", F.lit(10)), fact("net_income", F.when(k % 3 != 0, k)), fact("operating_cash_flow", v), fact("capex", F.when((k % 4 != 0) & (k % 5 != 0), 5)),
        fact("cash_paid_for_property_and_equipment", F.when(k % 4 != 0, 7)), fact("tariff", F.when(k % 6 == 0, v), "external_effect"),
    )
    facts = table(spark, sf_dir, "customer").select(k.alias("company"), F.lit("FY2024").alias("period"), F.explode(rows).alias("f")).select("company", "period", "f.*")
    return evidence.relationships(facts)


@query(f"""WITH {TICKS_SQL}, h AS (SELECT symbol, date_trunc('hour', ts) AS hour, close, event_id % 10 = 3 AS late FROM ticks), t AS (SELECT DISTINCT symbol, hour FROM h WHERE late AND hour >= TIMESTAMP '2024-01-10')
SELECT symbol, hour, max(close) AS high, count(*) AS n FROM h WHERE NOT late OR (symbol, hour) IN (SELECT (symbol, hour) FROM t) GROUP BY ALL""")
def stm02_late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that come late change the bars inside the refresh window and no older one."""
    t = ticks(spark, sf_dir).select("event_id", "symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "close")
    late, aggregates = F.col("event_id") % 10 == 3, [F.max("close").alias("high"), F.count("*").alias("n")]
    bars = t.filter(~late).groupBy("symbol", "hour").agg(*aggregates)
    return evidence.refresh_buckets(bars, t, t.filter(late), ["symbol"], "hour", aggregates, F.lit("2024-01-10").cast("timestamp_ntz"))


@query(f"""WITH {TICKS_SQL}, w AS (SELECT event_id, symbol, ts + INTERVAL 1 HOUR AS target_at FROM ticks WHERE event_id % 100 = 0),
f AS (SELECT w.event_id, symbol, target_at, arg_max(close, (ts, close)) AS price FROM w JOIN ticks t USING (symbol) WHERE t.ts <= target_at AND t.ts >= target_at - INTERVAL 30 MINUTE AND target_at <= TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT event_id, symbol, target_at, CASE WHEN price IS NULL THEN 'pending' ELSE 'resolved' END AS status, price FROM w LEFT JOIN f USING (event_id, symbol, target_at)""")
def stm04_pending_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polls: what is due at the first is resolved then; the second takes the rest that is due by its time."""
    t = ticks(spark, sf_dir)
    windows = t.filter("event_id % 100 = 0").select("event_id", "symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("target_at"), F.lit("pending").alias("status"), F.lit(None).cast("double").alias("price"))
    for day in ("2024-01-10", "2024-01-20"):
        windows = evidence.resolve_due(windows, t, ["symbol"], F.lit(day).cast("timestamp_ntz"), 1800)
    return windows
