"""Company reports: written as tagged pages and as statements from the driver's tables, read back as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.operators import facts
from quaylight.plans.base import query, table
from quaylight.plans.files import written

#: Of each supplier the latest two years: sales, units and lines.
YEARS_SQL = """totals AS (SELECT l_suppkey AS company, year(l_shipdate) AS y, floor(sum(CAST(l_extendedprice AS DECIMAL(18, 2))))::BIGINT AS sales, sum(l_quantity)::BIGINT AS units, count(*) AS n FROM lineitem GROUP BY ALL),
years AS (SELECT *, CASE nth WHEN 1 THEN 'current' ELSE 'prior' END AS which FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY y DESC) AS nth FROM totals) WHERE nth <= 2)"""
TAGGED_SQL = YEARS_SQL + """, plain AS (
  SELECT company, which, y, 'revenue' AS metric, sales / 1000000.0::DOUBLE AS value, 'GBPm' AS unit, 'uk-gaap:Turnover' AS concept, true AS flow FROM years
  UNION ALL SELECT company, which, y, 'gross_profit', n * 1000.0::DOUBLE / 1000000.0::DOUBLE, 'GBPm', 'ifrs-full:GrossProfit', true FROM years
  UNION ALL SELECT company, which, y, 'net_income', CASE WHEN company % 3 = 0 THEN -units ELSE units END::DOUBLE, 'GBPm', 'ifrs-full:ProfitLoss', true FROM years
  UNION ALL SELECT company, which, y, 'operating_cash_flow', 2.0::DOUBLE * units, 'GBPm', 'us-gaap:NetCashProvidedByUsedInOperatingActivities', true FROM years
  UNION ALL SELECT company, which, y, 'capex', n::DOUBLE, 'GBPm', 'ifrs-full:PurchaseOfPropertyPlantAndEquipment', true FROM years
  UNION ALL SELECT company, which, y, 'diluted_eps', 1.25::DOUBLE, 'GBP/share', 'us-gaap:EarningsPerShareDiluted', true FROM years
  UNION ALL SELECT company, which, y, 'total_assets', sales / 1000000.0::DOUBLE, 'GBPm', 'ifrs-full:Assets', false FROM years WHERE company % 5 <> 0
  UNION ALL SELECT company, which, y, 'cash', units::DOUBLE, 'GBPm', 'ifrs-full:CashAndCashEquivalents', false FROM years
  UNION ALL SELECT company, which, y, 'total_debt', n::DOUBLE, 'GBPm', 'ifrs-full:Borrowings', false FROM years),
tagged AS (SELECT company, which, metric, value, unit, y || '-12-31' AS period, 'tagged' AS source, concept, 'consolidated' AS scope, CASE WHEN flow THEN 364 + (y % 4 = 0)::INT END AS duration_days FROM plain
  UNION ALL SELECT company, which, 'gross_margin', 100 * ((n * 1000.0::DOUBLE / 1000000.0::DOUBLE) / (sales / 1000000.0::DOUBLE)), 'percent', y || '-12-31', 'derived_tagged', 'derived:gross_profit/revenue', 'consolidated', 364 + (y % 4 = 0)::INT FROM years WHERE sales <> 0
  UNION ALL SELECT company, which, 'net_debt', n::DOUBLE - units, 'GBPm', y || '-12-31', 'derived_tagged', 'derived:debt-cash', 'consolidated', NULL FROM years
  UNION ALL SELECT company, which, 'free_cash_flow', 2.0::DOUBLE * units - n, 'GBPm', y || '-12-31', 'derived_tagged', 'derived:operating_cash_flow-capex', 'consolidated', 364 + (y % 4 = 0)::INT FROM years)"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    totals = lines.groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("y")).agg(
        F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("sales"), F.sum("l_quantity").cast("long").alias("units"), F.count("*").alias("n")
    )
    return totals.withColumn("nth", F.row_number().over(Window.partitionBy("company").orderBy(F.col("y").desc()))).filter("nth <= 2")


def _tag(concept: str, context: str, shown: Column, scale: int = 0, unit: str = "GBP", sign: Column | None = None) -> Column:
    minus = F.lit("") if sign is None else F.when(sign, ' sign="-"').otherwise("")
    return F.concat(F.lit(f'<p>A figure: <ix:nonFraction name="{concept}" contextRef="{context}'), "y", F.lit(f'" unitRef="{unit}" scale="{scale}"'), minus, F.lit(">"), shown, F.lit("</ix:nonFraction></p>"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company, markup``: one tagged page a supplier, with facts that must not count among those that do."""
    k, y = F.col("company"), F.col("y").cast("string")
    number = lambda c: F.format_number(c, 0)
    period = lambda a, b: F.concat(F.lit("<xbrli:period><xbrli:startDate>"), y, F.lit(f"-{a}</xbrli:startDate><xbrli:endDate>"), y, F.lit(f"-{b}</xbrli:endDate></xbrli:period>"))
    context = lambda name, body, more="": F.concat(F.lit(f"<xbrli:context id='{name}"), y, F.lit(f"'><xbrli:entity>{more}</xbrli:entity>"), body, F.lit("</xbrli:context>"))
    instant = F.concat(F.lit("<xbrli:period><xbrli:instant> "), y, F.lit("-12-31 </xbrli:instant></xbrli:period>"))
    parts = [
        context("c", period("01-01", "12-31")), context("i", instant), context("q", period("10-01", "12-31")), context("m", period("01-01", "12-31"), '<xbrldi:explicitMember dimension="d">x</xbrldi:explicitMember>'),
        _tag("uk-gaap:Turnover", "c", number("sales")), _tag("custom:Turnover", "c", F.lit("999"), 6), _tag("uk-gaap:Turnover", "q", F.lit("1")), _tag("uk-gaap:Turnover", "m", F.lit("2")),
        _tag("ifrs-full:GrossProfit", "c", number("n"), 3), _tag("ifrs-full:ProfitLoss", "c", number("units"), 6, sign=k % 3 == 0), F.lit("<!--"), _tag("ifrs-full:Inventories", "i", F.lit("5")), F.lit("-->"),
        _tag("us-gaap:NetCashProvidedByUsedInOperatingActivities", "c", number(2 * F.col("units")), 6), _tag("ifrs-full:PurchaseOfPropertyPlantAndEquipment", "c", number("n"), 6),
        _tag("us-gaap:EarningsPerShareDiluted", "c", F.lit("1.25"), unit="EPS"), _tag("ifrs-full:Assets", "i", number("sales")), F.when(k % 5 == 0, _tag("ifrs-full:Assets", "i", number(F.col("sales") + 1))).otherwise(""),
        _tag("ifrs-full:CashAndCashEquivalents", "i", number("units"), 6), _tag("ifrs-full:Borrowings", "i", number("n"), 6), _tag("ifrs-full:Equity", "i", F.lit("—")), _tag("ifrs-full:Liabilities", "c", F.lit("7")),
    ]
    units = "<xbrli:unit id='GBP'><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><xbrli:unit id='EPS'><xbrli:divide><xbrli:measure>iso4217:GBP</xbrli:measure><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:divide></xbrli:unit>"
    body = _years(spark, sf_dir).groupBy("company").agg(F.array_join(F.collect_list(F.concat(*parts)), "\n").alias("body"))
    return body.select("company", F.concat(F.lit(f"<html>{units}"), "body", F.lit("</html>")).alias("markup"))


def _statements(spark: SparkSession, sf_dir: str, sales: Column) -> DataFrame:
    """``company, text``: a layout text with two columns for each supplier with two years; ``sales``: the figure shown, by year."""
    both = _years(spark, sf_dir).withColumn("shown", sales).groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("nth", F.struct("y", "shown", "units", "n")))).alias("by")).filter("size(by) = 2")
    cell = lambda nth, name: F.col("by")[nth][name]
    show = lambda c: F.format_number(c, 0)
    row = lambda label, a, b: F.concat(F.rpad(F.lit(label), 52, " "), F.lpad(a, 16, " "), F.lpad(b, 16, " "))
    loss = lambda c: F.when(F.col("company") % 3 == 0, F.concat(F.lit("("), c, F.lit(")"))).otherwise(c)
    figures = lambda label, name, how=lambda c: c, factor=1: row(label, how(show(cell(1, name) * factor)), how(show(cell(2, name) * factor)))
    lines = [
        F.concat(F.lit("Annual report of company "), "company"), F.lit("Revenue   1   2"), F.lit("CONSOLIDATED INCOME STATEMENT"), row("£ thousand                            Note", cell(1, "y").cast("string"), cell(2, "y").cast("string")),
        figures("Revenue                                   2", "shown"), figures("Gross profit", "n"), figures("Profit for the year", "units", loss, 1000), figures("Sundry income", "n"), F.lit("Total equity        see note 5"),
        F.lit("Consolidated Cash Flow Statement:"), figures("Net cash from operating activities:", "units", lambda c: c, 2000), figures("Expenditure on property, plant and equipment    14", "n", lambda c: F.concat(F.lit("("), c, F.lit(")"))),
    ]
    return both.select("company", F.array_join(F.array(*lines), "\r\n").alias("text"))


STATEMENT_SQL = """two AS (SELECT a.company, a.y AS y1, b.y AS y2, a.sales AS s1, b.sales AS s2, a.units AS u1, b.units AS u2, a.n AS n1, b.n AS n2 FROM years a JOIN years b ON a.company = b.company AND a.nth = 1 AND b.nth = 2),
shown AS (SELECT company, y1, y2, 'revenue' AS metric, 'revenue' AS label, ({0})::DOUBLE * 0.001::DOUBLE AS v1, ({1})::DOUBLE * 0.001::DOUBLE AS v2 FROM two
  UNION ALL SELECT company, y1, y2, 'gross_profit', 'gross profit', n1::DOUBLE * 0.001::DOUBLE, n2::DOUBLE * 0.001::DOUBLE FROM two
  UNION ALL SELECT company, y1, y2, 'net_income', 'profit for the year', CASE WHEN company % 3 = 0 THEN -1 ELSE 1 END * (1000 * u1)::DOUBLE * 0.001::DOUBLE, CASE WHEN company % 3 = 0 THEN -1 ELSE 1 END * (1000 * u2)::DOUBLE * 0.001::DOUBLE FROM two
  UNION ALL SELECT company, y1, y2, 'operating_cash_flow', 'net cash from operating activities', (2000 * u1)::DOUBLE * 0.001::DOUBLE, (2000 * u2)::DOUBLE * 0.001::DOUBLE FROM two
  UNION ALL SELECT company, y1, y2, 'capex', 'expenditure on property, plant and equipment', n1::DOUBLE * 0.001::DOUBLE, n2::DOUBLE * 0.001::DOUBLE FROM two),
steady AS (SELECT * FROM shown WHERE metric NOT IN ('revenue', 'gross_profit') OR v1 = 0 OR v2 = 0 OR v1 / v2 BETWEEN 1.0::DOUBLE / 3 AND 3),
said AS (SELECT company, 'current' AS which, metric, v1 AS value, y1 AS y, label FROM steady UNION ALL SELECT company, 'prior', metric, v2, y2, label FROM steady),
statement AS (SELECT company, which, metric, value, 'GBPm' AS unit, y || '' AS period, 'statement' AS source, 'text:' || label AS concept, 'consolidated' AS scope, NULL::INT AS duration_days FROM said
  UNION ALL SELECT g.company, g.which, 'gross_margin', 100 * (g.value / r.value), 'percent', g.y || '', 'derived_statement', 'derived:gross_profit/revenue', 'consolidated', NULL FROM said g JOIN said r ON g.company = r.company AND g.which = r.which AND g.metric = 'gross_profit' AND r.metric = 'revenue' WHERE r.value <> 0
  UNION ALL SELECT o.company, o.which, 'free_cash_flow', o.value - abs(c.value), 'GBPm', o.y || '', 'derived_statement', 'derived:operating_cash_flow-capex', 'consolidated', NULL FROM said o JOIN said c ON o.company = c.company AND o.which = c.which AND o.metric = 'operating_cash_flow' AND c.metric = 'capex')"""
#: The latest year of a report, less one.
LAST_YEAR = 2099


@query(f"WITH {TAGGED_SQL} SELECT * FROM tagged")
def src20_tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts tagged inside pages: contexts, units, scale and sign; parts of years, members, own concepts, torn facts and comments don't count."""
    path = written(spark, "src20_pages", _pages(spark, sf_dir), "json")
    return facts.tagged_facts(spark.read.schema("company long, markup string").json(path), "company", "markup")


@query(f"WITH {YEARS_SQL}, {STATEMENT_SQL.format('s1', 's2')} SELECT * FROM statement")
def inv07_statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read off the two columns of layout texts."""
    path = written(spark, "inv07_texts", _statements(spark, sf_dir, F.col("sales")), "json")
    return facts.statement_facts(spark.read.schema("company long, text string").json(path), LAST_YEAR, "company", "text")


@query(f"""WITH {TAGGED_SQL}, {STATEMENT_SQL.format("s1", "s2")}, own AS (SELECT * FROM tagged WHERE company % 2 = 0), has AS (SELECT DISTINCT company FROM own WHERE which = 'current')
SELECT *, CASE WHEN metric IN ('revenue', 'net_income', 'diluted_eps', 'operating_cash_flow', 'free_cash_flow', 'gross_profit', 'gross_margin') THEN metric WHEN metric = 'capex' THEN 'capital_investment' END AS metric_family,
  CASE WHEN metric IN ('operating_cash_flow', 'free_cash_flow', 'capex') THEN 'cash' WHEN metric IN ('revenue', 'net_income', 'diluted_eps', 'gross_profit', 'gross_margin') THEN 'not_applicable' END AS cash_basis
FROM (SELECT * FROM own UNION ALL SELECT * FROM statement WHERE company NOT IN (SELECT company FROM has))""")
def inv07_document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's first source: its tagged page, which odd ones lack, or its statement; with what a metric says."""
    pages = spark.read.schema("company long, markup string").json(written(spark, "inv07_pages", _pages(spark, sf_dir).filter("company % 2 = 0"), "json"))
    texts = spark.read.schema("company long, text string").json(written(spark, "inv07_texts", _statements(spark, sf_dir, F.col("sales")), "json"))
    found = facts.first_source([facts.tagged_facts(pages, "company"), facts.statement_facts(texts, LAST_YEAR, "company")], "company")
    tags = facts.relationship_tags()
    return found.withColumns({"metric_family": tags["metric_family"], "cash_basis": tags["cash_basis"]})


_OFF = "CASE WHEN company % 4 = 0 THEN {0} + {0} // 10 ELSE {0} END // 1000"


@query(f"""WITH {TAGGED_SQL}, {STATEMENT_SQL.format(_OFF.format("s1"), _OFF.format("s2"))},
every AS (SELECT company, metric, left(period, 4) AS year, source, value, unit FROM tagged UNION ALL SELECT company, metric, period, source, value, unit FROM statement),
ranked AS (SELECT *, row_number() OVER (PARTITION BY company, metric, year ORDER BY CASE source WHEN 'tagged' THEN 0 WHEN 'derived_tagged' THEN 1 WHEN 'statement' THEN 2 ELSE 3 END) AS place FROM every)
SELECT a.company, a.metric, a.year, a.value, a.unit, a.source, 1 + (b.value IS NOT NULL)::INT AS n_sources, CASE WHEN b.unit <> a.unit OR abs(b.value - a.value) > 0.005 * greatest(abs(a.value), abs(b.value)) THEN b.source ELSE '' END AS conflicts
FROM ranked a LEFT JOIN ranked b ON a.company = b.company AND a.metric = b.metric AND a.year = b.year AND b.place = 2 WHERE a.place = 1""")
def inv07_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources of all companies: which one is taken, and which is off by more than 0.5 per cent."""
    shown = F.expr("(if(company % 4 = 0, sales + sales div 10, sales)) div 1000")
    pages = spark.read.schema("company long, markup string").json(written(spark, "inv07_pages", _pages(spark, sf_dir), "json"))
    texts = spark.read.schema("company long, text string").json(written(spark, "inv07_texts", _statements(spark, sf_dir, shown), "json"))
    both = facts.tagged_facts(pages, "company").unionByName(facts.statement_facts(texts, LAST_YEAR, "company"))
    found = facts.reconciled(both.withColumn("year", F.substring("period", 1, 4)), ["company", "metric", "year"], ["tagged", "derived_tagged", "statement", "derived_statement"], 0.005)
    return found.withColumn("conflicts", F.array_join("conflicts", ","))
