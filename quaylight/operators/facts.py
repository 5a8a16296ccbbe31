"""Facts of company reports: tagged inside pages or read off the columns of statements, and what several sources agree on.

Both readers work on whole documents with built-in functions: elements, contexts and lines are exploded into rows, contexts
and units are joined to the facts that name them, and what a line inherits from the lines above it (the statement it is
in, currency and scale) comes from windows over its own document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.numeric import ratio
from quaylight.functions.text import number_pair, report_number

# Names of metrics in tagged reports, best first.
TAGGED = {
    "revenue": ("revenue", "revenues", "turnover", "salesrevenue", "revenuefromcontractwithcustomerexcludingassessedtax"),
    "operating_cash_flow": ("netcashprovidedbyusedinoperatingactivities", "cashflowsfromusedinoperatingactivities", "operatingcashflow", "netcashfromoperatingactivities", "netcashinflowoutflowfromoperatingactivities"),
    "capex": ("paymentstoacquirepropertyplantandequipment", "paymentsforadditionstopropertyplantandequipment", "capitalexpenditure", "purchaseofpropertyplantandequipment"),
    "lease_inclusive_investment": ("capitalexpenditureincludingfinanceleaseadditions", "capitalexpendituresincludingfinanceleaseadditions", "purchasesofpropertyplantandequipmentandfinanceleaseadditions"),
    "net_income": ("netincomeloss", "profitloss", "profitfortheyear", "profitlossattributabletoownersofparent", "profitaftertax"),
    "diluted_eps": ("earningspersharediluted", "dilutedeps", "dilutedearningspershare"),
    "shares_outstanding": ("weightedaveragenumberofdilutedsharesoutstanding", "weightedaveragenumberofshares", "weightedaveragenumberofordinarysharesdiluted", "sharesoutstanding"),
    "inventory": ("inventorynet", "inventory", "inventories"),
    "gross_profit": ("grossprofit", "grossprofitloss"),
    "cash": ("cashandcashequivalentsatcarryingvalue", "cashandcashequivalents", "cash"),
    "total_debt": ("debtandfinanceleaseobligations", "longtermdebt", "borrowings", "financialliabilities", "totaldebt"),
    "total_assets": ("assets", "totalassets"),
    "total_liabilities": ("liabilities", "totalliabilities"),
    "current_assets": ("assetscurrent", "currentassets"),
    "current_liabilities": ("liabilitiescurrent", "currentliabilities"),
    "equity": ("stockholdersequity", "equity", "totalshareholdersfunds", "equityattributabletoownersofparent"),
}
# Labels of statement lines.
LABELS = {
    "operating_cash_flow": ("net cash from operating activities", "net cash generated from operating activities", "net cash inflow from operating activities", "net cash inflows from operating activities", "operating cash flow"),
    "current_liabilities": ("current liabilities",),
    "current_assets": ("current assets",),
    "total_liabilities": ("total liabilities",),
    "total_assets": ("total assets",),
    "gross_profit": ("gross profit", "gross profit/(loss)"),
    "net_income": ("profit after tax for the year", "net income", "profit for the year", "profit for the financial year", "profit after tax", "profit attributable"),
    "revenue": ("revenue from contracts with customers", "total revenue", "insurance revenue", "revenue", "revenues", "turnover", "sales"),
    "lease_inclusive_investment": ("capital expenditure including finance lease additions", "capital expenditures including finance lease additions", "purchases of property, plant and equipment and finance lease additions"),
    "capex": ("capital expenditure", "capital expenditures", "purchase of property, plant and equipment", "purchase of plant and equipment", "expenditure on property, plant and equipment"),
    "inventory": ("inventory", "inventories"),
    "cash": ("cash and cash equivalents", "cash and cesh equivalents", "cash equivalents", "cash"),
    "total_debt": ("total debt", "borrowings", "debt"),
    "equity": ("total equity", "shareholders' equity", "shareholders funds", "equity"),
}
# Namespaces of standard concepts, currencies by sign or code in the order in which they are looked for, kinds of metrics.
STANDARD = ("ifrs-full", "us-gaap", "uk-gaap")
CURRENCIES = {"£": "GBP", "$": "USD", "€": "EUR", "¥": "JPY", "GBP": "GBP", "USD": "USD", "EUR": "EUR", "JPY": "JPY", "CAD": "CAD", "AUD": "AUD", "CHF": "CHF"}
OVER_A_YEAR = ("revenue", "operating_cash_flow", "capex", "lease_inclusive_investment", "net_income", "diluted_eps", "shares_outstanding", "gross_profit")
MONEY = ("revenue", "operating_cash_flow", "capex", "lease_inclusive_investment", "net_income", "inventory", "gross_profit", "cash", "total_debt", "total_assets", "total_liabilities", "equity", "current_assets", "current_liabilities")
UNSIGNED = ("capex", "lease_inclusive_investment", "inventory", "cash", "total_debt", "total_assets", "total_liabilities", "current_assets", "current_liabilities", "shares_outstanding")
STEADY = ("revenue", "gross_profit", "total_assets", "total_liabilities", "equity", "current_assets", "current_liabilities")
FAMILIES = {
    "revenue": "revenue", "net_income": "net_income", "diluted_eps": "diluted_eps", "operating_cash_flow": "operating_cash_flow", "free_cash_flow": "free_cash_flow", "capex": "capital_investment",
    "lease_inclusive_investment": "capital_investment", "gross_profit": "gross_profit", "gross_margin": "gross_margin",
}
# A statement's title, a number in a line, a label and what follows its gap, a year.
ANCHOR = r"(?i)^\s*(?:consolidated\s+)?(?:income\s+statement|statement\s+of\s+(?:income|profit\s+or\s+loss|comprehensive\s+income|financial\s+position|cash\s+flows)|balance\s+sheet|cash\s+flow(?:s)?\s+statement|profit\s+and\s+loss)\s*[.:,]?\s*$"
NUMBER = r"(?<![A-Za-z])(?:[£$€¥]\s*)?(?:\(?\s*[+-]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)\s*\)?)(?![A-Za-z])"
LINE = r"^\s*(\S+(?: \S+)*?)(?:\s{2,}|\t+)(.*\S)\s*$"
YEAR = r"\b(19\d{2}|20\d{2})\b"
#: Days of a year's facts; lines after a title in which years stand, in which totals are named, in which a fact may
#: stand, and lines before a fact in which its currency may; fixed values.
YEAR_DAYS, HEADER, TOTALS, REACH, NEARBY = (270, 550), 10, 12, 80, 160
#: Rank of concepts of a company's own behind standard ones.
OWN = 100

#: Columns of a fact besides the document's key.
FACT = ["which", "metric", "value", "unit", "period", "source", "concept", "scope", "duration_days"]


def _lookup(names: dict[str, tuple[str, ...]]) -> Column:
    """A map from each name to its metric and rank; a name that two metrics have is the first one's."""
    pairs: dict[str, tuple[str, int]] = {}
    for metric, aliases in names.items():
        for rank, alias in enumerate(aliases):
            pairs.setdefault(alias, (metric, rank))
    return F.create_map(*[x for alias, (metric, rank) in pairs.items() for x in (F.lit(alias), F.struct(F.lit(metric).alias("metric"), F.lit(rank).alias("rank")))])


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*['\"]([^'\"]*)['\"]", 1)


def _element(name: str) -> str:
    return rf"(?is)<(?:[\w.-]+:)?{name}\b[^>]*>.*?</(?:[\w.-]+:)?{name}\s*>"


def _inner(body: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(body, rf"(?i)<(?:[\w.-]+:)?{name}\s*>([^<]+)", 1))


def unit_currency(unit: Column) -> Column:
    text = F.replace(F.upper(F.trim(unit)), F.lit("ISO4217:"), F.lit(""))
    exact = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])[text]
    return F.coalesce(exact, *[F.when(F.contains(text, F.lit(token)), code) for token, code in CURRENCIES.items() if len(token) > 1])


def contexts(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, ref, period_start, period_end``: a page's contexts of the whole company; of contexts with one name the last counts.

    A context with a dimension (an explicit or typed member) is a part of the company and left out, and so is one without
    an end.  An instant has no start.
    """
    found = pages.select(key, F.posexplode(F.regexp_extract_all(markup, F.lit(_element("context")), 0)).alias("place", "body"))
    head = F.regexp_extract("body", r"^<[^>]*>", 0)
    instant = _inner(F.col("body"), "instant")
    day = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    start = F.when(instant == "", day(_inner(F.col("body"), "startDate")))
    end = day(F.when(instant != "", instant).otherwise(_inner(F.col("body"), "endDate")))
    known = found.filter(~F.col("body").rlike(r"(?i)(?:explicitMember|typedMember)\b")).select(key, "place", _attribute(head, "id").alias("ref"), start.alias("period_start"), end.alias("period_end"))
    known = known.filter("ref <> '' and period_end is not null")
    return known.groupBy(key, "ref").agg(F.max_by(F.struct("period_start", "period_end"), "place").alias("c")).select(key, "ref", "c.*")


def units(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """``key, ref, measure``: a unit's measure, or its first two as a quotient."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(markup, F.lit(_element("unit")), 0)).alias("place", "body"))
    parts = F.transform(F.regexp_extract_all("body", F.lit(r"(?i)<(?:[\w.-]+:)?measure\s*>([^<]+)"), 1), lambda m: F.trim(m))
    known = found.select(key, "place", _attribute(F.regexp_extract("body", r"^<[^>]*>", 0), "id").alias("ref"), parts.alias("parts")).filter("ref <> '' and size(parts) > 0")
    return known.groupBy(key, "ref").agg(F.max_by(F.array_join(F.slice("parts", 1, 2), "/"), "place").alias("measure"))


def tagged_facts(pages: DataFrame, key: str = "doc_id", markup: str = "markup") -> DataFrame:
    """``key`` and ``FACT`` columns of pages with numbers tagged inline: the latest two annual periods of each page.

    A number counts with its scale and sign in a context of the whole company: a year for flows, an instant for balances.
    Money and shares are in millions.  Of concepts that mean a metric, standard ones come first; a metric for which the
    best concept has two values in a period is left out of it, as which one is right can't be told.  Tags inside a number
    and ``nil`` numbers don't count.  A page without facts gives no rows.
    """
    bare = pages.select(key, F.regexp_replace(markup, r"(?s)<!--.*?-->", "").alias("bare"))
    found = bare.select(key, F.posexplode(F.regexp_extract_all("bare", F.lit(r"(?is)<(?:[\w.-]+:)?nonfraction\b[^>]*>[^<]*</(?:[\w.-]+:)?nonfraction\s*>"), 0)).alias("place", "element"))
    tag = F.regexp_extract("element", r"^<[^>]*>", 0)
    found = found.select(key, "place", *[_attribute(tag, a).alias(b) for a, b in (("name", "concept"), ("contextref", "context_ref"), ("unitref", "unit_ref"), ("scale", "scale"), ("sign", "sign"), ("nil", "nil"))], F.regexp_extract("element", r">([^<]*)<", 1).alias("shown"))
    compact = F.regexp_replace(F.lower(F.element_at(F.split("concept", ":"), -1)), r"[^a-z0-9]", "")
    scale = F.when(F.trim("scale") == "", 0).otherwise(F.trim("scale").try_cast("int"))
    value = report_number(F.col("shown")) * F.pow(F.lit(10.0), scale) * F.when(F.trim("sign") == "-", -1).otherwise(1)
    found = found.withColumns({"m": _lookup(TAGGED)[compact], "value": value}).filter("m is not null and value is not null and lower(nil) <> 'true'")
    named = F.when(F.contains("concept", F.lit(":")), F.lower(F.split("concept", ":")[0])).otherwise("")
    found = found.select(key, "place", "concept", "context_ref", "unit_ref", "value", F.col("m.metric").alias("metric"), (F.col("m.rank") + F.when(named.isin(*STANDARD), 0).otherwise(OWN)).alias("rank"))
    found = found.join(contexts(pages, key, markup).withColumnRenamed("ref", "context_ref"), [key, "context_ref"])
    found = found.join(units(pages, key, markup).withColumnRenamed("ref", "unit_ref"), [key, "unit_ref"], "left").withColumn("measure", F.coalesce("measure", "unit_ref"))
    days = F.date_diff("period_end", "period_start")
    flow = F.col("metric").isin(*OVER_A_YEAR)
    fits = F.when(flow, days.between(*YEAR_DAYS)).otherwise(F.col("period_start").isNull())
    currency, low = unit_currency(F.col("measure")), F.lower("measure")
    share, quotient = F.contains(low, F.lit("share")), F.contains("measure", F.lit("/"))
    unit = (
        F.when(F.col("metric").isin(*MONEY), F.when(~quotient, F.concat(currency, F.lit("m"))))
        .when(F.col("metric") == "shares_outstanding", F.when(share, "million shares"))
        .when(F.col("metric") == "diluted_eps", F.when(share | quotient, F.concat(currency, F.lit("/share"))))
    )
    value = F.when(F.col("metric") == "diluted_eps", F.col("value")).otherwise(F.col("value") / 1_000_000)
    found = found.filter(F.coalesce(fits, F.lit(False))).withColumns({"unit": unit, "value": value, "duration_days": days}).filter("unit is not null")
    best = found.groupBy(key, "metric", "period_end", "rank").agg(
        F.min_by(F.struct("value", "unit", "concept", "duration_days"), "place").alias("f"), (F.count_distinct("value", "unit") > 1).alias("torn")
    ).groupBy(key, "metric", "period_end").agg(F.min_by(F.struct("f", "torn"), "rank").alias("b")).filter("not b.torn")
    placed = best.withColumn("nth", F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("period_end").desc()))).filter("nth <= 2")
    facts = placed.select(key, _which("nth"), "metric", F.col("b.f.value").alias("value"), F.col("b.f.unit").alias("unit"), F.col("period_end").cast("string").alias("period"), F.lit("tagged").alias("source"), F.col("b.f.concept").alias("concept"), F.lit("consolidated").alias("scope"), F.col("b.f.duration_days").alias("duration_days"))
    return with_derived(facts, key)


def _which(nth: str) -> Column:
    return F.when(F.col(nth) == 1, "current").otherwise("prior").alias("which")


def with_derived(facts: DataFrame, key: str) -> DataFrame:
    """``facts`` with gross margin, net debt and free cash flow where both parts have one unit, period and length."""
    named = ["revenue", "gross_profit", "total_debt", "cash", "operating_cash_flow", "capex"]
    parts = F.struct("value", "unit", "period", "source", "concept", "scope", "duration_days")
    wide = facts.groupBy(key, "which").agg(*[F.max(F.when(F.col("metric") == m, parts)).alias(m) for m in named])

    def made(metric: str, a: str, b: str, value: Column, unit: Column, concept: str, good: Column | None = None) -> Column:
        same = (F.col(f"{a}.unit") == F.col(f"{b}.unit")) & (F.col(f"{a}.period") == F.col(f"{b}.period"))
        days = F.when(F.col(f"{a}.duration_days").eqNullSafe(F.col(f"{b}.duration_days")), F.col(f"{a}.duration_days"))
        scope = F.when(F.col(f"{a}.scope").eqNullSafe(F.col(f"{b}.scope")), F.col(f"{a}.scope")).otherwise("other")
        row = F.struct(F.lit(metric).alias("metric"), value.alias("value"), unit.alias("unit"), F.col(f"{a}.period").alias("period"), F.concat(F.lit("derived_"), f"{a}.source").alias("source"), F.lit(f"derived:{concept}").alias("concept"), scope.alias("scope"), days.alias("duration_days"))
        return F.when(same if good is None else same & good, row)

    flow, spent = F.col("operating_cash_flow"), F.col("capex")
    derived = F.array(
        made("gross_margin", "revenue", "gross_profit", 100 * ratio("gross_profit.value", "revenue.value"), F.lit("percent"), "gross_profit/revenue", F.col("revenue.value") != 0),
        made("net_debt", "total_debt", "cash", F.col("total_debt.value") - F.col("cash.value"), F.col("cash.unit"), "debt-cash"),
        made("free_cash_flow", "operating_cash_flow", "capex", flow["value"] - F.abs(spent["value"]), flow["unit"], "operating_cash_flow-capex", flow["duration_days"].eqNullSafe(spent["duration_days"])),
    )
    more = wide.select(key, "which", F.explode(F.filter(derived, lambda x: x.isNotNull())).alias("d")).select(key, "which", "d.*")
    return facts.select(key, *FACT).unionByName(more.select(key, *FACT))


def statement_facts(texts: DataFrame, as_of_year: int, key: str = "doc_id", text: str = "text", reported: str | None = None) -> DataFrame:
    """``key`` and ``FACT`` columns of layout text with statements in two columns, the current year and the one before.

    A line counts if a known label, a gap of two spaces or more and two aligned numbers make it, within ``REACH`` lines
    below a statement's title.  A note's number before them is skipped; of several columns those of the totals count if the
    header names two.  Years come from the lines below titles, up to ``as_of_year + 1``; if those name fewer than two,
    ``reported`` (a date column) tells them.  Currency and scale are the ones named in the ``NEARBY`` lines before.  Numbers
    that lost their separators are mended where the other column leaves one reading; metrics whose lines differ, or whose
    two values are more than threefold apart where they shouldn't be, are left out.  Texts without a title give no rows.
    """
    day = F.col(reported).cast("date") if reported else F.lit(None).cast("date")
    lines = texts.select(key, day.alias("day"), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("i", "line"))
    years = F.regexp_extract_all("line", F.lit(YEAR), 1)
    plain = F.regexp_replace("line", r"<[^>]+>", " ")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains("line" if len(t) == 1 else F.upper("line"), F.lit(t)), 1 << k).otherwise(0) for k, t in enumerate(CURRENCIES)])
    lines = lines.withColumns({
        "title": F.when(F.col("line").rlike(ANCHOR), F.col("i")), "years": years, "currencies": bits, "two_totals": (F.size(F.regexp_extract_all("line", F.lit(r"(?i)\btotal\b"), 0)) >= 2).cast("int"),
        "millions": F.col("line").rlike(r"(?i)\b(?:million|millions|m)\b").cast("int"), "thousands": F.col("line").rlike(r"(?i)\b(?:thousand|thousands|k)\b").cast("int"), "share_line": F.col("line").rlike(r"(?i)\b(?:million|m)\s+shares\b").cast("int"),
        "parts": F.struct(F.regexp_extract(plain, LINE, 1).alias("label"), F.regexp_extract(plain, LINE, 2).alias("rest")),
    })
    one = Window.partitionBy(key).orderBy("i")
    above = one.rowsBetween(Window.unboundedPreceding, 0)
    back = lambda n: one.rowsBetween(-n, 0)
    title = F.max("title").over(above)
    lines = lines.withColumns({"anchor": title, "near_currencies": F.bit_or("currencies").over(back(NEARBY)), "near_millions": F.max("millions").over(back(NEARBY)), "near_thousands": F.max("thousands").over(back(NEARBY)), "near_shares": F.max("share_line").over(back(3))})
    # what a title's first lines say: all titles within reach count, also those before the last one
    headed = lines.withColumn("heads", F.collect_list("title").over(back(HEADER - 1)))
    seen = headed.filter("size(heads) > 0").groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter("years", lambda y: y.cast("int") <= as_of_year + 1))))).alias("all"), F.max(F.size("years") >= 2).alias("aligned"), F.max("day").alias("day")
    )
    two = F.reverse(F.slice("all", F.greatest(F.lit(1), F.size("all") - 1), 2))
    dated = F.array(F.year("day").cast("string"), (F.year("day") - 1).cast("string"))
    periods = seen.select(key, F.when(F.size("all") >= 2, F.when(F.col("aligned"), two)).otherwise(F.when(F.col("day").isNotNull(), dated)).alias("periods")).filter("periods is not null")
    totals = lines.filter("two_totals = 1 and anchor is not null").select(key, "anchor", "i")
    below = lines.filter("title is not null").select(key, F.col("i").alias("anchor"))
    # a header of totals may go on below the next title, so its lines are looked for from each title on
    totals = below.join(totals.select(key, F.col("i").alias("at")), key).filter(f"at >= anchor and at < anchor + {TOTALS}").select(key, "anchor").distinct().withColumn("totals", F.lit(True))
    scopes = lines.filter("title is not null").select(key, F.col("i").alias("anchor"), F.when(F.col("line").rlike(r"(?i)^\s*consolidated\b"), "consolidated").otherwise("other").alias("scope"))
    named = lines.withColumn("label", F.regexp_replace(F.lower("parts.label"), "[.:]$", ""))
    rows = named.withColumn("metric", _lookup(LABELS)[F.col("label")]["metric"]).filter(f"metric is not null and anchor is not null and i - anchor <= {REACH}")
    rows = rows.select(key, "i", "anchor", "line", "metric", "near_currencies", "near_millions", "near_thousands", "near_shares", "label", F.col("parts.rest").alias("rest"))
    rows = rows.join(periods, key).join(scopes, [key, "anchor"]).join(totals, [key, "anchor"], "left").fillna(False, ["totals"])
    before = F.regexp_extract("rest", f"^(.*?){NUMBER}", 1)
    rows = rows.withColumn("numbers", F.regexp_extract_all("rest", F.lit(NUMBER), 0)).filter((F.size("numbers") >= 2) & ~before.rlike("[A-Za-z]{2,}"))
    count, last = lambda c: F.size(c), lambda c: F.element_at(c, -1)
    rows = rows.withColumn("numbers", F.when((count("numbers") >= 3) & F.trim(F.col("numbers")[0]).rlike(r"^\d{1,2}$"), F.expr("slice(numbers, 2, size(numbers) - 1)")).otherwise(F.col("numbers")))
    cells = F.filter(F.transform(F.split("rest", r"\|"), lambda c: F.regexp_extract_all(c, F.lit(NUMBER), 0)), lambda c: F.size(c) > 0)
    rows = rows.withColumn("cells", cells)
    rows = rows.withColumn("numbers", F.when((count("numbers") > 2) & F.col("totals") & F.contains("rest", F.lit("|")) & (count("cells") == 2), F.array(last(F.col("cells")[0]), last(F.col("cells")[1]))).otherwise(F.col("numbers")))
    rows = rows.withColumn("numbers", F.when((count("numbers") > 2) & (count("numbers") % 2 == 0) & F.col("totals"), F.array(F.expr("numbers[size(numbers) div 2 - 1]"), last("numbers"))).otherwise(F.col("numbers")))
    rows = rows.filter(count("numbers") == 2).withColumn("pair", number_pair(F.col("numbers")[0], F.col("numbers")[1])).filter("pair is not null")
    currency = F.coalesce(*[F.when(F.col("near_currencies").bitwiseAND(1 << k) > 0, code) for k, code in enumerate(CURRENCIES.values())])
    money = F.col("metric").isin(*MONEY)
    factor = F.when(~money | (F.col("near_millions") == 1), 1.0).when(F.col("near_thousands") == 1, 0.001).otherwise(1.0)
    unit = F.when(money, F.when(currency.isNotNull() | (F.col("near_millions") == 1) | (F.col("near_thousands") == 1), F.coalesce(F.concat(currency, F.lit("m")), F.lit("report_millions")))).when(F.col("metric") == "shares_outstanding", F.when(F.col("near_shares") == 1, "million shares").otherwise("shares")).when(F.col("metric") == "diluted_eps", F.concat(currency, F.lit("/share")))
    signed = F.when(F.col("metric").isin(*UNSIGNED), F.transform("pair", lambda x: F.abs(x))).otherwise(F.col("pair"))
    rows = rows.withColumns({"unit": unit, "factor": factor, "pair": signed}).filter("unit is not null")
    rows = rows.withColumn("pair", F.transform("pair", lambda x: x * F.col("factor")))
    # equal lines are one fact; lines that differ tell nothing
    metrics = rows.groupBy(key, "metric", "periods").agg(F.min_by(F.struct("pair", "unit", "label", "scope"), "i").alias("f"), F.count_distinct("pair", "unit").alias("readings"), F.min("pair").alias("least"), F.max("pair").alias("most"), F.count_distinct("unit").alias("n_units")).filter("readings = 1")
    apart = F.abs(F.col("f.pair")[0]) / F.abs(F.col("f.pair")[1])
    odd = F.col("metric").isin(*STEADY) & (F.col("f.pair")[0] != 0) & (F.col("f.pair")[1] != 0) & ~F.coalesce(F.when(F.col("f.pair")[1] != 0, apart).between(1 / 3, 3.0), F.lit(True))
    each = metrics.filter(~odd).select(key, "metric", "f", F.posexplode(F.arrays_zip(F.col("periods").alias("period"), F.col("f.pair").alias("value"))).alias("nth", "x"))
    facts = each.select(key, F.when(F.col("nth") == 0, "current").otherwise("prior").alias("which"), "metric", F.col("x.value").alias("value"), F.col("f.unit").alias("unit"), F.col("x.period").alias("period"), F.lit("statement").alias("source"), F.concat(F.lit("text:"), "f.label").alias("concept"), F.col("f.scope").alias("scope"), F.lit(None).cast("int").alias("duration_days"))
    return with_derived(facts, key)


def relationship_tags(metric: str | Column = "metric") -> Column:
    """``metric_family, temporal_basis, cash_basis`` of metrics that say how a company does; null for the others."""
    m = F.col(metric) if isinstance(metric, str) else metric
    family = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[m]
    time = F.when(m == "gross_margin", "rate_over_period").otherwise("period_flow")
    cash = F.when(m == "lease_inclusive_investment", "cash_plus_finance_leases").when(m.isin("operating_cash_flow", "free_cash_flow", "capex"), "cash").otherwise("not_applicable")
    return F.when(family.isNotNull(), F.struct(family.alias("metric_family"), time.alias("temporal_basis"), cash.alias("cash_basis")))


def first_source(found: Sequence[DataFrame], key: str = "doc_id") -> DataFrame:
    """The facts of each document's first source that has a current one; sources by precedence, first ones first."""
    ranked = reduce(DataFrame.unionByName, [f.withColumn("precedence", F.lit(k)) for k, f in enumerate(found)])
    has = F.min(F.when(F.col("which") == "current", F.col("precedence"))).over(Window.partitionBy(key))
    return ranked.withColumn("chosen", has).filter("precedence = chosen").drop("precedence", "chosen")


def reconciled(facts: DataFrame, keys: Sequence[str], precedence: Sequence[str], tolerance: float) -> DataFrame:
    """``keys..., value, unit, source, n_sources, conflicts``: each fact by its first source, held against the others.

    ``facts`` has ``keys``, ``source``, ``value`` and ``unit``.  ``conflicts`` lists sources, in order, whose value is off
    by more than ``tolerance`` of the larger magnitude, or whose unit is another one.  A source that isn't in
    ``precedence`` comes last, by name; of several values of a source its least counts.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for k, s in enumerate(precedence) for x in (s, k)])[F.col("source")], F.lit(len(precedence)))
    of = facts.groupBy(*keys, "source").agg(F.min(F.struct("value", "unit")).alias("f"))
    lists = of.withColumn("rank", rank).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "source", F.col("f.value").alias("value"), F.col("f.unit").alias("unit")))).alias("all"))
    first = F.col("all")[0]
    off = lambda x: (x["unit"] != first["unit"]) | (F.abs(x["value"] - first["value"]) > tolerance * F.greatest(F.abs(x["value"]), F.abs(first["value"])))
    others = F.transform(F.filter(F.expr("slice(all, 2, size(all))"), off), lambda x: x["source"])
    return lists.select(*keys, first["value"].alias("value"), first["unit"].alias("unit"), first["source"].alias("source"), F.size("all").alias("n_sources"), others.alias("conflicts"))
