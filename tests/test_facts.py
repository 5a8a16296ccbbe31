"""Facts of reports: small pages and statements with known figures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaylight.functions.text import number_pair, report_number
from quaylight.operators import facts

UNIT = "<xbrli:unit id='GBP'><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><unit id='ps'><divide><measure>iso4217:USD</measure><measure>xbrli:shares</measure></divide></unit>"


def period(name, start, end, more=""):
    inner = f"<xbrli:startDate>{start}</xbrli:startDate><xbrli:endDate>{end}</xbrli:endDate>" if start else f"<xbrli:instant>{end}</xbrli:instant>"
    return f'<xbrli:context id="{name}">{more}<xbrli:period>{inner}</xbrli:period></xbrli:context>'


def number(name, context, shown, unit="GBP", more='scale="6"'):
    return f'<ix:nonFraction name="{name}" contextRef="{context}" unitRef="{unit}" {more}>{shown}</ix:nonFraction>'


def found(df):
    return {(r["which"], r["metric"]): (r["value"], r["unit"], r["period"], r["source"]) for r in df.collect()}


def tagged(spark, body):
    return found(facts.tagged_facts(spark.createDataFrame([(1, UNIT + body), (2, None), (3, "no facts")], "doc_id long, markup string")))


def test_contexts_units_scale_and_sign(spark):
    years = period("p", "2021-01-01", "2021-12-31") + period("c", "2022-01-01", "2022-12-31") + period("h", "2022-07-01", "2022-12-31") + period("e", None, "2022-12-31")
    part = period("part", "2022-01-01", "2022-12-31", '<xbrldi:explicitMember dimension="d">m</xbrldi:explicitMember>')
    body = years + part + "".join([
        number("uk-gaap:Turnover", "c", "1,250"), number("uk-gaap:Turnover", "p", "1,000"), number("uk-gaap:Turnover", "h", "7"), number("uk-gaap:Turnover", "part", "8"), number("own:Revenue", "c", "9"),
        number("ifrs-full:ProfitLoss", "c", "40", more='scale="6" sign="-"'), number("ifrs-full:ProfitLoss", "p", "(30)"), number("ifrs-full:GrossProfit", "c", "500,000", more='scale="3"'),
        number("us-gaap:Assets", "e", "1,2,3"), number("ifrs-full:Equity", "e", "5"), number("ifrs-full:Equity", "e", "6"), number("us-gaap:Inventory", "c", "5"), number("us-gaap:Cash", "e", "2", more='nil="true"'),
        number("us-gaap:EarningsPerShareDiluted", "c", "1.5", "ps", ""), number("us-gaap:SharesOutstanding", "c", "3", "GBP"), number("ifrs-full:Borrowings", "e", "<b>5</b>"), "<!--" + number("us-gaap:Capex", "c", "5") + "-->",
    ])
    got = tagged(spark, body)
    assert got == {
        ("current", "revenue"): (1250.0, "GBPm", "2022-12-31", "tagged"), ("prior", "revenue"): (1000.0, "GBPm", "2021-12-31", "tagged"), ("current", "net_income"): (-40.0, "GBPm", "2022-12-31", "tagged"),
        ("prior", "net_income"): (-30.0, "GBPm", "2021-12-31", "tagged"), ("current", "gross_profit"): (500.0, "GBPm", "2022-12-31", "tagged"), ("current", "diluted_eps"): (1.5, "USD/share", "2022-12-31", "tagged"),
        ("current", "gross_margin"): (40.0, "percent", "2022-12-31", "derived_tagged"),
    }


def test_own_concepts_count_where_no_standard_one_does(spark):
    body = period("c", "2022-01-01", "2022-12-31") + period("c", "2023-01-01", "2023-12-31") + number("own:Revenue", "c", "9") + number("own:Revenue", "c", "9")
    assert tagged(spark, body) == {("current", "revenue"): (9.0, "GBPm", "2023-12-31", "tagged")}


STATEMENT = """CONSOLIDATED INCOME STATEMENT
year ended 30 June 2022
US$ million                 Note     2022      2021
Revenue                        3    1,300     1,200
Gross profit                          650       600
Gross profit                          650       600
Sales of plant                        1         2
Profit for the year                   (20)      35
Balance sheet
Total liabilities                     100      1,000
Total assets                   4      5,000     4,900
Total assets                   4      5,001     4,900
Cash                           5      (70)      60
Borrowings:                           90        80
"""


def statement(spark, text, day=None):
    docs = spark.createDataFrame([(1, text, day), (2, None, day), (3, "", day)], "doc_id long, text string, day date")
    return found(facts.statement_facts(docs, 2024, reported="day"))


def test_statement_lines(spark):
    got = statement(spark, STATEMENT)
    assert got[("current", "revenue")] == (1300.0, "USDm", "2022", "statement") and got[("prior", "revenue")][0] == 1200.0
    assert got[("current", "gross_margin")][0] == 50.0 and got[("current", "net_income")][0] == -20.0
    assert got[("current", "cash")][0] == 70.0 and got[("current", "net_debt")][:2] == (20.0, "USDm")
    # torn lines, and values that are too far apart
    assert not {m for _, m in got} & {"total_assets", "total_liabilities"}


def test_statement_needs_a_title_and_two_columns(spark):
    assert statement(spark, "Revenue   5   6\n2022 2021") == {}
    assert statement(spark, "Income statement\nRevenue  5  6") == {}
    assert statement(spark, "Income statement\n£ thousand\nRevenue  5,000  6,000", dt.date(2020, 3, 31)) == {("current", "revenue"): (5.0, "GBPm", "2020", "statement"), ("prior", "revenue"): (6.0, "GBPm", "2019", "statement")}
    far = "Income statement\n2022 2021 £m\n" + "\n" * 90 + "Revenue  5  6"
    assert statement(spark, far) == {}
    assert statement(spark, "Income statement\n2022 2021\nRevenue  5  6") == {}


def test_totals_of_several_columns(spark):
    text = "Income statement\n$ million 2022 2021\n          Before   Items   Total    Before   Items   Total\nRevenue   2   900   13   913   800   (4)   796\nEquity   100 200 300\nCapital expenditure   5 | 6 7 | 8"
    got = statement(spark, text)
    assert got[("current", "revenue")][0] == 913.0 and got[("prior", "revenue")][0] == 796.0 and not {m for _, m in got} & {"capex", "equity"}


@pytest.mark.parametrize(("text", "want"), [("1,234.5", 1234.5), ("(1,234)", -1234.0), ("£ 12", 12.0), ("-", None), ("—", None), ("n/a", None), ("1,30", None), ("1234,567", None), ("−5", -5.0), (".5", 0.5), ("1e3", 1000.0), ("x", None), ("", None), ("&nbsp;7&#160;", 7.0), (None, None), ("5d", None)])
def test_report_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(report_number(F.col("t"))).first()[0] == want


PAIRS = [
    ("3.870", "3,610", [3870.0, 3610.0]), ("5.66390", "5,112.4", [5663.9, 5112.4]), ("13160", "2,071.3", [1316.0, 2071.3]), ("1,30", "1,200", None), ("0.025", "900", [0.025, 900.0]),
    ("120", "100", [120.0, 100.0]), ("5", "100", [5.0, 100.0]), ("1.234", "9.999", [1.234, 9.999]), ("2,500", "(2.471)", [2500.0, -2471.0]), ("0", "7", [0.0, 7.0]), ("9.1234", "55", None), ("7", "x", None),
]


def test_lost_separators(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _ in PAIRS], "a string, b string").select("a", "b", number_pair(F.col("a"), F.col("b")).alias("p")).collect()
    assert {(r["a"], r["b"]): r["p"] for r in rows} == {(a, b): p for a, b, p in PAIRS}


def test_sources_by_precedence(spark):
    schema = "doc_id long, which string, metric string, value double, unit string, period string, source string, concept string, scope string, duration_days int"
    row = lambda d, which, metric, value, source, unit="u": (d, which, metric, value, unit, "2022", source, "", "", None)
    first = spark.createDataFrame([row(1, "current", "a", 1.0, "x"), row(2, "prior", "a", 5.0, "x")], schema)
    second = spark.createDataFrame([row(1, "current", "b", 2.0, "y"), row(2, "current", "a", 3.0, "y"), row(1, "current", "a", 1.02, "y")], schema)
    assert sorted((r["doc_id"], r["metric"], r["value"]) for r in facts.first_source([first, second]).collect()) == [(1, "a", 1.0), (2, "a", 3.0)]
    got = {(r["doc_id"], r["metric"]): (r["value"], r["source"], r["n_sources"], r["conflicts"]) for r in facts.reconciled(first.unionByName(second), ["doc_id", "metric"], ["x", "y"], 0.01).collect()}
    assert got == {(1, "a"): (1.0, "x", 2, ["y"]), (1, "b"): (2.0, "y", 1, []), (2, "a"): (5.0, "x", 2, ["y"])}
    assert facts.reconciled(first.unionByName(second), ["doc_id", "metric"], ["y"], 0.05).filter("doc_id = 1 and metric = 'a'").first()["conflicts"] == []
