"""Transcripts, portfolio context, cohorts and valuations on small rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaylight.operators import portfolio, stories, transcripts

PAGE = """<a href="/q1">Q1 2024 Earnings Call Transcript</a><a href='call.html#x'>Conference call</a><a HREF="https://ir.b.com/d/call.html">again</a><a href="#top">transcript</a><a href="http://ir.b.com/transcript">plain</a>
<a class="k" href="//c.com/r">Press release: earnings</a><a href="/pr">Press release</a><a href="/s">Share this transcript</a><a href="?y=2023">Financial results</a><a href="/about">About</a><a href="mailto:a@b">transcript</a><a href="/earnings-call"></a>"""


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://ir.b.com/d/p.html?x=1", PAGE), (2, "https://e.com", None), (3, None, PAGE)], "page_id long, url string, html string")
    rows = transcripts.transcript_links(pages).collect()
    got = [(r["url"], r["score"]) for r in sorted(rows, key=lambda r: (r["page_id"], r["place"])) if r["page_id"] == 1]
    assert got == [("https://ir.b.com/q1", 7), ("https://ir.b.com/earnings-call", 4), ("https://ir.b.com/d/p.html?y=2023", 3), ("https://ir.b.com/d/call.html#x", 2)]
    assert transcripts.transcript_links(pages, most=2).filter("page_id = 1").count() == 2


def test_turns(spark):
    text = "Welcome all\n\nOperator: Good day.\nMore of it\nJane A. Doe:\nRevenue: 5 grew\nhttps://x.y\nSource: a wire\nQuestion and Answer Session\nBob O'Neil: Why?\r\nBecause: no\n"
    docs = spark.createDataFrame([(1, text), (2, "Operator: alone\nOperator: again"), (3, None), (4, "")], "doc_id long, text string")
    rows = sorted((r["turn"], r["speaker"], r["part"], r["said"]) for r in transcripts.transcript_turns(docs).filter("turn > 0").collect())
    assert rows == [(1, "Operator", "opening", "Good day. More of it"), (2, "Jane A. Doe", "opening", ""), (3, "Revenue", "opening", "5 grew https://x.y Source: a wire"), (4, "Bob O'Neil", "qa", "Why?"), (5, "Because", "qa", "no")]
    assert {r["doc_id"] for r in transcripts.transcript_turns(docs).collect()} == {1}


@pytest.mark.parametrize("heading", [False, True])
def test_segments_are_disjoint_and_bounded(spark, heading):
    body = "\n".join(f"line {i} " + ("guidance and margin, " * (i % 5)) + "ß漢字 " * (i % 11) for i in range(120)) + "\n" + "z" * 4000
    text = " \n" + (body[:2000] + "\nQuestions & Answers\n" + body[2000:] if heading else body) + "\n "
    docs = spark.createDataFrame([(1, text), (2, "short guidance"), (3, None), (4, " \n"), (1, text)][:4], "doc_id long, text string")
    rows = [r.asDict() for r in transcripts.segments(docs, each=50).orderBy("place").collect()]
    mine = sorted((r["start"], r["end"], r["kind"], r["signal"], r["excerpt"]) for r in rows if r["doc_id"] == 1)
    bare = text.strip()
    assert all(e - s <= 1500 and bare[s:e] == x and n == x.lower().count("guidance") + x.lower().count("margin") for s, e, _, n, x in mine)
    assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:], strict=False)) and mine[-1][1] == len(bare) and mine[0][:1] == (0,)
    if heading:
        assert {k for _, _, k, _, _ in mine} == {"opening", "qa"} and min(s for s, _, k, _, _ in mine if k == "qa") == bare.index("Questions & Answers")
    else:
        assert all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))
    few = transcripts.segments(docs, each=3).filter("doc_id = 1").orderBy("place").collect()
    want = sorted((r for r in rows if r["doc_id"] == 1 and r["kind"] != "opening"), key=lambda r: (-r["signal"], r["start"]))[:2]
    assert [r["segment_id"] for r in few][1:] == [r["segment_id"] for r in want] and few[0]["kind"] == "opening"
    assert [(r["doc_id"], r["kind"], r["signal"]) for r in rows if r["doc_id"] != 1] == [(2, "opening", 1)]
    assert [(r["doc_id"], r["place"]) for r in transcripts.dealt(transcripts.segments(docs), "doc_id", 3).collect()] == [(2, 1), (1, 1), (1, 2)]


def test_story_keys(spark):
    rows = spark.createDataFrame([("A bank fails", ["X", "y"], ["M"]), ("fails bank", ["y", "x", None, ""], ["m"]), ("A bank fails", ["z"], ["m"]), ("A bank fails", [], []), (None, None, None)], "t string, e array<string>, m array<string>")
    keys = [r[0] for r in rows.select(stories.story_key(F.col("t"), F.lit("2024-01-01"), F.coalesce("e", F.array().cast("array<string>")), F.coalesce("m", F.array().cast("array<string>")))).collect()]
    assert keys[0] == keys[1] and len(set(keys[:4])) == 3 and keys[0].startswith("story:") and len(keys[0]) == 70


def test_portfolio(spark):
    held = spark.createDataFrame([("a", 1.0, ["x", "x", "q"]), ("a", 2.0, ["x"]), (None, 3.0, None), ("b", -1.0, ["x"]), ("b", 0.0, ["x"])], "sector string, weight double, theme_tags array<string>")
    themes = spark.createDataFrame([("x",), ("x",)], "name string")
    got = {(r["dimension"], r["bucket"]): (r["exposure"], r["holdings"]) for r in portfolio.exposures(held, themes, ["sector"]).collect()}
    assert got == {("sector", "a"): (3.0, 2), ("sector", None): (3.0, 1), ("theme", "x"): (4.0, 3)}
    assert [r["bucket"] for r in portfolio.exposures(held, themes, ["sector"], limit=1).filter("dimension = 'sector'").collect()] == ["a"]
    assert portfolio.exposures(held.limit(0), themes, ["sector"]).count() == 0


def test_cohorts(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    cases = spark.createDataFrame([(1, day(0), day(10), "archived"), (2, day(5), day(4), "mature"), (3, day(40), day(40), "candidate"), (4, day(-5), day(9), "mature")], "case_id int, first_seen_at timestamp_ntz, last_evidence_at timestamp_ntz, state string")
    seen = spark.createDataFrame([(1, day(2), "forming"), (2, day(6), "candidate"), (2, day(9), "corroborated"), (2, dt.datetime(2024, 1, 12, 12), "mature")], "case_id int, at timestamp_ntz, state string")
    got = {r["cohort"]: r.asDict() for r in portfolio.cohorts(cases, seen, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    a, b = got["2024-01"], got["2024-02"]
    assert (a["case_count"], a["formed_count"], a["corroborated_count"], a["research_ready_count"], a["weak_case_archived_count"], a["now_mature"]) == (2, 2, 1, 1, 1, 1)
    assert (a["median_survival_days"], a["median_days_to_forming"], a["median_days_to_mature"], a["forming_to_corroborated_rate"]) == (5.0, 3.0, 6.5, 0.5)
    assert (b["formed_count"], b["median_days_to_forming"], b["forming_to_corroborated_rate"], b["median_survival_days"]) == (0, None, None, 0.0) and len(got) == 2


def test_valuations(spark):
    nan = float("nan")
    rows = [("CALCULATED", None, None, 5.0, None, 3.0, 0.1), (None, 2.0, None, None, 4.0, nan, 0.2), ("?", None, 7.0, -1.0, 9.0, 1.0, 0.1), (None, nan, nan, None, None, 1.0, 0.1)]
    r = portfolio.valuation_coverage(spark.createDataFrame(rows, "dcf_status string, per_share double, enterprise_value double, market_price double, metric_price double, pe double, margin_of_safety double")).first()
    assert tuple(r) == (2, 1, 1, 2, 1, 1)
