"""Cases of the findings of round 3 that the small tables don't hold."""

from __future__ import annotations

import datetime as dt
import pathlib
import re

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quaylight.operators import asof, companies, evidence, pointintime, reaction, research
from quaylight.plans import domains, files
from quaylight.sources.scratch import shared_folder
from quaylight.streaming import windows

BEGIN = dt.datetime(2024, 1, 1)


def _prices(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 3 * 86_400, n))
    close = rng.integers(0, 9, n).astype(float)
    return [("ab"[k % 2], BEGIN + dt.timedelta(seconds=int(t)), None if k % 17 == 0 else float("nan") if k % 19 == 0 else float(c)) for k, (t, c) in enumerate(zip(at, close, strict=True))]


def test_matched_volatility_before(spark):
    """Windows that meet stretches of ticks give what a group of samples for each event gives."""
    ticks = _prices(1500, 1)
    asks = [(k, "ab"[k % 2], BEGIN + dt.timedelta(seconds=k * 1703)) for k in range(150)] + [(0, "a", BEGIN), (900, None, BEGIN), (901, "a", None), (902, "c", BEGIN)]
    a = spark.createDataFrame(asks, "event_id long, symbol string, ts timestamp_ntz")
    got = {(r["event_id"], r["symbol"]): (r["pairs"], r["volatility"]) for r in reaction.matched_volatility_before(a, spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, close double"), ["symbol"], "ts", 86_400, 3600).collect()}
    want = {}
    for i, s, t in asks[:150]:
        inside = pd.DataFrame([((u - dt.datetime(1970, 1, 1)).total_seconds(), c) for x, u, c in ticks if x == s and t - dt.timedelta(days=1) <= u < t and c is not None and np.isfinite(c)], columns=["at", "close"])
        if len(inside):
            inside = inside.sort_values(["at", "close"]).drop_duplicates("at")
            want[i, s] = reaction._matched(inside["close"].to_numpy(), inside["at"].to_numpy(), 3600)
    assert got.keys() == want.keys()
    for k, (pairs, volatility) in want.items():
        assert got[k][0] == pairs
        assert (got[k][1] is None) == (volatility is None) and (volatility is None or abs(got[k][1] - volatility) < 1e-9)


def test_dense_windows_are_not_written_out(spark):
    """100,000 ticks before each of 2,000 events: 200 million samples if each window were written out."""
    ticks = spark.range(100_000).selectExpr("'a' AS symbol", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, cast(id * 0.8 AS decimal(18,6))) AS ts", "cast(id % 97 + 1 AS double) AS close")
    asks = spark.range(2000).selectExpr("id AS event_id", "'a' AS symbol", "TIMESTAMP_NTZ '2024-01-01 23:00:00' + make_dt_interval(0, 0, 0, cast(id AS decimal(18,6))) AS ts")
    assert reaction.matched_volatility_before(asks, ticks, ["symbol"], "ts", 86_400, 3600).filter("pairs = 22").count() == 2000
    assert asof.slot_lasts(asks, ticks, ["symbol"], ["event_id", "symbol"], "ts", "close", 3 * 3600, 900).groupBy("event_id").count().count() == 2000


def test_slot_lasts(spark):
    """Slots cut by an event and by its stretch, null prices, ticks at the event's time, repeated ids."""
    ticks = [(s, t, None if c is None or c != c else c) for s, t, c in {(s, t): (s, t, c) for s, t, c in _prices(900, 2)}.values()] + [("a", BEGIN + dt.timedelta(minutes=m), None) for m in range(3000, 3060, 15)]
    ticks = list({(s, t): (s, t, c) for s, t, c in ticks}.values())
    asks = [(k % 60, "ab"[k % 2], BEGIN + dt.timedelta(seconds=k * 3011)) for k in range(90)] + [(70, "a", BEGIN + dt.timedelta(minutes=3061)), (71, ticks[400][0], ticks[400][1]), (72, "c", BEGIN), (73, "a", None)]
    a, t = spark.createDataFrame(asks, "event_id long, symbol string, ts timestamp_ntz"), spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, close double")
    got = sorted(map(tuple, asof.slot_lasts(a, t, ["symbol"], ["event_id", "symbol"], "ts", "close", 10_800, 900).collect()), key=str)
    asks_df, ticks_df = a.toPandas(), t.toPandas()  # noqa: F841
    want = duckdb.sql("SELECT event_id, a.symbol, epoch_us(t.ts) // 900000000, arg_max(close, t.ts) FROM asks_df a JOIN (SELECT symbol, ts, CASE WHEN isnan(close) THEN NULL ELSE close END AS close FROM ticks_df) t ON t.symbol = a.symbol AND t.ts < a.ts AND t.ts >= a.ts - INTERVAL 3 HOUR GROUP BY ALL").fetchall()
    assert got == sorted(want, key=str)
    assert any(r[3] is None for r in got)


def test_equal_versions(spark):
    """Of rows that key, time and version leave equal, a replay takes the same one whatever their order."""
    rows = [(1, 1, BEGIN, "b", 7), (1, 1, BEGIN, "a", 9), (1, 1, BEGIN, None, 8), (2, 1, BEGIN, "x", 2), (2, 1, BEGIN, "x", 1)]
    a = pointintime.Adapter("f", "t", ["k"], "at", [], ["x"], "x", {"e": "y"}, identity=["k"], version="v")
    found = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        t = spark.createDataFrame(order, "k int, v int, at timestamp_ntz, x string, y int")
        found.append(sorted((r["content"], *r["entities"]) for r in pointintime.collect({"t": t}, [a], "2024-01-05", 30).collect()))
    assert found[0] == found[1] == found[2] == [('{"x":"a"}', "e:9"), ('{"x":"x"}', "e:1")]


def test_case_pairs_are_not_written(spark):
    """2,000 patterns and 3,000 cases that share their commonest words: six million pairs, of which one for each pattern comes out."""
    word = lambda n: F.concat(F.lit("w"), (F.col("id") * 7919 % n).cast("string"))
    tokens = F.array(F.lit("the"), F.lit("and"), word(13), word(101), word(997))
    asked = spark.range(2000).select("id", F.concat(F.lit("a"), "id").alias("fingerprint"), tokens.alias("tokens"))
    cases = spark.range(2000, 5000).select(F.col("id").alias("case_id"), F.lit("b").alias("fingerprint"), F.array(tokens, F.array(F.lit("the"))).alias("names"))
    got = {r["id"]: (r["case_id"], r["score"]) for r in research.match_cases(asked, cases, 0.3).collect()}
    plain = {r["id"]: set(r["tokens"]) for r in spark.range(5000).select("id", tokens.alias("tokens")).collect()}
    assert len(got) == 2000
    for i in range(0, 2000, 97):
        scores = [(len(plain[i] & s) / len(plain[i] | s), -k) for k in range(2000, 5000) for s in (plain[k], {"the"})]
        assert got[i] == (-max(scores)[1], max(scores)[0])
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(research.match_cases(asked, cases, 0.3)._jdf.queryExecution(), "simple")
    assert "CoGroup" in plan and plan.count("Generate explode(rare") == 0


def test_ownership_files_are_compressed(spark):
    files.src09_ownership(spark, "/root/testdata/sf0.001")
    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    names = [p.name for p in folder.glob("src09-*/src09/part-*")]
    assert names and all(n.endswith(".xml.gz") for n in names)


def test_all_companies_have_peers(spark):
    """Every company is a subject; missing metrics, ties, null industries and an industry of one."""
    rows = [(k, k % 3 if k % 11 else None, float(k % 7) if k % 5 else None, float(k % 13), float(k * k % 101)) for k in range(1, 200)] + [(500, 9, 1.0, 1.0, 1.0)]
    metrics = {"growth": 10.0, "margin": 10.0, "price": 100.0}
    f = spark.createDataFrame(rows, "company long, industry int, growth double, margin double, price double")
    got = {(r["subject"], r["place"]): (r["peer"], r["distance"], r["p_growth"]) for r in companies.peers(f, f, "industry", "company", metrics).collect()}
    s, p = (f.select(F.col("company").alias(n), "industry", *[F.col(m).alias(f"{x}_{m}") for m in metrics]) for n, x in (("subject", "s"), ("peer", "p")))
    pairs = s.join(p, "industry").filter("subject <> peer").withColumn("distance", companies.peer_distance(metrics)).collect()
    want = {}
    for subject in {r["subject"] for r in pairs}:
        near = sorted((((r["distance"], r["peer"]), r["p_growth"]) for r in pairs if r["subject"] == subject), key=lambda x: x[0])[:8]
        want |= {(subject, k + 1): (key[1], key[0], growth) for k, (key, growth) in enumerate(near)}
    assert got == want
    d = "/root/testdata/sf0.001"
    assert domains.inv17_peer_distance(spark, d).select("subject").distinct().count() == domains.company_facts(spark, d).count() > 1


def test_words_go_back_in_parts():
    """Texts of one Arrow batch give their words a few texts at a time."""
    texts = pd.Series(["Ｆull wide word", None, ""] * 1000)
    parts = list(research.nfkc_tokens.func(iter([texts])))
    assert max(map(len, parts)) <= research.TEXTS and pd.concat(parts).to_list() == [["full", "wide", "word"], [], []] * 1000


def test_relationships_deal_facts_first(spark):
    """The companies' rows are dealt before they are sorted, so no split of the input is sorted whole."""
    facts = spark.createDataFrame([(1, "revenue", "FY", "5", None), (1, "net_income", "FY", "2", None)], "company long, metric string, period string, value string, role string")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(evidence.relationships(facts)._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning(company") >= 1 and plan.index("Sort [company") < plan.index("Exchange hashpartitioning(company")
    assert [tuple(r)[1] for r in evidence.relationships(facts).collect()] == ["rel:top_bottom:revenue:FY:5:net_income:FY:2"]


def test_waiting_windows_meet_no_pairs(spark, tmp_path):
    """20,000 ticks and 4,000 windows in one hour of a symbol: 60 million pairs if they were joined; ties, both edges, two batches."""
    state = windows.PendingWindows(spark, f"file://{tmp_path}/s", 1800, 3600, 2)
    at = lambda c: f"TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, cast({c} AS decimal(18,6)))"
    ticks = spark.range(20_000).selectExpr("id", "'a' AS symbol", f"{at('id div 2 * 0.36')} AS ts", "cast(id * 7919 % 1009 AS double) AS close")
    asks = spark.range(4000).selectExpr("id AS window_id", "'a' AS symbol", f"{at('id * 1.8')} AS target_at")
    for k in range(2):
        state.advance(k, ticks.filter(f"id div 2 % 2 = {k}").drop("id"), asks.filter(f"window_id % 2 = {k}"))
    got = {r["window_id"]: (r["tick_at"], r["price"]) for r in state.result().collect()}
    closes = [max(2 * k * 7919 % 1009, (2 * k + 1) * 7919 % 1009) for k in range(10_000)]
    want = {}
    for w in range(4000):
        k = min(w * 5, 9999)
        inside = w * 1.8 - k * 0.36 <= 1800 + 1e-9
        want[w] = (BEGIN + dt.timedelta(microseconds=k * 360_000), float(closes[k])) if inside else (None, None)
    assert got == want
    now = state._matched(asks, ticks.selectExpr("symbol", "0L AS slot", "ts AS tick_at", "close AS price"))
    assert "Join" not in now._jdf.queryExecution().optimizedPlan().toString()


def test_sections_by_literals(spark):
    """Headings in any letters, side by side, inside one another and cut short give what plain patterns give; own patterns too."""
    rng = np.random.default_rng(5)
    words = ["Outlook", "guidance", "FORWARD-looking statement", "forwardlooking", "Risk  factors", "risk factor", "business segment", " reporting", "segment results", "margin", "Margins", "cash flow", "OPERATING results", "capital expenditure", "s", "Balance Sheet", "indebtedness", "financial position", "Dividends", "buyback", "share repurchase", "commitment and contingency", "commitments", "material contracts", "managements discussion", "Management's Discussion", "MD&A", "strategic review", "K", "İ", " ", "\n", " x 5% ", "capital", " allocation"]
    texts = ["".join(rng.choice(words, rng.integers(0, 14))) for _ in range(600)] + [None, ""]
    for patterns in (evidence.SECTIONS, {"a": "outlook|x", "risk_language": r"risk\s+factors?"}):
        got = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", evidence.sections(F.col("t"), patterns).alias("s")).orderBy("k").collect()]
        for t, s in zip(texts, got, strict=True):
            want = {}
            for c, p in patterns.items() if t is not None else ():
                m = re.search(p, t, re.I | re.A)
                if m:
                    rest = t[m.end() :]
                    n = re.search("|".join(patterns.values()), rest, re.I | re.A)
                    want[c] = re.sub(r"[ \t\r\n\f]+", " ", rest[: n.start()] if n else rest).strip(" ").lower()
            assert (s or {}) == want, t


def test_sections_are_read_once(spark):
    """Both sides of a comparison read parts from disk, so no text is cut twice."""
    filings = spark.createDataFrame([(1, "c", "q", 1, 1, "Outlook: good"), (2, "c", "q", 2, 1, "Outlook: bad")], "document_id long, company string, document_type string, report_date long, created_at long, text string")
    deltas = evidence.filing_deltas(filings)
    assert "Generate" not in spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(deltas._jdf.queryExecution(), "simple")
    assert {(r["document_id"], r["change"]) for r in deltas.collect()} == {(1, "new"), (2, "changed")}
