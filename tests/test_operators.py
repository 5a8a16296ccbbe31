"""Operators on hand-made rows: the edges that the tables don't hold."""

from __future__ import annotations

import datetime as dt
import math
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.functions import numeric, text, times
from quaylight.operators import asof, companies, keys, macro, market, options, quality, reaction, stories, theses

T0 = dt.datetime(2026, 1, 2, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def ticks(spark):
    rows = [("A", at(-1), 10.0), ("A", at(0), 11.0), ("A", at(60), 12.0), ("A", at(360), 13.0), ("A", at(360.000001), 14.0), ("B", at(-90_000), 5.0)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


@pytest.fixture(scope="module")
def asks(spark):
    return spark.createDataFrame([(1, "A", T0), (2, "B", T0), (3, "C", T0)], "id int, symbol string, ts timestamp_ntz")


def closes(df):
    return {r["id"]: r["close"] for r in df.collect()}


def test_asof_bounds(ticks, asks):
    f = lambda g, **k: closes(g(asks, ticks, ["symbol"], "ts", ["close"], **k))
    assert f(asof.asof_before) == {1: 10.0, 2: 5.0, 3: None}
    assert f(asof.asof_before, strict=False) == {1: 11.0, 2: 5.0, 3: None}
    assert f(asof.asof_before, seconds=89_999) == {1: 10.0, 2: None, 3: None}
    assert f(asof.asof_before, seconds=90_000) == {1: 10.0, 2: 5.0, 3: None}
    assert f(asof.asof_after, seconds=300, offset_seconds=60) == {1: 12.0, 2: None, 3: None}
    assert f(asof.asof_after, seconds=299, offset_seconds=61) == {1: 13.0, 2: None, 3: None}
    assert f(asof.asof_after, seconds=298, offset_seconds=61) == {1: None, 2: None, 3: None}
    assert f(asof.asof_until, seconds=300, offset_seconds=360) == {1: 13.0, 2: None, 3: None}
    assert f(asof.nearest, seconds=30, offset_seconds=30) == {1: 11.0, 2: None, 3: None}


def test_asof_doesnt_depend_on_partitions(ticks, asks):
    wide = closes(asof.asof_before(asks.repartition(7), ticks.repartition(5), ["symbol"], "ts", ["close"], bucket_seconds=3600))
    assert wide == {1: 10.0, 2: 5.0, 3: None}


def test_offsets(spark):
    df = spark.createDataFrame([(-1,), (-1_000_001,), (500_000,), (1_500_000,), (2_500_000,), (0,)], "us long")
    assert [r[0] for r in df.select(reaction.offset_seconds(F.col("us"))).collect()] == [-1, -2, 0, 2, 2, 0]


def test_moves_reasons(spark):
    ticks = spark.createDataFrame([("A", at(-5), 0.0), ("A", at(61), 3.0), ("B", at(-5), 2.0), ("B", at(61), 0.0), ("C", at(61), 3.0), ("D", at(-5), -2.0), ("D", at(61), 1.0)], "symbol string, ts timestamp_ntz, close double")
    events = spark.createDataFrame([(1, T0)], "event_id int, ts timestamp_ntz")
    names = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "symbol string")
    got = {(r["symbol"], r["horizon"]): (r["missing_reason"], r["move_percent"]) for r in reaction.reactions(events, names, ticks, (("1m", 1), ("30m", 30))).collect()}
    assert got["A", "1m"] == ("zero_baseline", None) and got["B", "1m"] == ("zero_target", None) and got["C", "1m"] == ("missing_baseline", None)
    assert got["D", "1m"] == (None, 150.0) and got["D", "30m"] == ("missing_target", None)


def test_matched_volatility(spark):
    rng = np.random.default_rng(0)
    times_, prices = np.cumsum(rng.integers(30, 90, 200)), rng.uniform(50, 150, 200)
    rows = [(1, float(t), float(p)) for t, p in zip(times_, prices, strict=True)] + [(1, 10.5, math.nan), (2, 1.0, 1.0)]
    got = {r["k"]: r for r in reaction.matched_volatility(spark.createDataFrame(rows, "k int, at double, close double"), ["k"], 300).collect()}
    gap, moves, i = float(np.median(np.diff(times_))), [], 0
    while i < 200:
        j = next((j for j in range(i, 200) if times_[j] >= times_[i] + 300), None)
        if j is None:
            break
        if times_[j] - times_[i] - 300 <= gap:
            moves.append((prices[j] / prices[i] - 1) * 100)
            i = j
        else:
            i += 1
    assert got[1]["pairs"] == len(moves) > 10 and abs(got[1]["volatility"] - np.std(moves)) < 1e-9
    assert got[2]["pairs"] == 0 and got[2]["volatility"] is None or math.isnan(got[2]["volatility"])


def test_calendar(spark):
    assert [reaction.easter(y) for y in (2024, 2025, 2026, 2038, 1981, 1954)] == [dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(2026, 4, 5), dt.date(2038, 4, 25), dt.date(1981, 4, 19), dt.date(1954, 4, 18)]
    assert reaction.us_holidays(2024) == {dt.date(2024, m, d) for m, d in ((1, 1), (1, 15), (2, 19), (3, 29), (5, 27), (6, 19), (7, 4), (9, 2), (11, 28), (12, 25))}
    assert reaction.us_early_closes(2024) == {dt.date(2024, 7, 3), dt.date(2024, 11, 29), dt.date(2024, 12, 24)}
    s = reaction.sessions(spark, dt.date(2024, 7, 1), dt.date(2024, 7, 5)).orderBy("day").collect()
    assert [(r["day"].day, r["minutes"], r["minutes_before"]) for r in s] == [(1, 390, 0), (2, 390, 390), (3, 210, 780), (5, 390, 990)]


def test_market_edges(spark):
    bars = spark.createDataFrame([("A", 1, 5.0), ("A", 2, 5.0), ("B", 1, 1.0), ("C", 1, 2.0), ("C", 2, -1.0), ("D", 1, math.nan), ("D", 2, 3.0), ("D", 3, 6.0)], "symbol string, bucket_s long, close double")
    v = {r["symbol"]: r["volatility"] for r in market.realized_volatility(bars).collect()}
    assert v["A"] == 0.0 and v["B"] is None and v["C"] is None and abs(v["D"] - math.log(2)) < 1e-12
    r = spark.createDataFrame([(s, t, x) for t in range(6) for s, x in (("A", 1.0), ("B", float(t * t)), ("C", float(-t * t)))], "symbol string, bucket_s long, ret double")
    got = {(x["a"], x["b"]): (x["correlation"], x["reason"]) for x in market.pair_correlations(r).collect()}
    assert got["A", "B"] == (None, "constant_returns") and abs(got["B", "C"][0] + 1) < 1e-12
    assert market.pair_correlations(r.filter("bucket_s < 3")).first()["reason"] == "insufficient_paired_samples"
    z = market.zscore_of_last(spark.createDataFrame([("A", T0, 1.0), ("A", at(1), 1.0)], "symbol string, ts timestamp_ntz, close double")).first()
    assert z["zscore"] is None


def test_numeric(spark):
    for a, b, reason in ((1.0, 0.0, "zero_denominator"), (None, 1.0, "missing_data"), (math.nan, 1.0, "non_finite"), (3.0, 2.0, None)):
        m = one(spark, numeric.return_metric(F.lit(a).cast("double"), F.lit(b)))
        assert m["reason"] == reason and m["value"] == (0.5 if reason is None else None)
    for a, b, n in (("2026-01-02", "2026-01-05", 2), ("2026-01-03", "2026-01-04", 0), ("2026-01-05", "2026-01-16", 10), ("2026-01-05", "2026-01-02", 0)):
        assert one(spark, times.business_days(F.lit(a).cast("date"), F.lit(b).cast("date"))) == n


def test_text(spark):
    assert one(spark, text.canonical_url(F.lit("HTTPS://Ex.COM/A/?utm_source=x&id=2&ref=3#top"))) == "https://ex.com/A/?id=2"
    assert one(spark, text.redact_secrets(F.lit("http://me:pw@h/x\n token: abc,b  API-key=q;"))) == "http://me:[REDACTED]@h/x token: [REDACTED],b API-key=[REDACTED];"
    assert one(spark, text.title_tokens(F.lit("The Fed, the ECB and a 25bp cut: FED!"))) == ["fed", "ecb", "25bp", "cut"]
    assert one(spark, text.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "noscript", "template")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "noscript", "template")

        def handle_data(self, data):
            if not self.skip:
                self.found.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").filter("html is not null")
    same = 0
    rows = pages.select("html", text.visible_text(F.col("html")).alias("t")).collect()
    for r in rows:
        parser = Text()
        parser.feed(r["html"])
        same += "".join(" ".join(parser.found).split()) == "".join(r["t"].split())
    assert same >= 0.9 * len(rows)


def test_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in keys.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in keys.insert_missing(old, new, ["k"], [F.asc("v")]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    later = spark.createDataFrame([(1, T0, at(5)), (2, T0, None), (3, at(9), T0)], "k int, e timestamp_ntz, a timestamp_ntz")
    assert [r["k"] for r in keys.as_known(later, F.lit(at(4)).cast("timestamp_ntz"), "e", "a").collect()] == [2]


def test_evidence(spark):
    schema = "thesis_id int, evidence_id int, evidence_type string, relationship string, quality_score double, entailment_score double, freshness_score double, effective_weight double, fingerprint string, independence_key string, source_family string, excerpt string"
    rows = [(1, i, "a", "supports", 1.0, 1.0, 1.0, 1.0, None, None, "fam", "x") for i in range(3)] + [(2, 9, "a", "supports", None, 1.0, 1.0, 1.0, None, None, None, "x"), (1, 7, "a", "supports", 0.1, 1.0, 1.0, 1.0, "f", None, "fam2", "x"), (1, 8, "a", "supports", 0.2, 1.0, 1.0, 1.0, "f", None, "fam2", "x")]
    got = {r["thesis_id"]: r for r in theses.assess_evidence(spark.createDataFrame(rows, schema)).collect()}
    assert abs(got[1]["support"] - (1 - math.exp(-1.95))) < 1e-12 and got[1]["n_unique"] == 4 and got[1]["groups"] == 2
    assert got[2]["confidence"] is None and got[2]["n_support"] == 0


def test_small_rules(spark):
    assert one(spark, macro.advance_stage(F.lit("reaction"), F.lit("t0"))) == "reaction" and one(spark, macro.advance_stage(F.lit(None).cast("string"), F.lit("final"))) == "final"
    s = one(spark, options.occ_symbol(F.lit("SPY   260116P00586500")))
    assert (s["root"], s["expiration"], s["kind"], s["strike"]) == ("SPY", dt.date(2026, 1, 16), "put", 586.5)
    assert one(spark, options.occ_symbol(F.lit("bad"))) is None
    cash = sum(100 * 1.05**k / 1.1**k for k in range(1, 6)) + 100 * 1.05**5 * 1.02 / 0.08 / 1.1**5
    assert abs(one(spark, companies.dcf(F.lit(100.0), F.lit(0.05), F.lit(0.1), F.lit(0.02))) - cash) < 1e-6
    assert one(spark, companies.dcf(F.lit(100.0), F.lit(0.1), F.lit(0.1), F.lit(0.1))) is None
    assert abs(one(spark, companies.dcf(F.lit(100.0), F.lit(0.1), F.lit(0.1), F.lit(0.0))) - 1500) < 1e-6
    assert one(spark, quality.materiality([F.lit(0.5), F.lit(1.2)])) is None
    assert one(spark, theses.neglect(F.lit(None).cast("double"), F.lit(0.25))) == 0.75


def test_freshness_states(spark):
    df = spark.createDataFrame([("old", dt.datetime(2026, 1, 1)), ("new", dt.datetime(2026, 1, 5, 1)), ("far", dt.datetime(2027, 1, 1)), ("none", None)], "k string, ts timestamp_ntz")
    got = {r["k"]: r["state"] for r in quality.freshness(df, "k", "ts", "2026-01-05 12:00:00", 30).collect()}
    assert got == {"old": "stale", "new": "fresh", "far": "future", "none": "no data"}
    friday = spark.createDataFrame([("k", dt.datetime(2026, 1, 2))], "k string, ts timestamp_ntz")
    assert quality.freshness(friday, "k", "ts", "2026-01-05 12:00:00", 24, daily=True).first()["state"] == "fresh"
    flat = spark.createDataFrame([("k", at(i), 1.0) for i in range(9)], "k string, ts timestamp_ntz, v double")
    assert quality.anomalies(flat, "k", "ts", "v").first()["anomalies"] == 0


def test_annual_facts(spark):
    d = dt.date
    rows = [
        ("a", "Sales", "USD", d(2024, 1, 1), d(2024, 12, 31), d(2025, 2, 1), 9.0), ("a", "Revenues", "USD", d(2024, 1, 1), d(2024, 12, 31), d(2025, 2, 1), 10.0), ("a", "Revenues", "USD", d(2024, 1, 1), d(2024, 12, 31), d(2025, 5, 1), 11.0),
        ("a", "Revenues", "USD", d(2023, 1, 1), d(2023, 12, 31), d(2024, 2, 1), 8.0), ("a", "Revenues", "USD", d(2024, 10, 1), d(2024, 12, 31), d(2025, 2, 1), 3.0), ("b", "Sales", "EUR", d(2024, 1, 1), d(2024, 12, 31), d(2025, 2, 1), 4.0),
    ]
    df = spark.createDataFrame(rows, "company string, concept string, unit string, period_start date, period_end date, filed date, value double")
    got = {r["company"]: (r["value"], r["prior"]) for r in companies.annual_facts(df, ["Revenues", "Sales"], ["USD", "EUR"]).collect()}
    assert got == {"a": (11.0, 8.0), "b": (4.0, None)}


def test_clusters_follow_arrival():
    c = stories.Clusters(100.0, 0.5)
    f = lambda *a: c.add(a[0], a[1], frozenset(a[2].split()), a[3])
    assert f(1, 0.0, "fed cuts rates", "x")[:2] == (1, "origin")
    assert f(2, 10.0, "fed cuts rates", "x")[:2] == (1, "repeated_coverage")
    assert f(3, 20.0, "fed cuts rates", "y")[:2] == (1, "cross_source_confirmation")
    assert f(4, 200.0, "fed cuts rates", "y")[:2] == (4, "origin")


def test_clusters_against_a_plain_loop():
    """Random items in order of arrival; scores, ties, the hundred stories seen last and what each item adds, from scratch."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(14)]
    made, at = [], 0.0
    for k in range(400):
        at += float(rng.integers(0, 3))
        some = lambda n: frozenset(str(x) for x in rng.choice(words, int(rng.integers(0, n)), replace=False))
        made.append((k, at, some(6) or frozenset(["w0"]), f"s{rng.integers(0, 3)}", bool(rng.random() < 0.1), some(2), some(2)))
    live: list[dict] = []
    want = []
    share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    for k, now, tokens, source, denial, entities, markets in made:
        scored = []
        for s in sorted((s for s in live if now - s["seen"] <= 30), key=lambda s: (s["seen"], s["id"]), reverse=True)[:100]:
            total = 0.65 * share(tokens, s["tokens"]) + 0.20 * share(entities, s["entities"]) + 0.10 * share(markets, s["markets"]) + 0.05 * (1 - (now - s["seen"]) / 30)
            scored.append((-round(total, 9), str(s["id"]), s))
        best = min(scored, key=lambda x: x[:2], default=None)
        if best is None or -best[0] < 0.55:
            live.append({"id": k, "seen": now, "tokens": tokens, "sources": {source}, "entities": set(entities), "markets": set(markets)})
            want.append((k, k, "origin"))
            continue
        s = best[2]
        if denial:
            kind = "contradiction"
        elif source not in s["sources"]:
            kind = "cross_source_confirmation"
        elif len(tokens - s["tokens"]) >= 0.25 * len(tokens | s["tokens"]) or entities - s["entities"] or markets - s["markets"]:
            kind = "material_update"
        else:
            kind = "repeated_coverage"
        s["seen"] = now
        s["sources"].add(source)
        s["entities"] |= entities
        s["markets"] |= markets
        want.append((k, s["id"], kind))
    c = stories.Clusters(30.0, 0.55)
    assert [(m[0], *c.add(*m)[:2]) for m in made] == want
    assert len({x[2] for x in want}) == 5
