"""Readers, sinks and streams on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quaylight.functions import text
from quaylight.operators import stories
from quaylight.sources import readers, sinks
from quaylight.sources.scratch import Scratch
from quaylight.streaming import streams


@pytest.fixture
def put(tmp_path):
    def write(name: str, body: str) -> str:
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    return write


def test_macro(spark, put):
    rows = readers.macro_csv(spark, put("a.csv", "d,v\n2024,1.5\n2024-02,x\n2024-03-05,2\n,3\n"), "s", "d", "v").collect()
    assert [(r["observed_at"], r["value"]) for r in rows] == [(dt.date(2024, 1, 1), 1.5), (dt.date(2024, 3, 5), 2.0)]
    body = json.dumps({"date": "2024-01-01", "X_20240201": "1.0", "X_20240301": ".", "X_20240401": "1.0", "X_20240501": "2.0"})
    got = readers.macro_vintages(spark, put("v.json", body), "X").orderBy("vintage").collect()
    assert [(r["value"], r["is_revision"]) for r in got] == [(1.0, False), (2.0, True)]
    stored = spark.createDataFrame([(dt.date(2024, 5, 10),)], "d date")
    assert readers.latest_start(stored, "d", 30, "1990-01-01") == "2024-04-10" and readers.latest_start(stored.limit(0), "d", 30, "1990-01-01") == "1990-01-01"


def test_calendar_and_chain(spark, put):
    got = readers.calendar_json(spark, put("c.json", json.dumps([{"title": "CPI", "country": "usd", "date": "2024-01-11T08:30:00-05:00", "impact": "Red", "forecast": " ", "previous": "3.1%"}]))).first()
    assert (got["country"], got["impact"], got["forecast"], got["previous"]) == ("USD", "high", None, "3.1%") and got["scheduled_at"].hour == 13
    chain = {"timestamp": "2024-01-11 15:00:00", "symbol": "SPY", "data": {"current_price": 470.5, "options": [{"option": "SPY240119C00470000", "bid": 1.0, "ask": 2.0, "iv": 0.1}, {"option": "junk"}]}}
    assert [(r["kind"], r["strike"], r["spot"]) for r in readers.option_chain_json(spark, put("o.json", json.dumps(chain))).collect()] == [("call", 470.0, 470.5)]
    bars = {"symbol": "A", "timestamp": [1704067200, 1704153600], "open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [1.5, None], "volume": [10, 20]}
    assert [(r["day"], r["close"]) for r in readers.equity_bars_json(spark, put("b.json", json.dumps(bars))).collect()] == [(dt.date(2024, 1, 1), 1.5)]


def test_short_volume(spark, put):
    path = put("s.txt", "Symbol|Date|ShortVolume|ShortExemptVolume|TotalVolume|Market\nabc|20240102|10.5|0|20|Q\nABC|20240102|1.5|1|5|N\nBAD|20240102|9|0|5|Q\nX|2024|1|0|2|Q\n|4|||\n")
    good, bad = readers.short_volume(spark, path)
    r = good.first()
    assert (r["symbol"], float(r["short"]), float(r["total"]), r["markets"], r["rows"]) == ("ABC", 12.0, 25.0, "N,Q", 2)
    assert {x["bad"]: x["rows"] for x in bad.collect()}["short_over_total"] == 1


def test_ownership(spark, put):
    trade = lambda code, side, n: f"<nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{n}</value></transactionShares><transactionPricePerShare><value>2</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>{side}</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"
    doc = "<ownershipDocument><accession>1</accession><issuer><issuerTradingSymbol>ABC</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Z</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>" + trade("P", "A", 10) + trade("S", "D", 4) + trade("M", "A", 1) + "</nonDerivativeTable></ownershipDocument>"
    days = readers.insider_days(readers.ownership_xml(spark, put("f.xml", f"<all>{doc}</all>"))).first()
    assert (days["bought"], days["sold"], days["other"], days["net"], days["net_value"]) == (10.0, 4.0, 1, 6.0, 12.0)


def test_feeds(spark, put):
    rss = put("r.xml", "<rss><channel><item><title> Hi </title><link>HTTP://A.com/x?utm_source=1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Rates&lt;/p&gt;</description></item></channel></rss>")
    r = readers.feed_items(spark, rss, "rss").first()
    assert (r["title"], r["url"], r["summary"]) == ("Hi", "http://a.com/x", "Rates") and r["published_at"].hour == 10
    atom = put("a.xml", '<feed><entry><title>T</title><link href="http://b.com/"/><updated>2024-01-02T03:04:05Z</updated><summary>s</summary></entry></feed>')
    r = readers.feed_items(spark, atom, "atom").first()
    assert (r["url"], r["published_at"].hour) == ("http://b.com", 3)
    items = spark.createDataFrame([("http://a/markets/x", "nothing"), ("http://a/b", "The Fed moves"), ("http://a/c", "Federal")], "url string, title string")
    assert readers.relevant(items, ["markets"], ["fed"]).count() == 2


def test_universe(spark):
    t = spark.createDataFrame([(" abc", "active", 1.0), ("ABC", "active", 3.0), ("xyz", "active", None), ("old", "closed", 9.0), ("own", "active", 5.0)], "symbol string, status string, score double")
    assert [r["symbol"] for r in readers.universe(t, ["own"], 5).orderBy("place").collect()] == ["OWN", "ABC", "XYZ"]


def test_tables(spark, tmp_path):
    table = sinks.Table(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    now = lambda: {tuple(r) for r in table.read().collect()}
    table.upsert(frame([(1, "a"), (2, "b")]), ["k"])
    table.upsert(frame([(2, "c")]), ["k"])
    assert now() == {(1, "a"), (2, "c")} and table.version() == 2
    table.insert_missing(frame([(2, "z"), (3, "d")]), ["k"], ["v"])
    assert now() == {(1, "a"), (2, "c"), (3, "d")}
    table.replace_keys(frame([(1, "x"), (1, "y")]), ["k"])
    assert now() == {(1, "x"), (1, "y"), (2, "c"), (3, "d")}
    with pytest.raises(ValueError):
        sinks.write_together({"t": (table, frame([(9, "q")]))}, {"t": "k int, v int"})
    assert table.version() == 4
    snapshots = sinks.Table(spark, f"file://{tmp_path}/s")
    for day, body in ((1, "a"), (2, "a"), (3, "b")):
        snapshots.publish(spark.createDataFrame([("k", body, dt.date(2024, 1, day))], "k string, body string, at date"), ["k"], ["body"], "at")
    assert sorted((r["version"], r["body"], r["superseded_at"]) for r in snapshots.read().collect()) == [(1, "a", dt.date(2024, 1, 3)), (2, "b", None)]
    bad = sinks.illegal_transitions(frame([(1, "open"), (2, "open")]), frame([(1, "done"), (2, "gone")]), ["k"], "v", {"open": ["done"]})
    assert [r["k"] for r in bad.collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null")
    items = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 3600.0).alias("at"), text.title_tokens(F.substring_index("text", "\n", 1)).alias("tokens"), "source", (F.col("doc_id") % 17 == 0).alias("denial"), F.array("source").alias("entities"), F.array_compact(F.array("lang")).alias("markets"), F.coalesce("lang", F.lit("")).alias("block"))
    for k, (a, b) in enumerate(((0, 80), (80, 150), (150, 10**9))):
        items.filter(f"id >= {a} and id < {b}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    (tmp_path / "flat").mkdir()
    scratch = Scratch(spark, "test")
    out = None
    for k in range(3):
        for p in (tmp_path / f"in/{k}").glob("*.parquet"):
            p.rename(tmp_path / "flat" / f"{k}.parquet")
        out = streams.run_into(streams.cluster_stories(streams.stream(spark, str(tmp_path / "flat")), ["block"], 259200.0, 0.3), scratch, "clusters")
    batch = stories.cluster_blocks(items, ["block"], 259200.0, 0.3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_late_and_repeated(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    frame = lambda rows: spark.createDataFrame([(s, t0 + dt.timedelta(minutes=m), v) for s, m, v in rows], "symbol string, ts timestamp, close double")
    scratch = Scratch(spark, "late")
    bars = None
    for k, rows in enumerate(([("A", 1, 1.0), ("A", 50, 3.0)], [("A", 30, 2.0), ("A", 500, 9.0)], [("A", 10, 99.0), ("A", 900, 5.0)])):
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
        bars = streams.run_into(streams.rollup(streams.stream(spark, str(tmp_path / "ticks")), 3600), scratch, "bars")
        del k
    first = bars.orderBy("bucket_s").first()
    assert (first["open"], first["high"], first["close"], first["n"]) == (1.0, 3.0, 3.0, 3)
