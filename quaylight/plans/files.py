"""Readers and sinks over files that are written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions import text
from quaylight.plans.base import query, table
from quaylight.sources import feeds, readers, sinks
from quaylight.sources.scratch import Scratch


def written(spark: SparkSession, name: str, rows: DataFrame, form: str, **options: str) -> str:
    path = Scratch(spark, name).path(name)
    rows.write.format(form).options(**options).save(path)
    return path


@query("""WITH d AS (SELECT o_custkey, o_orderdate::DATE AS day, max(o_orderkey) AS k FROM orders GROUP BY ALL), v AS (SELECT *, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN NULL ELSE k END AS a, CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN NULL ELSE k END AS b FROM d)
SELECT o_custkey || '' AS series_id, day AS observed_at, DATE '2024-01-31' AS vintage, a::DOUBLE AS value, false AS is_revision FROM v WHERE a IS NOT NULL
UNION ALL SELECT o_custkey || '', day, DATE '2024-02-29', b::DOUBLE, a IS NOT NULL FROM v WHERE b IS NOT NULL AND (a IS NULL OR a <> b)""")
def src02_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide vintages as JSON rows; the series' name goes with the observation's day and is split off again."""
    d = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("k"))
    value = lambda n: F.when(F.col("k") % n == 0, "1.0").when(F.col("k") % n == 1, ".").otherwise(F.col("k").cast("string"))
    rows = d.select(F.col("o_custkey").cast("string").alias("series_id"), F.col("day").cast("string").alias("date"), value(3).alias("X_20240131"), value(4).alias("X_20240229"))
    path = written(spark, "src02", rows, "json")
    return readers.macro_vintages(spark, path, None)


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'n/a' END AS d, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v FROM orders)
SELECT 'prices' AS series_id, CASE length(d) WHEN 10 THEN d WHEN 7 THEN d || '-01' ELSE d || '-01-01' END::DATE AS observed_at, v AS value FROM r WHERE d <> 'n/a' AND v IS NOT NULL""")
def src04_macro_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    d = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "yyyy-MM")).when(k % 4 == 2, F.date_format(day, "yyyy")).otherwise("n/a")
    rows = table(spark, sf_dir, "orders").select(d.alias("TIME_PERIOD"), F.when(k % 5 != 0, F.col("o_totalprice").cast("string")).otherwise("-").alias("OBS_VALUE"))
    return readers.macro_csv(spark, written(spark, "src04", rows, "csv", header="true"), "prices", "TIME_PERIOD", "OBS_VALUE")


@query("""WITH r AS (SELECT l_shipdate::DATE AS day, 'P' || (l_partkey % 50) AS symbol, l_quantity - 10 AS short, l_linenumber - 1 AS exempt, 40 AS total, l_returnflag AS market FROM lineitem WHERE l_orderkey % 7 <> 0)
SELECT day, symbol, sum(short)::DOUBLE AS short, sum(exempt)::DOUBLE AS exempt, sum(total)::DOUBLE AS total, array_to_string(list_sort(list_distinct(list(market))), ',') AS markets, count(*) AS rows FROM r WHERE short <= total GROUP BY ALL""")
def src08_short_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily files with lines that lack a day, which don't count."""
    bad = F.col("l_orderkey") % 7 == 0
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(bad, "?").otherwise(F.date_format("l_shipdate", "yyyyMMdd")).alias("Date"), F.concat(F.lit(" p"), F.col("l_partkey") % 50).alias("Symbol"), (F.col("l_quantity") - 10).alias("ShortVolume"),
        (F.col("l_linenumber") - 1).alias("ShortExemptVolume"), F.lit(40).alias("TotalVolume"), F.col("l_returnflag").alias("Market"),
    )
    good, _ = readers.short_volume(spark, written(spark, "src08", rows, "csv", header="true", sep="|"))
    return good.withColumns({c: F.col(c).cast("double") for c in ("short", "exempt", "total")})


@query("""SELECT sha256('http://feed.example/' || event_id) AS id, event_type || ' & ' || event_id AS title, 'http://feed.example/' || event_id AS url, date_trunc('second', ts) AS published_at, 'user ' || user_id AS summary FROM events""")
def src14_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as RSS, with the times of mail headers."""
    link = F.concat(F.lit("HTTP://Feed.example/"), "event_id", F.lit("?utm_source=x"))
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws(" & ", "event_type", F.col("event_id").cast("string")).alias("title"), link.alias("link"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"), F.concat(F.lit("<p>user <b>"), "user_id", F.lit("</b></p>")).alias("description"),
    )
    items = readers.feed_items(spark, written(spark, "src14", rows, "xml", rootTag="channel", rowTag="item"), "rss")
    return items.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("""SELECT l_orderkey, l_shipdate::DATE AS settled, CASE WHEN l_linenumber % 4 <> 0 THEN round(l_extendedprice) END AS shares, CASE WHEN l_linenumber % 3 = 0 THEN -l_quantity ELSE l_quantity END AS daily_volume, l_discount AS days_to_cover FROM lineitem WHERE l_linenumber <> 5""")
def src12_short_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each order: seven rows at most, some without a date or a number."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    row = F.struct(
        F.when(n == 5, "soon").otherwise(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("settlementDate"), F.when(n % 4 == 0, "N/A").otherwise(F.format_number(F.round("l_extendedprice"), 0)).alias("interest"),
        F.when(n % 3 == 0, F.concat(F.lit("("), q, F.lit(")"))).otherwise(F.concat(F.lit("$"), q)).alias("avgDailyShareVolume"), F.col("l_discount").cast("string").alias("daysToCover"),
    )
    body = F.struct(F.struct(F.struct(F.collect_list(row).alias("rows")).alias("shortInterestTable")).alias("data"))
    return readers.short_interest(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(body).alias("payload")), ["l_orderkey"])


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    position = lambda label, holders, shares: F.struct(F.lit(label).alias("positions"), holders.alias("holders"), shares.alias("shares"))
    value = lambda c: F.struct(c.cast("string").alias("value"))
    whole = F.format_number((key * 1000).cast("long"), 0)
    active = F.array(position("Increased Positions", key.cast("string"), whole), position("Held Positions", F.lit("--"), F.lit("n/a")), position(" ", key.cast("string"), whole))
    holder = lambda k: F.struct(F.when(key % 3 == k, " ").otherwise(F.concat(F.lit(f"H{k} "), key)).alias("ownerName"), F.lit("12/31/2023").alias("date"), whole.alias("sharesHeld"), F.concat(F.lit("("), key, F.lit(")")).alias("sharesChange"), F.concat(key % 9, F.lit(".5%")).alias("sharesChangePCT"), F.lit("x").alias("marketValue"))
    data = F.struct(
        F.struct(value(F.concat(key % 100, F.lit("%"))).alias("SharesOutstandingPCT"), value(whole).alias("ShareoutstandingTotal"), value(F.concat(F.lit("$"), F.col("s_acctbal"))).alias("TotalHoldingsValue")).alias("ownershipSummary"),
        F.struct(active.alias("rows")).alias("activePositions"), F.struct(F.struct(F.array(*[holder(k) for k in range(3)]).alias("rows")).alias("table")).alias("holdingsTransactions"),
    )
    return table(spark, sf_dir, "supplier").select(key, F.to_json(F.struct(data.alias("data"))).alias("payload"))


@query("""SELECT s_suppkey, (s_suppkey % 100)::DOUBLE AS ownership_percent, s_suppkey * 1000.0 AS shares_millions, s_acctbal AS value_millions, 'increased_positions' AS labels, s_suppkey::DOUBLE AS holders, 0 AS changed FROM supplier""")
def src24_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = readers.holdings(_holdings(spark, sf_dir), ["s_suppkey"])
    return h.select("s_suppkey", "ownership_percent", "shares_millions", "value_millions", F.array_join("active.label", ",").alias("labels"), F.col("active.holders")[0].alias("holders"), F.size("changed").alias("changed"))


@query("""SELECT s_suppkey, k AS place, 'H' || k || ' ' || s_suppkey AS holder, '12/31/2023' AS reported, s_suppkey * 1000.0 AS shares_held, -s_suppkey::DOUBLE AS shares_change, s_suppkey % 9 + 0.5 AS change_percent, NULL::DOUBLE AS value FROM supplier, (SELECT unnest(range(3)) AS k) WHERE s_suppkey % 3 <> k""")
def src24_top_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.top_holders(_holdings(spark, sf_dir), ["s_suppkey"])


@query("""SELECT 'a' AS part, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'late' ELSE o_orderstatus END AS state FROM orders UNION ALL SELECT 'b', c_custkey, c_mktsegment FROM customer""")
def snk03_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables change by one commit; a second batch changes one of them, and one of a wrong schema changes nothing."""
    both = sinks.Manifest(spark, Scratch(spark, "snk03").path("tables"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    both.write({"a": a, "b": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"))}, {"a": "id long, state string"})
    both.write({"a": both.read("a").withColumn("state", F.when(F.col("id") % 2 == 0, "late").otherwise(F.col("state")))}, {"a": "id long, state string"})
    try:
        both.write({"b": a.limit(0), "a": a.select("state", "id")}, {"a": "id long, state string"})
    except ValueError:
        pass
    return both.read("a").select(F.lit("a").alias("part"), "id", "state").unionByName(both.read("b").select(F.lit("b").alias("part"), "id", "state"))


@query("""SELECT user_id || '' AS id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def snk08_merged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "snk08").path("items")
    items = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), "event_id", "value")
    sinks.merge_json(spark, folder, items.filter("event_id % 2 = 0"), "id", "event_id")
    return sinks.merge_json(spark, folder, items.filter("event_id % 2 = 1").unionByName(items.limit(1).withColumn("id", F.lit(""))), "id", "event_id")


@query("""SELECT c_custkey, 'at http://' || c_custkey || ':[REDACTED]@db/x token= [REDACTED]; Pwd:[REDACTED],' || c_name AS message FROM customer""")
def fn21_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("at\n http://"), "c_custkey", F.lit(":p!"), "c_custkey", F.lit("@db/x  token=  s"), "c_custkey", F.lit("; Pwd:q"), "c_custkey", F.lit(","), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.redact_secrets(raw).alias("message"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS at FROM events""")
def fn22_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as mail headers, in another zone, as ISO 8601 with and without a zone, and no time."""
    forms = ["EEE, dd MMM yyyy HH:mm:ss 'GMT'", "dd MMM yyyy HH:mm:ss '+0200'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss"]
    raw = F.lit("soon")
    for k, form in enumerate(forms):
        raw = F.when(F.col("event_id") % 5 == k, F.date_format("ts", form)).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", text.mail_or_iso_time(raw).cast("timestamp_ntz").alias("at"))


@query("""SELECT s_suppkey AS company, 'k' || k AS concept, u AS unit, DATE '2023-01-01' AS period_start, DATE '2023-12-31' AS period_end, DATE '2024-02-01' + k::INT AS filed, CASE WHEN u = 'USD' THEN s_acctbal / 1000000 WHEN u = 'shares' THEN s_suppkey::DOUBLE / 1000000 ELSE 1.25 END AS value,
  CASE u WHEN 'USD' THEN 'USDm' WHEN 'shares' THEN 'million shares' ELSE 'USD/share' END AS scaled_unit FROM supplier, (SELECT unnest(range(3)) AS k, unnest(['USD', 'shares', 'USD/shares']) AS u)""")
def src20_company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of tagged facts for each supplier; facts of a segment, of other filings or without a number don't count."""
    k = F.col("s_suppkey")
    fact = lambda n, value, segment=None, accession=F.lit("f1"): F.struct(F.lit("2023-01-01").alias("start"), F.lit("2023-12-31").alias("end"), value.cast("string").alias("val"), accession.alias("accn"), F.lit(f"2024-02-0{n + 1}").alias("filed"), F.lit(segment).cast("string").alias("segment"))
    facts = [("USD", F.col("s_acctbal")), ("shares", k), ("USD/shares", F.lit(1.25))]
    entries = lambda n, v: F.array(fact(n, v), fact(n, v, "north"), fact(n, F.lit("x")), fact(n, v, None, F.lit("f0")))
    concepts = F.create_map(*[x for n, (unit, v) in enumerate(facts) for x in (F.lit(f"k{n}"), F.struct(F.create_map(F.lit(unit), entries(n, v)).alias("units")))])
    payload = F.to_json(F.struct(F.struct(concepts.alias("us-gaap")).alias("facts")))
    return readers.company_facts(table(spark, sf_dir, "supplier").select(k.alias("company"), F.lit("f1").alias("filing_id"), payload.alias("payload")), ["company"])


@query("""SELECT 'P' || (l_partkey % 30) AS issuer, l_shipdate::DATE AS day, count(DISTINCT 'S' || l_suppkey) AS owners, count(DISTINCT l_orderkey) AS filings, coalesce(sum(l_quantity) FILTER (l_linenumber % 3 = 0), 0) AS bought, coalesce(sum(l_quantity) FILTER (l_linenumber % 3 = 1), 0) AS sold,
  count(*) FILTER (l_linenumber % 3 = 2) AS other, coalesce(sum(l_quantity * 2) FILTER (l_linenumber % 3 = 0), 0) - coalesce(sum(l_quantity * 2) FILTER (l_linenumber % 3 = 1), 0) AS net_value,
  coalesce(sum(l_quantity) FILTER (l_linenumber % 3 = 0), 0) - coalesce(sum(l_quantity) FILTER (l_linenumber % 3 = 1), 0) AS net FROM lineitem GROUP BY ALL""")
def src09_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership documents in XML, one for each line of an order: bought, sold or granted.

    Their names and spaces take 60 times their values, so the files are compressed; several of them, as none can be split.
    """
    n = F.col("l_linenumber") % 3
    value = lambda c, name: F.struct(c.cast("string").alias("value")).alias(name)
    amounts = F.struct(value(F.col("l_quantity"), "transactionShares"), value(F.lit(2), "transactionPricePerShare"), value(F.when(n == 1, "D").otherwise("A"), "transactionAcquiredDisposedCode"))
    trade = F.struct(value(F.date_format("l_shipdate", "yyyy-MM-dd"), "transactionDate"), F.struct(F.when(n == 0, "P").when(n == 1, "S").otherwise("M").alias("transactionCode")).alias("transactionCoding"), amounts.alias("transactionAmounts"))
    docs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("A"), "l_orderkey").alias("accession"), F.struct(F.concat(F.lit("P"), F.col("l_partkey") % 30).alias("issuerTradingSymbol")).alias("issuer"), F.struct(F.struct(F.concat(F.lit("S"), "l_suppkey").alias("rptOwnerName")).alias("reportingOwnerId")).alias("reportingOwner"),
        F.struct(F.array(trade).alias("nonDerivativeTransaction")).alias("nonDerivativeTable"),
    )
    return readers.insider_days(readers.ownership_xml(spark, written(spark, "src09", docs, "xml", rootTag="all", rowTag="ownershipDocument", compression="gzip", maxRecordsPerFile="200000")))


@query("""SELECT 'u' || user_id AS feed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, list_extract(['rss', 'atom', 'jsonld', 'html'], (user_id % 4)::INT + 1) AS form, event_type || ' & ' || event_id AS title, 'https://feed.example/' || event_id AS url,
  date_trunc('second', ts) AS published_at, CASE WHEN user_id % 4 = 1 THEN 'updated' WHEN user_id % 4 > 1 AND event_id % 2 = 0 THEN 'dateModified' END AS published_from, 'value ' || event_id AS content, CASE WHEN user_id % 4 > 1 THEN 'desk' END AS publisher FROM events""")
def src14_mixed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each user in one of four forms, read together: RSS, Atom, a JSON-LD graph, and a page with item lists."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    title, link = F.concat(F.col("event_type"), F.lit(" & "), k), F.concat(F.lit("HTTPS://Feed.example/"), k, F.lit("?utm_source=x#top"))
    mail, iso = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    escaped, tag = F.replace(title, F.lit("&"), F.lit("&amp;")), lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    value = F.concat(F.lit("value "), k)
    rss = tag("item", F.concat(tag("title", escaped), tag("link", F.replace(link, F.lit("&"), F.lit("&amp;"))), tag("pubDate", mail), tag("description", F.concat(F.lit("&lt;p&gt;"), value, F.lit("&lt;/p&gt;")))))
    atom = tag("entry", F.concat(tag("title", escaped), F.lit("<link href='"), link, F.lit("'/>"), tag("updated", iso), tag("summary", value)))
    document = F.struct(F.lit("https://schema.org/NewsArticle").alias("@type"), title.alias("headline"), F.struct(link.alias("@id")).alias("mainEntityOfPage"), F.when(k % 2 == 1, iso).alias("datePublished"), F.when(k % 2 == 0, iso).alias("dateModified"), value.alias("description"), F.struct(F.lit("desk").alias("name")).alias("publisher"))
    item = F.when(F.col("user_id") % 4 == 0, rss).when(F.col("user_id") % 4 == 1, atom).when(F.col("user_id") % 4 == 2, F.to_json(document)).otherwise(F.to_json(F.struct(F.lit("ListItem").alias("@type"), document.alias("item"))))
    users = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", item.alias("x")))).alias("all")).select("user_id", "all.x")
    joined = lambda by: F.array_join("x", by)
    body = (
        F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("<?xml version='1.0'?><rss><channel>"), joined(""), F.lit("</channel></rss>"))).when(F.col("user_id") % 4 == 1, F.concat(F.lit("<feed>"), joined(""), F.lit("</feed>")))
        .when(F.col("user_id") % 4 == 2, F.concat(F.lit('{"@context":"https://schema.org","@graph":['), joined(","), F.lit("]}")))
        .otherwise(F.concat(F.lit('<html><script type="application/ld+json">[{"@type":"WebSite","name":"x"},{"@type":"ItemList","itemListElement":['), joined(","), F.lit("]}]</script></html>")))
    )
    path = written(spark, "src14_mixed", users.select(F.concat(F.lit("u"), "user_id").alias("feed"), body.alias("body")), "json")
    found = feeds.feed_items(spark.read.schema("feed string, body string").json(path))
    return found.select("feed", "place", "form", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "published_from", "content", "publisher")


@query("""WITH d AS (SELECT l_suppkey AS k, epoch_us(l_shipdate) // 1000000 AS s, max(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'S' || k AS symbol, 'dividend' AS action, make_timestamp(s * 1000000)::DATE AS effective, q::DOUBLE AS amount, NULL::DOUBLE AS numerator, NULL::DOUBLE AS denominator, NULL AS description FROM d WHERE n = 1 AND q > 5
UNION ALL SELECT 'S' || k, 'split', make_timestamp(s * 1000000)::DATE, NULL, n::DOUBLE, 0.5, CASE WHEN k % 2 = 0 THEN 'for ' || n ELSE n || ':0.5' END FROM d WHERE n > 1""")
def src11_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart payload for each supplier; amounts below 0 and keys that are no time don't count."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string").alias("s")).agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    dividend = F.when(F.col("n") == 1, F.struct("s", F.struct(F.when(F.col("q") > 5, F.col("q")).otherwise(-F.col("q")).alias("amount"))))
    split = F.when(F.col("n") > 1, F.struct("s", F.struct(F.col("n").cast("double").alias("numerator"), F.lit(0.5).alias("denominator"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("for "), "n")).alias("splitRatio"))))
    g = d.groupBy("k").agg(F.map_from_entries(F.collect_list(dividend)).alias("dividends"), F.map_from_entries(F.concat(F.collect_list(split), F.array(F.struct(F.lit("never").alias("s"), F.struct(F.lit(1.0).alias("numerator"), F.lit(1.0).alias("denominator"), F.lit("x").alias("splitRatio")).alias("col2"))))).alias("splits"))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit(" s"), "k").alias("symbol")).alias("meta"), F.struct("dividends", "splits").alias("events"))).alias("result")).alias("chart")))
    return readers.corporate_actions(g.select(payload.alias("payload"))).drop("at")


@query("""SELECT sha256('release ' || o_orderkey || '|usd|' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '-05:00') AS event_id, 'release ' || o_orderkey AS title, 'USD' AS country, o_orderdate + INTERVAL 5 HOUR AS scheduled_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS impact, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey || '%' END AS forecast, NULL AS previous FROM orders""")
def src05_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An economic calendar's export: zones, colours for weights, blank figures."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("release "), k).alias("title"), F.lit("usd").alias("country"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")).alias("date"),
        F.when(k % 4 == 0, " Red ").when(k % 4 == 1, "medium").when(k % 4 == 2, "YELLOW").otherwise("grey").alias("impact"), F.when(k % 3 > 0, F.concat(k.cast("string"), F.lit("%"))).otherwise(" ").alias("forecast"), F.lit("").alias("previous"),
    )
    return readers.calendar_json(spark, written(spark, "src05", rows, "json"), lines=True).withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp_ntz"))


@query("""SELECT 'https://news.example/' || CASE WHEN event_id % 3 = 0 THEN 'markets' ELSE 'sport' END || '/' || event_id AS url, event_type || ' of the ' || CASE WHEN event_id % 5 = 0 THEN 'Fed' ELSE 'federation' END AS title, date_trunc('second', ts) AS published_at FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0""")
def src18_relevant_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site maps of news, kept by section or by a keyword as a word of its own."""
    k = F.col("event_id")
    tag = lambda name, *c: F.concat(F.lit(f"<{name}>"), *c, F.lit(f"</{name}>"))
    where = tag("loc", F.lit("https://news.example/"), F.when(k % 3 == 0, "markets").otherwise("sport"), F.lit("/"), k.cast("string"))
    title = tag("news:news", tag("news:title", F.col("event_type"), F.lit(" of the "), F.when(k % 5 == 0, "Fed").otherwise("federation")))
    rows = table(spark, sf_dir, "events").select("user_id", tag("url", where, tag("lastmod", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), title).alias("x"))
    # so many tasks as the session has: a map's text is small in a shuffle and long in the reading, so its size tells little
    dealt = rows.withColumnRenamed("user_id", "feed").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "feed")
    maps = dealt.groupBy("feed").agg(tag("urlset", F.array_join(F.collect_list("x"), "\n")).alias("body"))
    found = readers.relevant(feeds.feed_items(maps), ["markets"], ["fed"])
    return found.select("url", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""SELECT count(*) AS n FROM lineitem WHERE l_shipdate::DATE >= (SELECT max(l_shipdate)::DATE - 30 FROM lineitem)""")
def src03_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reads again: from the latest stored day less the days that may still be revised."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate")
    return lines.filter(F.to_date("l_shipdate") >= readers.latest_start(lines, "l_shipdate", 30, "1990-01-01")).agg(F.count("*").alias("n"))
