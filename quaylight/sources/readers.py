"""Readers of feeds and files: each returns one DataFrame of typed rows, read by Spark from any path that it can open."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions.numeric import ratio
from quaylight.functions.text import canonical_url, loose_number, mail_or_iso_time, visible_text
from quaylight.operators.options import occ_symbol


def parse_time(text: Column, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy-MM", "yyyy")) -> Column:
    """The first format that fits, as a date; null if none does."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def macro_csv(spark: SparkSession, path: str, series_id: str, date: str, value: str, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy-MM", "yyyy")) -> DataFrame:
    """``series_id, observed_at, value`` of a CSV file with a header; rows without a date or a number are left out."""
    rows = spark.read.csv(path, header=True)
    out = rows.select(F.lit(series_id).alias("series_id"), parse_time(F.col(date), formats).alias("observed_at"), F.col(value).try_cast("double").alias("value"))
    return out.filter("observed_at is not null and value is not null")


def macro_vintages(spark: SparkSession, path: str, series_id: str | None, date: str = "date") -> DataFrame:
    """``series_id, observed_at, vintage, value, is_revision`` of JSON rows with a column for each vintage.

    A point stands for a missing value.  A vintage's column ends in its date (``NAME_20240131``); the second known value
    of an observation and later ones that differ from the one before are revisions.  Without a ``series_id`` the rows
    have a column of that name.
    """
    rows = spark.read.json(path)
    names = [c for c in rows.columns if c not in (date, "series_id")]
    name = F.lit(series_id) if series_id is not None else F.col("series_id")
    long = rows.select(name.alias("series_id"), F.col(date).alias("observed_at"), *[F.col(c).cast("string").alias(c) for c in names]).unpivot(["series_id", "observed_at"], names, "name", "text")
    vintage = F.try_to_date(F.regexp_extract("name", r"(\d{8})$", 1), "yyyyMMdd")
    known = long.select("series_id", F.to_date("observed_at").alias("observed_at"), vintage.alias("vintage"), F.nullif("text", F.lit(".")).try_cast("double").alias("value")).filter("value is not null")
    from quaylight.operators.keys import versions

    found = versions(known, ["series_id", "observed_at"], "vintage", "value")
    return found.select("series_id", "observed_at", "vintage", "value", (F.col("version") > 1).alias("is_revision"))


def latest_start(stored: DataFrame, ts: str, revision_days: int, first: str) -> str:
    """The day from which to read on: the latest stored one less the days that may still be revised."""
    last = stored.agg(F.date_sub(F.to_date(F.max(ts)), revision_days).cast("string").alias("d")).first()["d"]
    return last or first


def calendar_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``event_id, title, country, scheduled_at, impact, forecast, previous`` of an economic calendar's export, a list or one event a line."""
    rows = spark.read.schema("title string, country string, date string, impact string, forecast string, previous string").json(path, multiLine=not lines)
    impact = F.lower(F.trim("impact"))
    level = F.when(impact.isin("high", "red"), "high").when(impact.isin("medium", "orange"), "medium").when(impact.isin("low", "yellow"), "low").otherwise("unknown")
    at = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp("date"))
    id_ = F.sha2(F.concat_ws("|", "title", "country", "date"), 256)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(id_.alias("event_id"), "title", F.upper("country").alias("country"), at.alias("scheduled_at"), level.alias("impact"), blank("forecast").alias("forecast"), blank("previous").alias("previous"))


def positioning(rows: DataFrame, categories: Mapping[str, tuple[str, str]], open_interest: str, keep: Sequence[str]) -> DataFrame:
    """``keep..., category, long, short, net, net_percent``: wide reports with a row for each category.

    The share is null where the open interest is 0.
    """
    parts = F.array(*[F.struct(F.lit(name).alias("category"), F.col(a).cast("long").alias("long"), F.col(b).cast("long").alias("short")) for name, (a, b) in categories.items()])
    out = rows.select(*keep, F.col(open_interest).cast("long").alias("open_interest"), F.explode(parts).alias("p")).select(*keep, "open_interest", "p.*")
    net = F.col("long") - F.col("short")
    return out.withColumn("net", net).withColumn("net_percent", 100 * ratio("net", "open_interest"))


def short_volume(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sums by day and symbol, counts of bad rows by day and reason) of pipe-delimited daily files.

    The header names the columns, in any order.  A trailer, a number alone, is skipped.  Volumes are decimals.
    """
    rows = spark.read.csv(path, header=True, sep="|", mode="PERMISSIVE", enforceSchema=False)
    volume = lambda c: F.col(c).try_cast("decimal(38,6)")
    rows = rows.filter(~((F.col("Symbol").isNull()) & F.coalesce(F.col("Date").rlike(r"^\d+$"), F.lit(False))))
    typed = rows.select(F.try_to_date("Date", "yyyyMMdd").alias("day"), F.upper(F.trim("Symbol")).alias("symbol"), volume("ShortVolume").alias("short"), volume("ShortExemptVolume").alias("exempt"), volume("TotalVolume").alias("total"), F.col("Market").alias("market"))
    bad = F.when(F.col("day").isNull(), "date").when(F.col("symbol").isNull() | (F.col("symbol") == ""), "symbol").when(F.col("short").isNull() | F.col("total").isNull(), "volume").when(F.col("short") > F.col("total"), "short_over_total")
    typed = typed.withColumn("bad", bad)
    good = typed.filter("bad is null").groupBy("day", "symbol").agg(
        F.sum("short").alias("short"), F.sum("exempt").alias("exempt"), F.sum("total").alias("total"), F.array_join(F.array_sort(F.collect_set("market")), ",").alias("markets"), F.count("*").alias("rows")
    )
    return good, typed.filter("bad is not null").groupBy("day", "bad").agg(F.count("*").alias("rows"))


def ownership_xml(spark: SparkSession, path: str) -> DataFrame:
    """``accession, issuer, owner, day, code, acquired, shares, price`` of ownership documents in XML."""
    value = "struct<value:string>"
    row = f"struct<transactionDate:{value},transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:{value},transactionPricePerShare:{value},transactionAcquiredDisposedCode:{value}>>"
    schema = f"accession string, issuer struct<issuerTradingSymbol:string>, reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>>, nonDerivativeTable struct<nonDerivativeTransaction:array<{row}>>"
    docs = spark.read.format("xml").option("rowTag", "ownershipDocument").schema(schema).load(path)
    flat = docs.select("accession", F.col("issuer.issuerTradingSymbol").alias("issuer"), F.col("reportingOwner.reportingOwnerId.rptOwnerName").alias("owner"), F.explode("nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    number = lambda c: F.col(c).try_cast("double")
    amounts = "t.transactionAmounts"
    return flat.select(
        "accession", "issuer", "owner", F.try_to_date("t.transactionDate.value").alias("day"), F.col("t.transactionCoding.transactionCode").alias("code"),
        F.col(f"{amounts}.transactionAcquiredDisposedCode.value").alias("acquired"), number(f"{amounts}.transactionShares.value").alias("shares"), number(f"{amounts}.transactionPricePerShare.value").alias("price"),
    )


def insider_days(trades: DataFrame, amended: DataFrame | None = None) -> DataFrame:
    """``issuer, day, owners, filings, bought, sold, other, net, net_value`` of ownership rows.

    ``amended`` holds rows of amended filings; they replace base rows of the same issuer, owner and day.
    """
    key = ["issuer", "owner", "day"]
    if amended is not None:
        trades = trades.join(amended.select(*key).distinct(), key, "left_anti").unionByName(amended)
    side = F.when(F.col("acquired") == "A", 1).when(F.col("acquired") == "D", -1)
    buy, sell = (F.col("code") == "P") & (side == 1), (F.col("code") == "S") & (side == -1)
    shares = lambda on: F.coalesce(F.sum(F.when(on, F.col("shares"))), F.lit(0.0))
    value = lambda on: F.coalesce(F.sum(F.when(on, F.col("shares") * F.col("price"))), F.lit(0.0))
    g = trades.groupBy("issuer", "day").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("accession").alias("filings"), shares(buy).alias("bought"), shares(sell).alias("sold"),
        F.count_if(F.coalesce(~buy & ~sell, F.lit(True))).alias("other"), (value(buy) - value(sell)).alias("net_value"),
    )
    return g.withColumn("net", F.col("bought") - F.col("sold"))


def option_chain_json(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, captured_at, root, expiration, kind, strike, bid, ask, iv, volume, open_interest, spot`` of chain files."""
    schema = "timestamp string, symbol string, data struct<current_price:double,options:array<struct<option:string,bid:double,ask:double,iv:double,volume:double,open_interest:double,last_trade_price:double>>>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    flat = docs.select("symbol", F.try_to_timestamp("timestamp").alias("captured_at"), F.col("data.current_price").alias("spot"), F.explode("data.options").alias("o"))
    out = flat.select("symbol", "captured_at", "spot", occ_symbol(F.col("o.option")).alias("s"), "o.*").filter("s is not null and s.expiration is not null")
    return out.select("symbol", "captured_at", F.col("s.root").alias("root"), F.col("s.expiration").alias("expiration"), F.col("s.kind").alias("kind"), F.col("s.strike").alias("strike"), "bid", "ask", F.col("last_trade_price").alias("last"), "iv", "volume", "open_interest", "spot")


def equity_bars_json(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, day, open, high, low, close, volume`` of files that hold parallel arrays; bars without a close are left out."""
    numbers = "array<double>"
    schema = f"symbol string, timestamp array<long>, open {numbers}, high {numbers}, low {numbers}, close {numbers}, volume array<long>"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    bars = docs.select("symbol", F.explode(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume")).alias("b"))
    return bars.select("symbol", F.to_date(F.timestamp_seconds("b.timestamp")).alias("day"), "b.open", "b.high", "b.low", "b.close", "b.volume").filter("close is not null and not isnan(close)")


_DIVIDEND, _SPLIT = "struct<amount:double>", "struct<numerator:double,denominator:double,splitRatio:string>"
_CHART = f"struct<chart:struct<result:array<struct<meta:struct<symbol:string>,events:struct<dividends:map<string,{_DIVIDEND}>,splits:map<string,{_SPLIT}>>>>>>"


def corporate_actions(payloads: DataFrame, keep: Sequence[str] = (), json: str = "payload") -> DataFrame:
    """``keep..., symbol, action, effective, at, amount, numerator, denominator, description`` of chart payloads: dividends and splits.

    An event's key is its time in seconds.  Events without a time, or whose amount or parts aren't above 0 and finite, go.  A
    split without a text of its own is described by its parts.
    """
    rows = payloads.select(*keep, F.explode(F.from_json(json, _CHART)["chart"]["result"]).alias("r")).select(*keep, F.upper(F.trim("r.meta.symbol")).alias("symbol"), "r.events")
    none, number = F.lit(None).cast("double"), lambda c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
    plain = lambda c: F.regexp_replace(F.format_number(c, 6), r"(,|\.?0+$)", "")
    at = F.timestamp_seconds(F.col("k").try_cast("long"))
    parts = []
    for action, bucket in (("dividend", "dividends"), ("split", "splits")):
        each = rows.select(*keep, "symbol", F.explode(f"events.{bucket}").alias("k", "e")).withColumn("at", at)
        amount, up, down = (number("e.amount"), none, none) if action == "dividend" else (none, number("e.numerator"), number("e.denominator"))
        shown = F.lit(None).cast("string") if action == "dividend" else F.coalesce(F.nullif(F.trim("e.splitRatio"), F.lit("")), F.concat(plain(up), F.lit(":"), plain(down)))
        parts.append(each.select(*keep, "symbol", F.lit(action).alias("action"), F.to_date("at").alias("effective"), "at", amount.alias("amount"), up.alias("numerator"), down.alias("denominator"), shown.alias("description")))
    return parts[0].unionByName(parts[1]).filter("at is not null and symbol <> '' and (amount is not null or (numerator is not null and denominator is not null))")


def feed_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``id, title, url, published_at, summary`` of RSS (``rss``) or Atom (``atom``) files or a news site map (``sitemap``)."""
    if kind == "rss":
        rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
        link, at, summary = F.col("link"), F.col("pubDate"), F.col("description")
    elif kind == "atom":
        rows = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href:string>, updated string, summary string").load(path)
        link, at, summary = F.col("link._href"), F.col("updated"), F.col("summary")
    elif kind == "sitemap":
        rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, `news:news` struct<`news:title`:string>").load(path)
        link, at, summary = F.col("loc"), F.col("lastmod"), F.lit(None).cast("string")
        rows = rows.withColumn("title", F.col("`news:news`.`news:title`"))
    else:
        raise ValueError(f"unknown kind of feed: {kind}")
    when = mail_or_iso_time(at)
    url = canonical_url(link)
    return rows.select(F.sha2(url, 256).alias("id"), F.trim("title").alias("title"), url.alias("url"), when.alias("published_at"), visible_text(summary).alias("summary"))


_ROW = "struct<positions:string,holders:string,shares:string>"
_SECTION = f"struct<rows:array<{_ROW}>>"
_FIELD = "struct<value:string>"
_TYPED = "struct<label:string,holders:double,shares:double>"
HOLDINGS = (
    f"struct<data:struct<ownershipSummary:struct<SharesOutstandingPCT:{_FIELD},ShareoutstandingTotal:{_FIELD},TotalHoldingsValue:{_FIELD}>,activePositions:{_SECTION},newSoldOutPositions:{_SECTION},"
    "holdingsTransactions:struct<table:struct<rows:array<struct<ownerName:string,date:string,sharesHeld:string,sharesChange:string,sharesChangePCT:string,marketValue:string>>>>>>"
)


def holdings(payloads: DataFrame, keep: Sequence[str], json: str = "payload") -> DataFrame:
    """``keep..., ownership_percent, shares_millions, value_millions, active, changed`` of payloads of institutional holdings.

    ``active`` and ``changed`` are lists of ``label, holders, shares``; rows without a label or without any number go.
    """
    data = payloads.select(*keep, F.from_json(json, HOLDINGS)["data"].alias("d"))
    summary = lambda c: loose_number(F.col(f"d.ownershipSummary.{c}.value"))

    def rows(section: str) -> Column:
        typed = F.transform(F.col(f"d.{section}.rows"), lambda r: F.struct(F.replace(F.lower(F.trim(r["positions"])), F.lit(" "), F.lit("_")).alias("label"), loose_number(r["holders"]).alias("holders"), loose_number(r["shares"]).alias("shares")))
        return F.coalesce(F.filter(typed, lambda r: (r["label"] != "") & F.coalesce(r["holders"], r["shares"]).isNotNull()), F.array().cast(f"array<{_TYPED}>"))

    return data.select(*keep, summary("SharesOutstandingPCT").alias("ownership_percent"), summary("ShareoutstandingTotal").alias("shares_millions"), summary("TotalHoldingsValue").alias("value_millions"), rows("activePositions").alias("active"), rows("newSoldOutPositions").alias("changed"))


def top_holders(payloads: DataFrame, keep: Sequence[str], json: str = "payload", most: int = 10) -> DataFrame:
    """``keep..., place, holder, reported, shares_held, shares_change, change_percent, value``: the first ``most`` rows that name a holder."""
    rows = payloads.select(*keep, F.posexplode(F.slice(F.from_json(json, HOLDINGS)["data"]["holdingsTransactions"]["table"]["rows"], 1, most)).alias("place", "r"))
    numbers = {"sharesHeld": "shares_held", "sharesChange": "shares_change", "sharesChangePCT": "change_percent", "marketValue": "value"}
    out = rows.select(*keep, "place", F.trim("r.ownerName").alias("holder"), F.nullif(F.trim("r.date"), F.lit("")).alias("reported"), *[loose_number(F.col(f"r.{a}")).alias(b) for a, b in numbers.items()])
    return out.filter("holder <> ''")


def short_interest(payloads: DataFrame, keep: Sequence[str], json: str = "payload", most: int = 24) -> DataFrame:
    """``keep..., settled, shares, daily_volume, days_to_cover`` of the first ``most`` rows of payloads; rows without a date go."""
    schema = "struct<data:struct<shortInterestTable:struct<rows:array<struct<settlementDate:string,interest:string,avgDailyShareVolume:string,daysToCover:string>>>>>"
    rows = payloads.select(*keep, F.explode(F.slice(F.from_json(json, schema)["data"]["shortInterestTable"]["rows"], 1, most)).alias("r"))
    out = rows.select(*keep, F.try_to_date(F.trim("r.settlementDate"), "MM/dd/yyyy").alias("settled"), *[loose_number(F.col(f"r.{a}")).alias(b) for a, b in (("interest", "shares"), ("avgDailyShareVolume", "daily_volume"), ("daysToCover", "days_to_cover"))])
    return out.filter("settled is not null")


def company_facts(payloads: DataFrame, keep: Sequence[str], json: str = "payload", filing: str = "filing_id") -> DataFrame:
    """``keep..., concept, unit, period_start, period_end, filed, value, scaled_unit`` of payloads of tagged facts.

    Only facts of the payload's own filing count, without a segment and with a finite number.  Money and shares are in
    millions.  ``companies.annual_facts`` picks concept, unit and periods.
    """
    entry = "struct<start:string,end:string,val:string,accn:string,filed:string,segment:string>"
    schema = f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<{entry}>>>>>>"
    by_concept = payloads.select(*keep, filing, F.explode(F.from_json(json, schema)["facts"]["us-gaap"]).alias("concept", "c"))
    flat = by_concept.select(*keep, filing, "concept", F.explode("c.units").alias("unit", "e")).select(*keep, filing, "concept", "unit", F.explode("e").alias("e"))
    number = F.col("e.val").try_cast("double")
    flat = flat.filter((F.col("e.accn") == F.col(filing)) & (F.coalesce("e.segment", F.lit("")) == "") & ~F.isnan(number) & (F.abs(number) < float("inf")))
    money, shares = F.col("unit").rlike("^[A-Za-z]{3}$"), F.lower("unit") == "shares"
    unit = F.when(money, F.concat("unit", F.lit("m"))).when(shares, "million shares").when(F.lower("unit").isin("usd/shares", "usd/share"), "USD/share").otherwise(F.col("unit"))
    day = lambda c: F.try_to_date(f"e.{c}", "yyyy-MM-dd")
    return flat.select(*keep, "concept", "unit", day("start").alias("period_start"), day("end").alias("period_end"), day("filed").alias("filed"), F.when(money | shares, number / 1_000_000).otherwise(number).alias("value"), unit.alias("scaled_unit"))


def relevant(items: DataFrame, sections: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Items whose URL has one of the sections or whose title one of the keywords as a word."""
    by_section = F.lit(False)
    for s in sections:
        by_section = by_section | F.contains("url", F.lit(f"/{s}/"))
    return items.filter(by_section | F.lower("title").rlike(r"(?<!\w)(" + "|".join(sorted(map(str.lower, keywords))) + r")(?!\w)"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified, sha256`` of files as they lie; their text is extracted elsewhere."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def requested(spark: SparkSession, keys: Sequence[str], name: str = "key") -> DataFrame:
    """A stated list of keys as a table, in order."""
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"{name} string, place int")


def tables(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Registers Parquet tables of a folder as views for SQL text."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def universe(theses: DataFrame, configured: Sequence[str], limit: int) -> DataFrame:
    """``symbol, place``: configured symbols, then those of active theses by their best score, each once."""
    spark = theses.sparkSession
    own = spark.createDataFrame([(s.strip().upper(), float(-i)) for i, s in enumerate(configured)], "symbol string, score double")
    symbol = F.upper(F.trim("symbol"))
    more = theses.filter((F.col("status") == "active") & (symbol != "")).groupBy(symbol.alias("symbol")).agg(F.max("score").alias("score"))
    more = more.join(own.select("symbol"), "symbol", "left_anti").orderBy(F.col("score").desc_nulls_last(), "symbol").limit(limit)
    both = own.withColumn("own", F.lit(0)).unionByName(more.withColumn("own", F.lit(1)))
    from pyspark.sql import Window

    return both.select("symbol", F.row_number().over(Window.orderBy("own", F.col("score").desc_nulls_last(), "symbol")).alias("place"))
