"""Feeds of several forms in one read."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from quaylight.plans import files
from quaylight.sources import feeds

RSS = "<?xml version='1.0'?>\n<!-- c --><rss version='2.0'><channel><title>T</title><item><title>One &amp; all</title><link>HTTPS://A.com/1?utm_source=x</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Body&lt;/p&gt;</description></item><item><title> </title><link>https://a.com/2</link></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Two</title><id>i2</id><link rel='self' href='https://a.com/self'/><link href='https://a.com/two'/><updated>2024-01-03T00:00:00Z</updated><author><name>Ann</name></author></entry></feed>"
SITE = "<urlset xmlns:news='n'><url><loc>https://a.com/m</loc><lastmod>2024-01-04T00:00:00Z</lastmod><news:news><news:title>Map</news:title></news:news></url></urlset>"
GRAPH = {"@graph": [{"@type": "WebSite", "name": "no"}, {"@type": ["https://schema.org/NewsArticle"], "headline": " <b>Three</b> ", "url": "nohost", "mainEntityOfPage": {"@id": "https://a.com/three#x"}, "dateCreated": "2024-01-05T01:00:00+01:00", "dateModified": "2024-01-06", "publisher": {"name": "P"}, "author": "Q", "@id": "g3"},
    {"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "Report", "name": "Four", "url": "https://a.com/4", "datePublished": "2024-01-07T00:00:00Z", "description": "d"}}, {"item": [{"@type": "Thing", "name": "x", "url": "https://a.com/x"}]}]}]}
PAGE = '<html><head><script type="application/ld+json">' + json.dumps([[{"type": "Article", "title": "Five", "@id": "https://a.com/5", "datePublished": 5}]]) + '</script><script>var x = {"@type": "Article"}</script><SCRIPT TYPE="application/ld+json; charset=utf-8">{broken</SCRIPT></head></html>'


def test_forms_in_one_read(spark):
    bodies = {"rss": RSS, "atom": ATOM, "site": SITE, "json": "﻿ " + json.dumps(GRAPH), "page": PAGE, "none": "hello <b>", "null": None, "bad": "{", "empty": ""}
    df = spark.createDataFrame(list(bodies.items()), "feed string, body string")
    forms = {r["feed"]: r["f"] for r in df.select("feed", feeds.feed_form(F.col("body")).alias("f")).collect()}
    assert forms == {"rss": "rss", "atom": "atom", "site": "sitemap", "json": "jsonld", "page": "html", "none": None, "null": None, "bad": "jsonld", "empty": None}
    rows = {(r["feed"], r["place"]): r for r in feeds.feed_items(df).collect()}
    short = {k: (r["title"], r["url"], r["published_at"], r["published_from"], r["content"], r["author"], r["publisher"], r["guid"]) for k, r in rows.items()}
    at = lambda d: dt.datetime(2024, 1, d)
    assert short == {
        ("rss", 0): ("One & all", "https://a.com/1", dt.datetime(2024, 1, 2, 10), None, "Body", None, None, None), ("atom", 0): ("Two", "https://a.com/two", at(3), "updated", None, "Ann", None, "i2"), ("site", 0): ("Map", "https://a.com/m", at(4), "lastmod", None, None, None, None),
        ("json", 0): ("Three", "https://a.com/three", at(5), "dateCreated", None, "Q", "P", "g3"), ("json", 1): ("Four", "https://a.com/4", at(7), None, "d", None, None, None), ("page", 0): ("Five", "https://a.com/5", None, None, None, None, None, "https://a.com/5"),
    }
    assert feeds.feed_items(df.limit(0)).count() == 0


def test_items_are_cleaned_once(spark):
    """The forms in XML are parsed in one read, and no filter cleans titles and addresses a second time."""
    plan = feeds.feed_items(spark.createDataFrame([("a", RSS)], "feed string, body string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(CASE WHEN") >= 1 and sum("from_xml" in line for line in plan.splitlines()) <= 1
    assert not [line for line in plan.splitlines() if "Filter" in line and "&nbsp;" in line]


def test_members_of_other_kinds(spark):
    """Members that aren't strings, are blank or null don't count; empty lists and objects, values in lists and items deep in lists."""
    item = {"@type": "Report", "headline": 5, "name": " ", "title": " Deep ", "url": ["https://a.com/no"], "mainEntityOfPage": {"url": "https://a.com/d"}, "datePublished": None, "dateModified": "2024-01-06", "description": {"x": 1}, "articleBody": "b", "publisher": {"name": ""}}
    values = [[], {}, 7, None, "x", {"@graph": "x", "@type": "Thing"}, {"@graph": []}, {"item": "y", "type": "Article", "title": "Own", "@id": "https://a.com/o"}, [[[[[item]]]]], [[[[[[[[item]]]]]]]]]
    rows = feeds.feed_items(spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "feed int, body string")).collect()
    got = {(r["feed"], r["title"], r["url"], r["published_at"], r["published_from"], r["content"], r["publisher"]) for r in rows}
    assert got == {(7, "Own", "https://a.com/o", None, None, None, None), (8, "Deep", "https://a.com/d", dt.datetime(2024, 1, 6), "dateModified", "b", None)}


def test_site_maps_are_dealt_to_the_sessions_tasks(spark):
    """Maps that are small in a shuffle are still read in as many tasks as the session has."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(files.src18_relevant_news(spark, "/root/testdata/sf0.001")._jdf.queryExecution(), "simple")
    assert "hashpartitioning(feed#" in plan and f", {n}), REPARTITION_BY_NUM" in plan
