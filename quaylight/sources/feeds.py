"""Items of feeds whose form is told by their content: RSS, Atom, site maps of news, JSON-LD payloads and pages that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.text import canonical_url, mail_or_iso_time, visible_text

# Kinds of JSON-LD objects that are items.
DOCUMENTS = ("Article", "BlogPosting", "NewsArticle", "Report", "WebPage")
#: Levels of lists, graphs and wrapped items that are opened.
DEPTH = 8
#: Columns of an item besides the feed's key.
ITEM = ["form", "title", "url", "guid", "published_at", "updated_at", "published_from", "content", "publisher", "author"]

_RSS = "channel struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,description:string,author:string>>>"
_ATOM = "entry array<struct<title:string,id:string,published:string,updated:string,summary:string,content:string,link:array<struct<_href:string,_rel:string>>,author:struct<name:string>>>"
_MAP = "url array<struct<loc:string,lastmod:string,news:struct<title:string,publication_date:string>>>"


def feed_form(body: Column) -> Column:
    """``jsonld``, ``rss``, ``atom``, ``sitemap`` or ``html`` (a page with JSON-LD in it), or null: by what a body holds, not by its name."""
    start = F.lower(F.regexp_extract(body, r"(?s)^\x{FEFF}?\s*(.{0,2048})", 1))
    root = F.regexp_extract(start, r"(?s)^(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*|<!doctype[^>]*>\s*)*<([a-z:]+)", 1)
    return (
        F.when(start.rlike(r"^[\[{]"), "jsonld").when(root.isin("rss", "rdf:rdf"), "rss").when(root == "feed", "atom").when(root == "urlset", "sitemap")
        .when(body.rlike(r"(?is)<script[^>]*application/ld\+json"), "html")
    )


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _https(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)^https?://[^/\s]+"), url)


def _xml_items(bodies: DataFrame, key: str) -> DataFrame:
    """Items of the forms in XML, in one read of the bodies."""
    none = F.lit(None).cast("string")
    names = ("title", "url", "guid", "published", "updated", "from", "content", "author")
    part = lambda *columns: F.struct(*[c.alias(n) for n, c in zip(names, columns, strict=True)])

    def rss(i: Column) -> Column:
        return part(i["title"], i["link"], i["guid"], i["pubDate"], none, none, i["description"], i["author"])

    def atom(i: Column) -> Column:
        own = F.filter(i["link"], lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate")
        published = _text(i["published"])
        url = F.coalesce(F.get(own, F.lit(0))["_href"], i["link"][0]["_href"])
        return part(i["title"], url, i["id"], F.coalesce(published, i["updated"]), i["updated"], F.when(published.isNull(), "updated"), F.coalesce(_text(i["summary"]), i["content"]), i["author"]["name"])

    def sitemap(i: Column) -> Column:
        published = _text(i["news"]["publication_date"])
        return part(i["news"]["title"], i["loc"], none, F.coalesce(published, i["lastmod"]), i["lastmod"], F.when(published.isNull(), "lastmod"), none, none)

    # prefixes of names don't matter to a site map's news
    plain = F.regexp_replace("body", r"<(/?)news:", "<$1")
    items = (
        F.when(F.col("form") == "rss", F.transform(F.from_xml("body", _RSS)["channel"]["item"], rss)).when(F.col("form") == "atom", F.transform(F.from_xml("body", _ATOM)["entry"], atom))
        .when(F.col("form") == "sitemap", F.transform(F.from_xml(plain, _MAP)["url"], sitemap))
    )
    rows = bodies.filter("form in ('rss', 'atom', 'sitemap')").select(key, "form", F.posexplode(items).alias("place", "i"))
    return rows.select(key, "form", F.array("place").alias("at"), *[F.col(f"i.{n}").alias(n) for n in names], none.alias("publisher"))


def _at(v: str | Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, f"$['{name}']", kind)


def _list(v: str) -> Column:
    """Members of a list, or null.  Unlike the schema of a variant, they don't merge the types of all members."""
    return F.try_variant_get(v, "$", "array<variant>")


def _is_object(v: str) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _strings(v: str) -> Column:
    """An object's members that are strings with something in them, bare, by name."""
    member = F.try_variant_get(v, "$", "map<string,variant>")
    texts = F.transform_values(F.map_filter(member, lambda _, m: F.schema_of_variant(m) == "STRING"), lambda _, m: F.trim(F.try_variant_get(m, "$", "string")))
    return F.map_filter(texts, lambda _, t: t != "")


def _types(v: str) -> Column:
    """Names of an object's types, without what leads to them."""
    of = F.coalesce(_at(v, "@type", "variant"), _at(v, "type", "variant"))
    names = F.when(F.schema_of_variant(of).startswith("ARRAY"), F.try_variant_get(of, "$", "array<string>")).when(F.schema_of_variant(of) == "STRING", F.array(F.try_variant_get(of, "$", "string")))
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.element_at(F.split(n, "/"), -1))


def jsonld_documents(values: DataFrame, key: str, value: str = "v") -> DataFrame:
    """``key, at, v``: the items in JSON-LD values, in order: lists, graphs, item lists and wrapped items are opened, ``DEPTH`` levels of them."""
    now = values.select(key, F.col(value).alias("v"), F.array(F.lit(0)).alias("at"), F.lit(False).alias("done"))
    none = F.array().cast("array<variant>")
    for _ in range(DEPTH):
        # what is an item already is looked into no more
        open_ = {"listed": _at("v", "itemListElement", "variant"), "graph": _at("v", "@graph", "variant"), "wrapped": _at("v", "item", "variant"), "types": _types("v"), "members": _list("v"), "is_object": _is_object("v")}
        now = now.withColumns({name: F.when(~F.col("done"), c) for name, c in open_.items()})
        held = lambda name: F.col(name).isNotNull() & (_list(name).isNotNull() | _is_object(name))
        now = now.withColumns({"in_graph": held("graph"), "in_list": F.array_contains("types", "ItemList") | F.col("listed").isNotNull(), "in_item": held("wrapped"), "is_list": F.col("members").isNotNull()})
        members = (
            F.when(F.col("done"), F.array("v")).when(F.col("is_list"), F.col("members")).when(~F.col("is_object"), none).when(F.col("in_graph"), F.array("graph"))
            .when(F.col("in_list"), F.when(F.col("listed").isNotNull(), F.array("listed")).otherwise(none)).when(F.col("in_item"), F.array("wrapped"))
            .when(F.arrays_overlap("types", F.array(*[F.lit(d) for d in DOCUMENTS])), F.array("v")).otherwise(none)
        )
        done = F.col("done") | (F.col("is_object") & ~F.col("in_graph") & ~F.col("in_list") & ~F.col("in_item"))
        now = now.select(key, "at", done.alias("done"), F.posexplode(members).alias("k", "v")).select(key, "v", F.concat("at", F.array("k")).alias("at"), "done")
    return now.filter("done").select(key, "at", "v")


def _jsonld_items(bodies: DataFrame, key: str) -> DataFrame:
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<script\b[^>]*\btype\s*=\s*['\"]application/ld\+json(?:;[^'\"]*)?['\"][^>]*>(.*?)</script\s*>"), 1)
    texts = bodies.filter("form in ('jsonld', 'html')").select(key, "form", F.posexplode(F.when(F.col("form") == "html", blocks).otherwise(F.array("body"))).alias("block", "text"))
    values = texts.select(F.struct(key, "form", "block").alias("of"), F.try_parse_json(F.regexp_replace("text", r"^\x{FEFF}", "")).alias("v")).filter("v is not null")
    found = jsonld_documents(values, "of")
    # each member is read once
    found = found.select("of", "at", "v", _strings("v").alias("texts"))
    own = lambda n: F.col("texts")[n]
    first = lambda *names: F.coalesce(*[own(n) for n in names])
    named = lambda n: F.coalesce(own(n), _text(F.try_variant_get("v", f"$['{n}']['name']", "string")))
    links = [F.coalesce(_https(own(n)), *[_https(F.try_variant_get("v", f"$['{n}']['{s}']", "string")) for s in ("@id", "url")]) for n in ("url", "mainEntityOfPage", "@id")]
    dates = ("datePublished", "dateCreated", "dateModified")
    origin = F.coalesce(*[F.when(own(n).isNotNull(), n) for n in dates])
    return found.select(
        F.col(f"of.{key}").alias(key), F.col("of.form").alias("form"), F.concat(F.array("of.block"), "at").alias("at"), first("headline", "name", "title").alias("title"), F.coalesce(*links).alias("url"), own("@id").alias("guid"), first(*dates).alias("published"),
        own("dateModified").alias("updated"), F.when(origin != "datePublished", origin).alias("from"), first("description", "articleBody", "text").alias("content"), named("author").alias("author"), named("publisher").alias("publisher"),
    )


def feed_items(bodies: DataFrame, key: str = "feed", body: str = "body") -> DataFrame:
    """``key, place`` and ``ITEM`` columns of feeds of any form, each in the order of its items from 0 on.

    Texts are bare, addresses canonical, times in UTC; ``published_from`` names the member that stands in for the time of
    publication.  Items without a title or an address with a host are left out, and so are feeds of no known form, null ones
    and JSON that can't be read.
    """
    told = bodies.select(key, F.col(body).alias("body")).withColumn("form", feed_form(F.col("body"))).filter("form is not null")
    raw = _xml_items(told, key).unionByName(_jsonld_items(told, key))
    title, url = _text(visible_text(F.col("title"))), canonical_url(_https(F.trim("url")))
    # as a list of one or none, since a filter on its columns would clean each title and address twice
    told = raw.withColumn("told", F.array(F.struct(title.alias("title"), url.alias("url"))))
    kept = told.withColumn("told", F.explode(F.filter("told", lambda t: t["title"].isNotNull() & t["url"].isNotNull())))
    out = kept.select(
        key, "form", "at", "told.title", "told.url", _text(F.col("guid")).alias("guid"), mail_or_iso_time(F.col("published")).alias("published_at"), mail_or_iso_time(F.col("updated")).alias("updated_at"),
        F.col("from").alias("published_from"), _text(visible_text(F.col("content"))).alias("content"), _text(F.col("publisher")).alias("publisher"), _text(F.col("author")).alias("author"),
    )
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).select(key, "place", *ITEM)
