"""Evidence: candidate groups, references, lineage, sections and excerpts of filings, relationships, late and pending rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.text import collapse_space, let
from quaylight.operators import asof, keys
from quaylight.sources.scratch import Scratch

#: Ranks of the kinds of blocking keys; fixed values.
KINDS = {"story": 5, "entity": 4, "industry": 3, "phrase": 2, "term": 1}
#: Headings of the parts of a filing, by category; fixed values.
SECTIONS = {
    "guidance": r"(?:outlook|guidance|forward[\s-]?looking statements?)",
    "risk_language": r"risk factors?",
    "segments": r"(?:segment|business segment) (?:reporting|information|results)",
    "margins_cashflow": r"(?:liquidity and capital resources|cash flows?|operating results|margin)",
    "capex": r"capital expenditures?",
    "balance_sheet": r"(?:balance sheet|indebtedness|financial position)",
    "capital_allocation": r"(?:capital allocation|dividends?|share repurchases?|buybacks?)",
    "commitments": r"(?:commitments? and contingencies?|material contracts?)",
    "management_language": r"(?:management'?s discussion|md&a|strategic review|operating review)",
}
#: For each alternative of a heading's pattern a part of it that every match has, in small letters; fixed values.
LITERALS = {
    SECTIONS["guidance"]: ("outlook", "guidance", "forward"),
    SECTIONS["risk_language"]: ("risk factor",),
    SECTIONS["segments"]: ("segment ",),
    SECTIONS["margins_cashflow"]: ("liquidity and capital resources", "cash flow", "operating results", "margin"),
    SECTIONS["capex"]: ("capital expenditure",),
    SECTIONS["balance_sheet"]: ("balance sheet", "indebtedness", "financial position"),
    SECTIONS["capital_allocation"]: ("capital allocation", "dividend", "share repurchase", "buyback"),
    SECTIONS["commitments"]: ("commitment", "material contract"),
    SECTIONS["management_language"]: ("discussion", "md&a", "strategic review", "operating review"),
}
#: Share of equal word pairs from which two versions of a section count as unchanged, and the length of an excerpt.
UNCHANGED, EXCERPT = 0.98, 500


def phrases(terms: Column) -> Column:
    """Distinct pairs of neighbouring words that differ, joined by a hyphen; none for fewer than two words."""
    pairs = F.zip_with(terms, F.slice(terms, F.lit(2), F.size(terms)), lambda a, b: F.when(a != b, F.concat_ws("-", a, b)))
    return F.array_distinct(F.array_compact(pairs))


def candidate_groups(items: DataFrame, least: int, sources: int, most_terms: int = 120, keys_per_item: int = 20, per_group: int = 20) -> DataFrame:
    """``key, ids, items, sources, latest``: groups of items that share a blocking key, each no part of a higher-ranked one.

    ``items``: ``id, origin, is_claim, at, source, story, entities, industries, terms`` (the last three arrays; entities as
    ``kind:name``, terms in order).  Words and phrases block if they are among the ``most_terms`` that most origins share, two
    at least; an item blocks by its first ``keys_per_item`` keys.  Of one origin one item counts, rather not a claim, then
    the least id.  A group holds its latest ``per_group`` items.  Kinds rank first, then sources, size (of words: the
    smaller the higher), the latest time, the key.  A null story or array blocks nothing; null sources don't count.
    """
    prefix = lambda kind, a: F.transform(F.array_distinct(F.coalesce(a, F.array().cast("array<string>"))), lambda x: F.concat(F.lit(f"{kind}:"), x))
    words = F.concat(prefix("term", F.col("terms")), prefix("phrase", phrases(F.col("terms"))))
    row = F.struct("id", "origin", "is_claim", "at", "source")
    spread = items.select(row.alias("r"), F.explode(F.coalesce(words, F.array().cast("array<string>"))).alias("key"))
    shared = spread.groupBy("key").agg(F.countDistinct("r.origin").alias("n")).filter("n >= 2").withColumn("kind", F.substring_index("key", ":", 1))
    # at most ``most_terms`` words and as many phrases
    frequent = keys.top_n(shared, ["kind"], [F.desc("n"), F.asc("key")], most_terms).select("key")
    named = F.concat(F.array_compact(F.array(F.when(F.trim("story") != "", F.concat(F.lit("story:"), F.lower(F.trim("story")))))), prefix("entity", F.col("entities")), prefix("industry", F.col("industries")))
    flat = spread.join(F.broadcast(frequent), "key", "left_semi").select("r", "key").unionByName(items.select(row.alias("r"), F.explode(named).alias("key")))
    few = flat.groupBy("r").agg(F.slice(F.array_sort(F.collect_set("key")), 1, keys_per_item).alias("few")).select("r.*", F.explode("few").alias("key"))
    one = few.groupBy("key", "origin").agg(F.min_by(F.struct("id", "at", "source"), F.struct("is_claim", "id")).alias("r")).select("key", "origin", "r.*")
    kept = keys.top_n(one, ["key"], [F.desc("at"), F.desc("id")], per_group)
    g = kept.groupBy("key").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"), F.max("at").alias("latest"), F.collect_set("origin").alias("origins"), F.array_sort(F.collect_list("id")).alias("ids"))
    kind = F.substring_index("key", ":", 1)
    value = F.lit(0)
    for name, place in KINDS.items():
        value = F.when(kind == name, place).otherwise(value)
    size = F.when(kind.isin("term", "phrase"), -F.col("items")).otherwise(F.col("items"))
    g = g.filter((F.col("items") >= least) & (F.col("sources") >= sources)).withColumn("rank", F.struct(value, "sources", size, "latest", "key"))
    # a group that holds another one holds its rarest origin too
    member = g.select("key", "rank", "origins", F.explode("origins").alias("origin"))
    rarest = member.join(member.groupBy("origin").agg(F.count("*").alias("n")), "origin").groupBy("key").agg(F.min_by("origin", F.struct("n", "origin")).alias("origin"))
    low = g.join(rarest, "key").select(F.col("key").alias("part"), F.col("rank").alias("part_rank"), F.col("origins").alias("part_origins"), "origin")
    inside = low.join(member, "origin").filter((F.col("rank") > F.col("part_rank")) & (F.size(F.array_except("part_origins", "origins")) == 0))
    return g.join(inside.select(F.col("part").alias("key")).distinct(), "key", "left_anti").select("key", "ids", "items", "sources", "latest")


def evidence_by_reference(refs: DataFrame, evidence: DataFrame, cutoff: Column) -> DataFrame:
    """Evidence rows that the references (``kind:id`` in ``ref``) name and that were known at the cutoff, each once.

    ``evidence``: ``kind, id, available_at`` and more.  Rows without a time aren't known at any cutoff.
    """
    wanted = refs.select(F.substring_index("ref", ":", 1).alias("kind"), F.substring("ref", F.instr(F.col("ref"), ":") + 1, F.length("ref")).alias("id")).distinct()
    return evidence.filter(F.col("available_at") <= cutoff).join(wanted, ["kind", "id"], "left_semi")


def lineage(links: DataFrame, by: str, at: str, columns: Sequence[str], most: int) -> DataFrame:
    """The latest ``most`` pieces of evidence of each series, ``place`` from 1."""
    order = [F.desc(at), *[F.desc(c) for c in columns]]
    return keys.top_n(links, [by], order, most, "place").select(by, "place", at, *columns)


def sections(text: Column, patterns: Mapping[str, str] = SECTIONS) -> Column:
    """Map of category to the text after its first heading, up to the next heading of any kind; plain and in small letters.

    Whole texts are read; a category without a heading has no entry.  Only patterns of which a text has one of the
    ``LITERALS`` are looked for in it, as plain words are found far faster than patterns.
    """
    plain = lambda t: F.lower(collapse_space(t))

    def candidates(low: Column) -> Column:
        may = lambda p: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in LITERALS[p]]) if p in LITERALS else F.lit(True)
        return F.array_compact(F.array(*[F.when(may(p), F.struct(F.lit(c).alias("key"), F.lit(p).alias("pattern"))) for c, p in patterns.items()]))

    def bodies(s: Column) -> Column:
        any_ = F.concat(F.lit("(?i)"), s["any"])
        after = lambda p: F.get(F.split(s["text"], F.concat(F.lit("(?i)"), p), 2), F.lit(1))
        return F.transform(s["found"], lambda x: F.struct(x["key"].alias("key"), plain(F.split(after(x["pattern"]), any_, 2)[0]).alias("value")))

    found = let(F.lower(text), candidates)
    parts = let(found, lambda f: let(F.struct(text.alias("text"), f.alias("found"), F.array_join(f["pattern"], "|").alias("any")), bodies))
    return F.map_from_entries(F.filter(parts, lambda x: x["value"].isNotNull()))


def word_pairs(text: Column) -> Column:
    words = F.split(text, " ")
    return F.array_distinct(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def filing_deltas(filings: DataFrame, patterns: Mapping[str, str] = SECTIONS, unchanged: float = UNCHANGED) -> DataFrame:
    """``document_id, previous_id, category, change, hash, previous_hash, excerpt, percents`` of each filing's parts.

    ``filings``: ``document_id, company, document_type, report_date, created_at, text``.  The one before is of the same
    company and type, of the latest earlier date, of equal ones the one created last.  A part is ``new``, ``removed``,
    ``changed`` or ``unchanged``: equal, or ``unchanged`` of the word pairs are shared.  ``excerpt``: what words are new.  Filings without a date
    compare with none; a null text has no parts.
    """
    by = [F.col("company").alias("__company"), F.col("document_type").alias("__type"), F.col("report_date").alias("__date")]
    last = filings.filter("report_date is not null").groupBy(*by).agg(F.max_by("document_id", F.struct("created_at", "document_id")).alias("last_id"))
    last = last.withColumn("previous_id", F.lag("last_id").over(Window.partitionBy("__company", "__type").orderBy("__date"))).filter("previous_id is not null")
    # on disk, as both sides of the comparison read them
    parts = Scratch(filings.sparkSession, "deltas").put("parts", filings.select("document_id", F.explode(sections(F.col("text"), patterns)).alias("category", "body")))
    same_day = F.col("company").eqNullSafe(F.col("__company")) & F.col("document_type").eqNullSafe(F.col("__type")) & (F.col("report_date") == F.col("__date"))
    before = filings.select("document_id", "company", "document_type", "report_date").join(last, same_day, "left").select("document_id", "previous_id")
    old = before.filter("previous_id is not null").join(parts.select(F.col("document_id").alias("previous_id"), "category", F.col("body").alias("old")), "previous_id")
    both = parts.join(old.drop("previous_id"), ["document_id", "category"], "full").join(before, "document_id")
    pairs = F.struct(word_pairs(F.col("old")).alias("a"), word_pairs(F.col("body")).alias("b"))
    alike = let(pairs, lambda p: 2 * F.size(F.array_intersect(p["a"], p["b"])) / (F.size(p["a"]) + F.size(p["b"])))
    change = F.when(F.col("body").isNull(), "removed").when(F.col("old").isNull(), "new").when((F.col("old") == F.col("body")) | (alike >= unchanged), "unchanged").otherwise("changed")
    fresh = F.array_join(F.array_except(F.split("body", " "), F.split(F.coalesce("old", F.lit("")), " ")), " ")
    excerpt = F.left(F.when(F.coalesce("old", F.lit("")) == "", F.col("body")).when(fresh != "", fresh).otherwise(F.col("body")), F.lit(EXCERPT))
    percents = F.coalesce(F.regexp_extract_all("body", F.lit(r"\d+(?:\.\d+)?\s?%"), 0), F.array().cast("array<string>"))
    return both.select("document_id", "previous_id", "category", change.alias("change"), F.sha2("body", 256).alias("hash"), F.sha2("old", 256).alias("previous_hash"), excerpt.alias("excerpt"), percents.alias("percents"))


def excerpts(docs: DataFrame, headings: Sequence[tuple[int, str]], keywords: str, budget: int, before: int, after: int, head: int, section_budget: int, gap: int = 300) -> DataFrame:
    """``doc_id, a, b``: spans of each text (``doc_id, text``) that make up an excerpt of at most ``budget`` characters, cut at lines.

    A short line that a pattern of ``headings`` (tier, pattern) fits begins a section of that tier; other text is tier 1.
    First come the opening ``head`` characters of sections of tier 2 or 3, then lines near a keyword, by tier and number of
    keywords; a section gets ``section_budget`` at most.  Chosen lines no more than ``gap`` apart are one span.  A text
    inside the budget is one span; an empty or null one has none.
    """
    lines = docs.select("doc_id", F.length("text").alias("size"), F.posexplode(F.split("text", "\n")).alias("n", "line")).filter("size > 0")
    of = Window.partitionBy("doc_id").orderBy("n")
    far = Window.unboundedPreceding
    marker = F.lit(None).cast("int")
    for tier, pattern in reversed(headings):
        marker = F.when(F.col("line").rlike(f"(?i){pattern}"), tier).otherwise(marker)
    marker = F.when((F.trim("line") != "") & (F.length(F.ltrim("line")) <= 120), marker)
    lines = lines.select("doc_id", "size", "n", (F.length("line") + 1).alias("len"), marker.alias("marker"), F.size(F.regexp_extract_all("line", F.lit(f"(?i){keywords}"), 0)).alias("hits"))
    lines = lines.withColumns({"b": F.sum("len").over(of.rowsBetween(far, 0)), "section": F.count("marker").over(of.rowsBetween(far, 0)), "tier": F.coalesce(F.last("marker", ignorenulls=True).over(of.rowsBetween(far, 0)), F.lit(1))}).withColumn("a", F.col("b") - F.col("len"))
    part = Window.partitionBy("doc_id", "section")
    hit = F.col("hits") > 0
    last_hit = F.max(F.when(hit, F.col("b"))).over(part.orderBy("n").rowsBetween(far, 0))
    next_hit = F.min(F.when(hit, F.col("a"))).over(part.orderBy("n").rowsBetween(0, Window.unboundedFollowing))
    lines = lines.withColumns({"opening": (F.col("tier") >= 2) & (F.col("a") - F.min("a").over(part) < head), "near": F.coalesce((F.col("a") - last_hit <= after), F.lit(False)) | F.coalesce(next_hit - F.col("b") <= before, F.lit(False)), "quality": F.col("tier") * 100_000 + F.least(F.sum("hits").over(part), F.lit(100))})
    lines = lines.filter((F.col("size") <= budget) | F.col("opening") | F.col("near")).withColumn("phase", F.when(F.col("opening"), 0).otherwise(-F.col("quality") + 10_000_000))
    lines = lines.withColumn("spent", F.sum("len").over(part.orderBy("phase", "n").rowsBetween(far, 0))).filter((F.col("size") <= budget) | (F.col("spent") <= section_budget))
    lines = lines.withColumn("spent", F.sum("len").over(Window.partitionBy("doc_id").orderBy("phase", "n").rowsBetween(far, 0))).filter((F.col("size") <= budget) | (F.col("spent") <= budget))
    fresh = F.col("a") > F.lag("b").over(of) + gap
    lines = lines.withColumn("island", F.sum(F.coalesce(fresh.cast("int"), F.lit(0))).over(of.rowsBetween(far, 0)))
    return lines.groupBy("doc_id", "island").agg(F.min("a").alias("a"), F.least(F.max("b"), F.max("size")).alias("b")).drop("island")


def relationships(facts: DataFrame) -> DataFrame:
    """``company, relationship_id, kind, priority``: pairs of a company's facts that explain each other, and outside effects.

    ``facts``: ``company, metric, period, value`` (text), ``role``, one row for each metric.  Growth figures go before the
    plain ones, and capital spending before cash paid for equipment.  A fact without a value counts as missing.
    """
    known = facts.filter("value is not null")
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.concat_ws(":", "period", "value")))
    # text is aggregated by sorting: dealt by company first, no task sorts a whole split of the input
    one = known.repartition("company").groupBy("company").agg(*[pick(m).alias(m) for m in ("revenue_growth", "revenue", "net_income_growth", "net_income", "operating_cash_flow", "capex", "cash_paid_for_property_and_equipment")])
    named = lambda name, *cs: F.concat(F.lit(f"{name}:"), F.coalesce(*cs))
    growth = F.concat(F.lit("rel:top_bottom:"), named("revenue", "revenue_growth", "revenue"), F.lit(":"), named("net_income", "net_income_growth", "net_income"))
    cash = F.concat(F.lit("rel:cash_gen:"), named("operating_cash_flow", F.col("operating_cash_flow")), F.lit(":"), named("capex", "capex", "cash_paid_for_property_and_equipment"))
    row = lambda of, kind, priority: F.struct(of.alias("relationship_id"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))
    kinds = F.array(row(growth, "same_period_top_bottom_growth", 1), row(cash, "cash_generation_vs_investment", 2))
    pairs = one.select("company", F.explode(kinds).alias("r")).select("company", "r.*").filter("relationship_id is not null")
    outside = known.filter("role = 'external_effect'").select("company", F.concat(F.lit("rel:ext:"), F.concat_ws(":", "metric", "period", "value")).alias("relationship_id"), F.lit("external_effect_on_recipient").alias("kind"), F.lit(3).alias("priority"))
    return pairs.unionByName(outside)


def refresh_buckets(bars: DataFrame, ticks: DataFrame, late: DataFrame, by: Sequence[str], bucket: str, aggregates: Sequence[Column], since: Column) -> DataFrame:
    """``bars`` with the buckets anew that late ticks fall into, from ``since`` on; older buckets stay as they were.

    ``ticks`` holds all ticks, the late ones too.
    """
    touched = late.select(*by, bucket).filter(F.col(bucket) >= since).distinct()
    again = ticks.join(touched, [*by, bucket], "left_semi").groupBy(*by, bucket).agg(*aggregates)
    return bars.join(touched, [*by, bucket], "left_anti").unionByName(again)


def resolve_due(windows: DataFrame, ticks: DataFrame, by: Sequence[str], now: Column, seconds: int) -> DataFrame:
    """Pending ``windows`` whose ``target_at`` has come take the last tick up to it, ``seconds`` old at most.

    Columns: the keys, ``target_at, status, price``.  Without such a tick they stay pending and are asked again; windows of
    the future and settled ones stay as they are.
    """
    due = (F.col("status") == "pending") & (F.col("target_at") <= now)
    asked = windows.filter(due).drop("price", "status").withColumnRenamed("target_at", "ts")
    found = asof.asof_before(asked, ticks.filter(F.col("ts") <= now).select(*by, "ts", F.col("close").alias("price")), by, "ts", ["price"], strict=False, seconds=seconds).drop("tick_ts")
    found = found.withColumnRenamed("ts", "target_at").withColumn("status", F.when(F.col("price").isNotNull(), "resolved").otherwise("pending"))
    return windows.filter(~due).unionByName(found)
