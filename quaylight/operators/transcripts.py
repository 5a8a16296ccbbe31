"""Transcripts of calls: links that lead to them, turns of speakers, and segments that say most about the business."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.text import collapse_space, visible_text

# Words of a link to a transcript and of its surroundings, titles of links that lead elsewhere.
TRANSCRIPT_WORDS = ("transcript", "earnings call", "conference call", "earnings-call", "prepared remarks")
CONTEXT_WORDS = ("earnings", "financial results")
ELSEWHERE = ("share ", "top of page", "manage cookies")
QUARTER = r"(?i)\b(Q[1-4]|FY\s*\d{2,4}|[12]\d{3})\b"
# A line that a speaker begins, labels that are no speakers, the heading of questions and answers.
SPEAKER = r"^([A-Z][A-Za-z0-9.'\-\s]{1,40}|Operator|Executive|Analyst|Question-[Aa]nd-[Aa]nswer Session):\s*(.*)$"
NO_SPEAKERS = ("http", "https", "cautionary statement", "forward-looking statements", "safe harbor", "disclosure", "source", "view source version on", "contacts", "media contact", "investor contact", "note")
QUESTIONS = r"(?i)^(?:\s*q(?:uestion)?s?[ &/]+a(?:nswer)?s?|question[- ]+and[- ]+answer(?:s)?|questions?[- ]+and[- ]+answers?)[ -]*(?:session|section|segment)?[.:]*$"
# Words that say something about the business; signs of a segment and segments of a text, at most.
BUSINESS = ("guidance", "demand", "margin", "pricing", "inventory", "backlog", "capex", "orders", "supply", "customer", "competition", "risk")
SEGMENT, SEGMENTS = 1500, 8
#: Speakers that a transcript has at least.
LEAST_SPEAKERS = 2


def link_score(url: Column, title: Column) -> Column:
    """How much a link looks like one to a transcript: 2 for each word, 2 for earnings around it, 1 for a quarter or a year."""
    both = F.lower(F.concat_ws(" ", url, title))
    hits = sum((F.contains(both, F.lit(w)).cast("int") for w in TRANSCRIPT_WORDS), F.lit(0))
    context = F.contains(both, F.lit(CONTEXT_WORDS[0])) | F.contains(both, F.lit(CONTEXT_WORDS[1]))
    press = F.contains(both, F.lit("press release")) & (hits == 0)
    return F.when(press | ((hits == 0) & ~context), 0).otherwise(2 * hits + F.when(context, 2).otherwise(0) + both.rlike(QUARTER).cast("int"))


def transcript_links(pages: DataFrame, key: str = "page_id", base: str = "url", html: str = "html", most: int = 50) -> DataFrame:
    """``key, place, url, title, score``: a page's links that look like transcripts, the best ``most`` of them, first ones first.

    Relative links are completed by the page's address; only ``https`` links count, each once by its address without a
    fragment.  A link without text has its address as title.
    """
    anchors = pages.select(key, base, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), 0)).alias("i", "a"))
    href = F.trim(F.regexp_extract("a", r"(?is)^<a\b[^>]*?\bhref\s*=\s*['\"]([^'\"]*)['\"]", 1))
    anchors = anchors.select(key, base, "i", href.alias("href"), visible_text(F.col("a")).alias("text")).filter("href <> '' and href not like '#%'")
    origin, folder = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z]+://.*/)[^/]*$", 1)
    h = F.col("href")
    whole = F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), h)).when(h.startswith("/"), F.concat(origin, h)).when(h.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), h)).otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), h))
    found = anchors.select(key, "i", "text", F.regexp_replace(whole, "#.*$", "").alias("address"), whole.alias("url")).filter(F.lower("url").startswith("https:"))
    first = found.groupBy(key, "address").agg(F.min_by(F.struct("i", "url", "text"), "i").alias("f")).select(key, "f.i", "f.url", F.coalesce(F.nullif("f.text", F.lit("")), "f.url").alias("title"))
    low = F.lower("title")
    first = first.filter(~(low.startswith(ELSEWHERE[0]) | low.startswith(ELSEWHERE[1]) | low.startswith(ELSEWHERE[2]))).withColumn("score", link_score(F.col("url"), F.col("title"))).filter("score > 0")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "i"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select(key, "place", "url", "title", "score")


def _speaker(line: Column) -> Column:
    """The speaker that a line begins with, or null."""
    name = F.trim(F.regexp_extract(line, SPEAKER, 1))
    plain = F.regexp_replace(F.lower(name), "[.:]+$", "")
    return F.when((name != "") & ~plain.isin(*NO_SPEAKERS), name)


def transcript_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, i, line, speaker, said, turn, part`` of the lines that aren't blank: who speaks, which turn it is, and where.

    A speaker's line begins a turn; lines before the first one are turn 0, without a speaker.  ``part`` is ``qa`` from the
    heading of questions and answers on, else ``opening``.  ``said`` is the line without its speaker.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("i", "raw")).withColumn("line", collapse_space(F.col("raw"))).filter("line <> ''").drop("raw")
    lines = lines.withColumns({"begins": _speaker(F.col("line")), "heading": F.col("line").rlike(QUESTIONS)})
    above = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("begins").isNotNull(), F.trim(F.regexp_extract("line", SPEAKER, 2))).otherwise(F.col("line"))
    return lines.select(
        key, "i", "line", F.last("begins", ignorenulls=True).over(above).alias("speaker"), said.alias("said"), F.count("begins").over(above).alias("turn"),
        F.when(F.max(F.col("heading").cast("int")).over(above) == 1, "qa").otherwise("opening").alias("part"),
    )


def transcript_turns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, turn, speaker, part, said, n_lines`` of texts in which ``LEAST_SPEAKERS`` speak; other texts are no transcripts.

    A turn that the heading parts is in the part of its first line; the heading itself is said by nobody.
    """
    lines = transcript_lines(docs, key, text).filter(~F.col("line").rlike(QUESTIONS))
    turns = lines.groupBy(key, "turn").agg(F.min_by("speaker", "i").alias("speaker"), F.min_by("part", "i").alias("part"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]), " ").alias("said"), F.count("*").alias("n_lines"))
    enough = turns.groupBy(key).agg(F.count_distinct("speaker").alias("speakers")).filter(F.col("speakers") >= LEAST_SPEAKERS).select(key)
    return turns.join(enough, key, "left_semi").withColumn("said", F.trim("said"))


def _spans(text: str, heading: int, most: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's opening and of the windows behind it; a window ends at its last line's end if it has one."""
    limit = min(heading, most) if heading >= 0 else most
    opening = min(len(text), limit)
    if opening < len(text):
        for mark in ("\n\n", "\n"):
            at = text.rfind(mark, 0, opening)
            if at > 0:
                opening = min(at + len(mark), opening)
                break
    out = [("opening", 0, opening)] if opening else []
    at, kind = (heading, "qa") if heading >= 0 else (opening, "body")
    while at < len(text):
        end = min(at + most, len(text))
        line = text.rfind("\n", at, end) if end < len(text) else -1
        end = line + 1 if line > at else end
        out.append((kind, at, end))
        at = end
    return out


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", words: Sequence[str] = BUSINESS, most: int = SEGMENT, each: int = SEGMENTS) -> DataFrame:
    """``key, place, kind, start, end, signal, segment_id, excerpt``: the opening of a text and its windows with most ``words``.

    Windows have ``most`` signs at most and don't overlap; the windows of a text with a heading of questions and answers
    begin there.  Of each text ``each`` segments stay, the opening first, then by words and place.  Offsets count signs of
    the text without white space at its ends; ids hold for as long as the text does.  Null and blank texts have none.
    """
    bare = docs.select(key, F.regexp_replace(text, r"^[ \t\r\n\f\u000B]+|[ \t\r\n\f\u000B]+$", "").alias("bare")).filter("bare <> ''")
    lines = F.transform(F.split("bare", "\n"), lambda x: F.struct(F.length(x).alias("n"), F.regexp_replace(x, r"^[ \t\r\f\u000B]+|[ \t\r\f\u000B]+$", "").rlike(QUESTIONS).alias("heading")))
    at = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.lit(-1).alias("found")), lambda a, x: F.struct((a["at"] + x["n"] + 1).alias("at"), F.when((a["found"] < 0) & x["heading"], a["at"]).otherwise(a["found"]).alias("found")))["found"]

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series, headings: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in _spans(t, int(h), most)] for t, h in zip(texts, headings, strict=True)])

    found = bare.withColumn("heading", at).select(key, "bare", F.explode(spans("bare", "heading")).alias("s")).select(key, "s.*", F.expr("substring(bare, s.start + 1, s.end - s.start)").alias("excerpt"))
    apart = r"[\p{L}\p{N}_]"
    signal = sum((F.size(F.regexp_extract_all(F.lower("excerpt"), F.lit(f"(?<!{apart}){w}(?!{apart})"), 0)) for w in words), F.lit(0))
    found = found.withColumn("signal", signal)
    order = [(F.col("kind") != "opening").cast("int"), F.when(F.col("kind") == "opening", 0).otherwise(-F.col("signal")), F.col("start")]
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= each)
    return placed.select(key, "place", "kind", "start", "end", "signal", F.concat_ws(":", F.col(key).cast("string"), "kind", "start", "end").alias("segment_id"), "excerpt")


def dealt(found: DataFrame, key: str, limit: int) -> DataFrame:
    """``limit`` segments, the first of each text before any second one; texts in the order of ``key``, newest first."""
    return found.orderBy("place", F.col(key).desc()).limit(limit)
