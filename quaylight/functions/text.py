"""Text helpers on built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic in a headline; fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "will", "with", "after", "before", "says", "said", "update")

#: Named and numbered signs of HTML that pages use; the ampersand comes last, so that nothing is resolved twice.  Fixed values.
ENTITIES = {
    "nbsp": " ", "#160": " ", "lt": "<", "gt": ">", "quot": '"', "#34": '"', "apos": "'", "#39": "'", "#x27": "'", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "middot": "\u00b7", "bull": "\u2022",
    "ndash": "\u2013", "mdash": "\u2014", "hellip": "\u2026", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac", "pound": "\u00a3",
    "#8211": "\u2013", "#8212": "\u2014", "#8217": "\u2019", "eacute": "\u00e9", "egrave": "\u00e8", "uuml": "\u00fc", "ouml": "\u00f6", "auml": "\u00e4", "szlig": "\u00df", "ntilde": "\u00f1", "amp": "&",
}


def title_tokens(text: Column) -> Column:
    """Distinct words of ``[a-z0-9]`` with two characters or more, without stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets' union; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def percent_mentions(text: Column) -> Column:
    """Numbers followed by a per cent sign, in order."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)[ ]?%"), 1)


def numeric_tokens(text: Column) -> Column:
    """Numbers with optional grouping commas and decimals, without the commas."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))


def redact_secrets(text: Column) -> Column:
    """White space collapses; passwords in URLs and values of named secrets become ``[REDACTED]``.  The names are fixed values."""
    text = F.regexp_replace(collapse_space(text), r"(://[^:/@\s]+:)[^@\s]+@", "$1[REDACTED]@")
    return F.regexp_replace(text, r"(?i)\b(password|passwd|pwd|token|api[_-]?key|secret)(\s*[=:]\s*)[^\s,;]+", "$1$2[REDACTED]")


def mail_or_iso_time(text: Column) -> Column:
    """A time as mail headers (with or without the day's name) or ISO 8601 write it, in UTC; without a zone it is UTC; else null."""
    zone = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    mail = [F.try_to_timestamp(zone, F.lit(f"d MMM yyyy HH:mm{s} Z")) for s in (":ss", "")]
    # only one way is tried, as a time that doesn't parse costs most
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(text))).otherwise(F.coalesce(*mail))


def loose_number(text: Column) -> Column:
    """A number as tables print it: ``$``, commas and a per cent sign go, brackets negate; ``N/A``, ``--`` and non-finite ones are null."""
    bare = F.rtrim(F.regexp_replace(F.trim(text), "[$,]", ""), F.lit("%"))
    inner = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    number = F.when(inner != "", -inner.try_cast("double")).otherwise(bare.try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, no slash at the end."""
    plain = F.regexp_replace(url, "#.*$", "")
    plain = F.regexp_replace(plain, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"&{2,}", "&"), r"\?&", "?")
    plain = F.regexp_replace(plain, r"[?&/]+$", "")
    head = F.regexp_extract(plain, r"^([a-zA-Z]+://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(plain, F.length(head) + 1, F.length(plain)))


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, common entities are resolved, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    bare = F.when(F.contains(html, F.lit("<")), bare).otherwise(html)
    signs = bare
    for entity, sign in ENTITIES.items():
        signs = F.replace(signs, F.lit(f"&{entity};"), F.lit(sign))
    return collapse_space(F.when(F.contains(html, F.lit("&")), signs).otherwise(bare))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it names several times: the value's own expression is there once."""
    return F.transform(F.array(value), body)[0]


def _number_core(text: Column) -> Column:
    """A printed number's digits and separators."""
    core = F.regexp_replace(F.translate(text, "\u00a0", " "), r"^[() ]+|[() ]+$", "")
    core = F.translate(F.regexp_replace(core, r"^[£$€¥]\s*", ""), "− ", "-")
    return F.regexp_replace(core, r"^[+-]+", "")


def report_number(text: Column) -> Column:
    """A number of a report: brackets or a minus sign negate, a currency's sign goes; groups of thousands must be whole.

    Dashes and ``n/a`` stand for no number, and so does anything else.
    """
    shown = F.trim(F.translate(F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&#160;"), F.lit(" ")), "\u00a0", " "))

    def read(s: Column) -> Column:
        bare = F.translate(F.regexp_replace(F.regexp_replace(s, r"^[() ]+|[() ]+$", ""), r"^[£$€¥]\s*", ""), "− ", "-")
        whole = lambda b: b.rlike(r"^[+-]*[^,]*$|^[+-]*[^,.]{0,3}(,[^,.]{3})*(\..*)?$")
        digits = let(bare, lambda b: F.when(whole(b), F.translate(b, ",", "")))
        number = let(digits, lambda d: F.when(d.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), d.try_cast("double")))
        negative = s.startswith("(") & s.endswith(")")
        return let(number, lambda n: F.when(F.abs(n) < float("inf"), F.when(negative, -n).otherwise(n)))

    return let(shown, read)


def _near(a: Column, b: Column) -> Column:
    """Two values are within threefold of each other, or one is zero."""
    return (a == 0) | (b == 0) | F.coalesce(F.try_divide(F.abs(a), F.abs(b)).between(1 / 3, 3.0), F.lit(True))


def _mended(core: Column, value: Column, other_core: Column, other: Column) -> Column:
    """The reading of a number without its separators that has the other's decimals and is near it, or null.

    Zeros at its end that exceed the other's width are padding.
    """
    all_digits, width = F.translate(core, ",.", ""), F.length(F.translate(other_core, ",.", ""))
    places = F.when(F.contains(other_core, F.lit(".")), F.length(F.regexp_replace(other_core, r"^[^.]*\.", ""))).otherwise(0)

    def scaled(digits: Column) -> Column:
        found = F.when(places <= F.length(digits), digits.try_cast("double") / F.pow(F.lit(10.0), places))
        return let(found, lambda f: F.when(_near(f, other), F.when(value < 0, -f).otherwise(f)))

    def unpadded(d: Column) -> Column:
        return let(F.regexp_replace(d, "0+$", ""), lambda s: F.when((width > 0) & (F.length(d) > width) & (F.length(s) <= width), s).otherwise(d))

    return let(let(all_digits, unpadded), scaled)


def number_pair(current: Column, prior: Column) -> Column:
    """``[current, prior]`` of two aligned columns, or null where a number can't be told.

    Two values that are more than threefold apart may show a lost separator: a point before three digits or more in one of
    them only, or a whole number beside one with groups and decimals.  It is mended from the other, or the pair is null.
    """
    has = lambda c, sign: F.contains(c, F.lit(sign))
    lost = lambda c: ~has(c, ",") & c.rlike(r"^(?!0)[^.]*\.\d{3,}$")
    whole = lambda c, other: ~has(c, ".") & ~has(c, ",") & has(other, ".") & has(other, ",")

    def chosen(s: Column) -> Column:
        a, b, x, y = s["a"], s["b"], s["x"], s["y"]
        # which of the two, if one only, lost its separators
        first = F.when(s["lost_a"] != s["lost_b"], s["lost_a"]).when(~s["lost_a"] & (s["whole_a"] != s["whole_b"]), s["whole_a"])

        def pair(f: Column) -> Column:
            return F.when(f.isNull(), F.array(a, b)).when(f, F.array(_mended(x, a, y, b), b)).otherwise(F.array(a, _mended(y, b, x, a)))

        return F.when(_near(a, b), F.array(a, b)).otherwise(let(first, pair))

    parts = F.struct(report_number(current).alias("a"), report_number(prior).alias("b"), _number_core(current).alias("x"), _number_core(prior).alias("y"))
    flags = let(parts, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["x"].alias("x"), p["y"].alias("y"), lost(p["x"]).alias("lost_a"), lost(p["y"]).alias("lost_b"), whole(p["x"], p["y"]).alias("whole_a"), whole(p["y"], p["x"]).alias("whole_b")))
    both = let(flags, lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull(), chosen(s)))
    return let(both, lambda p: F.when(~F.exists(p, lambda v: v.isNull()), p))
