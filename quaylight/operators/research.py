"""Cases, claims, playbooks, releases, sources' freshness and revisions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quaylight.functions.text import collapse_space

#: A number in a claim, with what may follow it, after no letter.
NUMBER = r"(?:^|[^A-Za-z0-9.,])([-+]?[0-9][0-9,.]*(?:%|bps|bp)?)"
#: Names and asked sets that meet in one task, and cells of a table of shared tokens that it holds at once.
NAMES, ASKED, CELLS = 50_000, 8_192, 2_000_000
#: Texts whose words are held at once.
TEXTS = 256
#: Words by which a source tells how its last attempt went; fixed values.
STATUSES = {
    "rate_limited": ("rate_limited", "rate-limited", "ratelimited", "throttled", "throttle"),
    "failed": ("failed", "failure", "error", "exception"),
    "cached": ("cached", "cached_fallback", "fallback", "stale_cache"),
    "success": ("success", "succeeded", "completed", "complete", "ok", "healthy", "no_change", "no-change"),
}


@F.pandas_udf(ArrayType(StringType()))
def nfkc_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct words of ``[a-z0-9]`` after NFKC and case folding, of four characters or more, not all digits, in order.

    Spark has no NFKC; a null text has no words.  Words go back for ``TEXTS`` texts at a time, as those of a whole batch
    take many times its size.
    """

    def words(text: str | None) -> list[str]:
        plain = unicodedata.normalize("NFKC", text or "").casefold()
        split = "".join(c if c.isascii() and c.isalnum() else " " for c in plain).split()
        return list(dict.fromkeys(w for w in split if len(w) >= 4 and not w.isdigit()))

    for texts in batches:
        for k in range(0, len(texts), TEXTS):
            yield texts.iloc[k : k + TEXTS].map(words)


def _nearest_sets(threshold: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The most similar set of ``names`` for each asked one, from the threshold on; of equal ones the least case."""

    def run(asked: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"id": asked["id"], "case_id": pd.Series(0, index=asked.index, dtype="int64"), "score": 0.0})
        if not len(asked) or not len(names):
            return out.iloc[:0]
        names = names.sort_values("case_id")
        flat, sizes = np.concatenate(asked["tokens"].to_list()), asked["tokens"].str.len().to_numpy()
        words, place = np.unique(flat, return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner = np.repeat(np.arange(len(asked)), sizes)[order]
        begin = np.searchsorted(place[order], np.arange(len(words) + 1))
        best, case = np.zeros(len(asked)), np.zeros(len(asked), dtype=np.int64)
        step = max(1, CELLS // len(asked))
        for k in range(0, len(names), step):
            part = names.iloc[k : k + step]
            own, token = part["tokens"].str.len().to_numpy(), np.concatenate(part["tokens"].to_list())
            row, at = np.repeat(np.arange(len(part)), own), np.minimum(np.searchsorted(words, token), len(words) - 1)
            row, at = row[words[at] == token], at[words[at] == token]
            many = begin[at + 1] - begin[at]
            # all asked sets that hold a token, for each token of each name
            where = np.arange(many.sum()) + np.repeat(begin[at] - np.cumsum(many) + many, many)
            shared = np.bincount(np.repeat(row, many) * len(asked) + owner[where], minlength=len(part) * len(asked)).reshape(len(part), len(asked))
            score = shared / (own[:, None] + sizes[None, :] - shared)
            # names ascend by case, so the first of equal scores has the least one
            first = score.argmax(axis=0)
            top = score[first, np.arange(len(asked))]
            better = top > best
            best, case = np.where(better, top, best), np.where(better, part["case_id"].to_numpy()[first], case)
        return out.assign(case_id=case, score=best)[(best >= threshold) & (best > 0)]

    return run


def match_cases(asked: DataFrame, cases: DataFrame, threshold: float) -> DataFrame:
    """``id, case_id, how, score``: the least case of an asked pattern's fingerprint, else the most similar from the threshold on.

    ``asked``: ``id, fingerprint, tokens``; ``cases``: ``case_id, fingerprint, names`` with a token set for the title and
    each alias, of which the nearest counts.  A null fingerprint is none.  Every asked set is held against every name: names
    of one token set are one, ``NAMES`` of them and ``ASKED`` asked sets meet in a task, which counts shared tokens by
    their hashes and gives one row for each asked set, so pairs are never written.
    """
    exact = asked.join(cases.groupBy("fingerprint").agg(F.min("case_id").alias("case_id")), "fingerprint").groupBy("id").agg(F.min("case_id").alias("case_id"))
    hashed = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda t: F.xxhash64(t)))).alias("tokens")
    names = cases.select("case_id", F.explode("names").alias("tokens")).filter(F.size("tokens") > 0).select("case_id", hashed(F.col("tokens")))
    names = names.groupBy("tokens").agg(F.min("case_id").alias("case_id"))
    one = asked.filter(F.size("tokens") > 0).join(exact, "id", "left_anti").select("id", hashed(F.col("tokens")))
    n, m = cases.count() * 2, asked.count()
    parts, lots = -(-n // NAMES) or 1, -(-m // ASKED) or 1
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = one.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")).withColumn("part", each(parts))
    right = names.withColumn("part", F.pmod(F.xxhash64("case_id", F.size("tokens")), F.lit(parts)).cast("int")).withColumn("lot", each(lots))
    scored = left.groupBy("part", "lot").cogroup(right.groupBy("part", "lot")).applyInPandas(_nearest_sets(threshold), "id long, case_id long, score double")
    best = scored.groupBy("id").agg(F.max_by(F.struct("case_id", "score"), F.struct("score", -F.col("case_id"))).alias("m"))
    return exact.select("id", "case_id", F.lit("fingerprint").alias("how"), F.lit(1.0).alias("score")).unionByName(best.select("id", "m.case_id", F.lit("similarity").alias("how"), "m.score"))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), 1))


def claim_faults(claims: DataFrame, evidence: DataFrame, directions: Sequence[str]) -> DataFrame:
    """``claims`` with ``fault``: the first rule that each breaks, or null.

    ``claims``: ``evidence_id, subject, predicate, object_value, unit, direction, source_span``; ``evidence``: unique
    ``evidence_id`` and ``text``.  A claim's span must occur in its evidence, white space and case aside, and each number
    of its value in that span.
    """
    plain = lambda c: F.lower(collapse_space(F.col(c)))
    known = evidence.select("evidence_id", F.col("text").alias("__text"), F.lit(True).alias("__known"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = (
        F.when(F.col("__known").isNull(), "unknown_evidence").when(blank("subject") | blank("predicate"), "missing_text")
        .when(F.col("direction").isNotNull() & ~F.lower("direction").isin(*directions), "invalid_direction").when(blank("source_span"), "missing_span")
        .when(~F.coalesce(F.contains(plain("__text"), plain("source_span")), F.lit(False)), "span_absent")
        .when(F.size(F.array_except(numbers(F.coalesce("object_value", F.lit(""))), numbers(F.col("source_span")))) > 0, "number_absent")
        .when(F.col("object_value").isNull() & F.col("unit").isNotNull(), "unit_without_value")
    )
    return claims.join(known, "evidence_id", "left").withColumn("fault", fault).drop("__text", "__known")


def freshness_state(enabled: Column, expected_next: Column, attempt: Column, success: Column, observation: Column, status: Column, cache: Column, records: Column, now: Column, grace_seconds: float = 300.0) -> Column:
    """One of ten states of a source.  ``expected_next`` is the schedule's next run after the attempt, null without a schedule."""
    is_ = lambda c, kind: F.coalesce(F.lower(c).isin(*STATUSES[kind]), F.lit(False))
    good = is_(status, "success") | (status.isNull() & success.isNotNull())
    late = F.unix_micros(now.cast("timestamp")) - F.unix_micros(expected_next.cast("timestamp"))
    return (
        F.when(~enabled, "disabled").when(is_(status, "rate_limited"), "rate_limited").when(is_(status, "failed"), "failed")
        .when(is_(status, "cached") | (is_(cache, "cached") & is_(status, "success")), "cached_fallback")
        .when(attempt.isNull() & success.isNull() & observation.isNull() & ~is_(status, "success"), "never_run").when(expected_next.isNull(), "outside_schedule")
        .when(is_(cache, "cached") & good, "cached_fallback").when(late < 0, F.when(good & (records == 0), "expected_idle").otherwise("current"))
        .when(late <= grace_seconds * 1_000_000, "delayed").otherwise("stale")
    )


def playbook_matches(events: DataFrame, playbooks: DataFrame) -> DataFrame:
    """``event_id, playbook_id, entities``: an event's type is listed and at least one normalized entity is shared.

    ``events``: ``event_id, event_type, entities``; ``playbooks``: ``playbook_id, event_types, entities``; an equi-join on
    type and entity.  A playbook without entities matches nothing.
    """
    norm = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    e = events.select("event_id", F.lower(F.trim("event_type")).alias("type"), F.explode(norm("entities")).alias("entity"))
    p = playbooks.select("playbook_id", F.explode(norm("event_types")).alias("type"), "entities").select("playbook_id", "type", F.explode(norm("entities")).alias("entity"))
    return e.join(p, ["type", "entity"]).groupBy("event_id", "playbook_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("entities"))


def due_playbooks(playbooks: DataFrame, reference: Column, limit: int) -> DataFrame:
    """Playbooks that aren't superseded and whose time has come or is unknown, oldest first."""
    due = playbooks.filter(F.col("superseded_at").isNull() & (F.col("expected_at").isNull() | (F.col("expected_at") <= reference)))
    return due.orderBy(F.col("expected_at").asc_nulls_last(), "created_at", "playbook_id").limit(limit)


def release_identity(source: Column, explicit: Column, name: Column, series: Column, reference: Column) -> Column:
    """A release and all its revisions: the source with an id it states, else with name or series and the reference period."""
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    head = F.lower(F.trim(F.coalesce(text(source), F.lit("unknown"))))
    return F.concat(head, F.lit(":"), F.coalesce(text(explicit), F.concat_ws(":", F.coalesce(text(name), text(series), F.lit("macro_release")), text(reference))))


def release_cards(releases: DataFrame, content: Sequence[str]) -> DataFrame:
    """The latest row of each ``identity`` by ``at`` and ``id``, with its number of revisions: rows that changed ``content``."""
    order = Window.partitionBy("identity").orderBy("at", "id")
    now, before = F.struct(*content), F.lag(F.struct(*content)).over(order)
    marked = releases.withColumn("__changed", (before.isNotNull() & (now != before)).cast("int"))
    latest = [F.max_by(c, F.struct("at", "id")).alias(c) for c in ("id", "at", *content)]
    return marked.groupBy("identity").agg(*latest, F.sum("__changed").alias("revisions"))


def changed_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Rows whose ``content`` differs from that of the row before them of their key; a key's first row stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, now = F.lag(F.struct(*content)).over(w), F.struct(*content)
    return rows.withColumn("__keep", before.isNull() | ~now.eqNullSafe(before)).filter("__keep").drop("__keep")


def coalesce_jobs(events: DataFrame, by: Sequence[str], ts: str, minutes: int) -> DataFrame:
    """One job for each key and ingestion bucket: how many events it stands for, the first and the last of them."""
    seconds = max(1, min(1440, minutes)) * 60
    slot = F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (1_000_000 * seconds)) * seconds).cast("timestamp_ntz")
    return events.groupBy(*by, slot.alias("bucket")).agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def trading_minutes(calendar: DataFrame, rows: DataFrame, moment: str, name: str) -> DataFrame:
    """``rows`` with ``name``: trading minutes of the venue from its first session to the moment.

    ``calendar``: a row for each session with ``day, open_minute, close_minute, minutes_before``, bounded by the years that
    it covers; a day without one takes the count of the session before it.
    """
    days = calendar.select("day", "open_minute", "close_minute", "minutes_before")
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    whole = span.join(days, "day", "left")
    so_far = F.max(F.col("minutes_before") + F.col("close_minute") - F.col("open_minute")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    whole = whole.select("day", "open_minute", "close_minute", F.coalesce("minutes_before", so_far, F.lit(0)).alias("begun"))
    at = F.col(moment)
    minute = F.hour(at) * 60 + F.minute(at) + F.second(at) / 60
    inside = F.coalesce(F.greatest(F.lit(0.0), F.least(minute, F.col("close_minute")) - F.col("open_minute")), F.lit(0.0))
    # one row for each day of the calendar
    return rows.withColumn("day", F.to_date(at)).join(F.broadcast(whole), "day", "left").withColumn(name, F.col("begun") + inside).drop("day", "open_minute", "close_minute", "begun")


def stale_baseline(event_minutes: Column, baseline_minutes: Column, lookback_minutes: int) -> Column:
    """Whether a baseline lies more trading minutes before its event than allowed; closed hours don't count, a missing one isn't stale."""
    return F.coalesce(event_minutes - baseline_minutes > lookback_minutes, F.lit(False))


def state_changes(rows: DataFrame, by: str, at: str, state: str) -> DataFrame:
    """``by, state, since, until``: the runs of equal states of each key; the last one has no end."""
    w = Window.partitionBy(by).orderBy(at)
    first = rows.withColumn("__before", F.lag(state).over(w)).filter(~F.col(state).eqNullSafe(F.col("__before")))
    return first.select(by, state, F.col(at).alias("since"), F.lead(at).over(w).alias("until"))
