"""Evidence as of a moment: adapters from tables to one form, admission at a cutoff, leakage, comparison of runs.

An adapter states where a family of evidence comes from; reading, cutoffs, versions and limits follow from it.  Conditions on
a table's own columns stay plain comparisons, so that they reach its scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.sources.scratch import Scratch

#: Days that a collection looks back, at most.
LONGEST_WINDOW = 730
#: Why evidence is left out at a cutoff, by category; fixed values.
REASONS = {
    "integrity": "point-in-time integrity cannot be established",
    "future": "evidence became available after replay cutoff",
    "version": "evidence version was not valid at replay cutoff",
    "revision": "later revision has no usable vintage at replay cutoff",
    "reaction": "reaction window extends beyond replay cutoff",
}
#: Columns of evidence.
EVIDENCE = ["ref", "family", "event_at", "available_at", "valid_from", "valid_to", "revision_at", "ends_at", "safe", "title", "entities", "content", "content_hash"]


@dataclass(frozen=True)
class Adapter:
    """Evidence of one family in a table; all values are SQL expressions over its columns.

    ``available``: times from which a row was known, all of which must have passed.  ``identity``: what versions of one
    thing have in common; only the latest by ``event_at`` and ``version`` is collected, of equal ones the least by content.
    ``content``: the columns that are the evidence.  ``ends_at``: the end of a window that a row measures.
    """

    family: str
    table: str
    key: Sequence[str]
    event_at: str
    available: Sequence[str]
    content: Sequence[str]
    title: str
    entities: Mapping[str, str] = field(default_factory=dict)
    identity: Sequence[str] = ()
    version: str = "NULL"
    where: str = "true"
    valid_from: str = "CAST(NULL AS TIMESTAMP_NTZ)"
    valid_to: str = "CAST(NULL AS TIMESTAMP_NTZ)"
    revision_at: str = "CAST(NULL AS TIMESTAMP_NTZ)"
    ends_at: str = "CAST(NULL AS TIMESTAMP_NTZ)"
    safe: str = "true"


def collected(rows: DataFrame, a: Adapter, since: Column, until: Column | None, limit: int | None = None) -> DataFrame:
    """``EVIDENCE`` columns of an adapter's rows from ``since`` to ``until``, the newest ``limit`` of them.

    Without ``until`` all later rows count too.  A row without a time of the event is no evidence.
    """
    when = F.expr(a.event_at)
    rows = rows.filter(a.where).filter(when >= since)
    if until is not None:
        rows = rows.filter(when <= until)
        for known in a.available:
            rows = rows.filter(F.expr(known) <= until)
    if a.identity:
        # rows that key and version leave equal go by what they say, so that any run takes the same one
        said = [F.to_json(F.struct(*a.content)), *[F.expr(x) for x in (*a.available, a.title, *a.entities.values(), a.valid_from, a.valid_to, a.revision_at, a.ends_at, a.safe)]]
        latest = Window.partitionBy(*[F.expr(c) for c in a.identity]).orderBy(when.desc(), F.expr(a.version).desc_nulls_last(), *[F.expr(k).desc() for k in a.key], *said)
        rows = rows.withColumn("__place", F.row_number().over(latest)).filter("__place = 1").drop("__place")
    time = lambda x: F.expr(x).cast("timestamp_ntz")
    content = F.to_json(F.struct(*a.content), {"ignoreNullFields": "false"})
    out = rows.select(
        F.concat(F.lit(f"{a.family}:"), F.concat_ws(":", *[F.expr(k).cast("string") for k in a.key])).alias("ref"), F.lit(a.family).alias("family"), when.cast("timestamp_ntz").alias("event_at"),
        F.greatest(*[time(x) for x in (a.event_at, a.event_at, *a.available)]).alias("available_at"), time(a.valid_from).alias("valid_from"), time(a.valid_to).alias("valid_to"), time(a.revision_at).alias("revision_at"),
        time(a.ends_at).alias("ends_at"), F.coalesce(F.expr(a.safe), F.lit(False)).alias("safe"), F.expr(a.title).cast("string").alias("title"),
        F.filter(F.array(*[F.when(F.expr(v).isNotNull(), F.concat(F.lit(f"{kind}:"), F.expr(v).cast("string"))) for kind, v in a.entities.items()]).cast("array<string>"), lambda e: e.isNotNull()).alias("entities"),
        content.alias("content"), F.sha2(F.concat(F.lit(f"{a.family}|"), content), 256).alias("content_hash"),
    )
    return out if limit is None else out.orderBy(F.col("event_at").desc(), "ref").limit(limit)


def collect(tables: Mapping[str, DataFrame], adapters: Sequence[Adapter], now: str, window_days: int, limit: int | None = None, replay: bool = True) -> DataFrame:
    """Evidence of all families in the days before ``now``, each row once.

    A replay sees what was known at ``now`` only.  With a ``limit``, each family gives its share of it at most, the newest
    rows, and the whole result has ``limit`` rows at most, those available last.  Of rows with one ``ref`` the one
    available last stays.
    """
    if len({a.family for a in adapters}) != len(adapters):
        raise ValueError("families of adapters must differ")
    at = F.lit(now).cast("timestamp_ntz")
    since = at - F.expr(f"INTERVAL {max(1, min(window_days, LONGEST_WINDOW))} DAYS")
    share = None if limit is None else -(-limit // len(adapters))
    found = reduce(DataFrame.unionByName, [collected(tables[a.table], a, since, at if replay else None, share) for a in adapters])
    return found if limit is None else once(found).orderBy(F.col("available_at").desc(), F.col("ref").desc()).limit(limit)


def once(evidence: DataFrame) -> DataFrame:
    """Of rows with one ``ref`` the one that became available last."""
    last = Window.partitionBy("ref").orderBy(F.col("available_at").desc(), "content_hash")
    return evidence.withColumn("__place", F.row_number().over(last)).filter("__place = 1").drop("__place")


def admitted(evidence: DataFrame, as_of: str) -> DataFrame:
    """``evidence`` with ``category`` and ``reason`` why a row doesn't count at a cutoff; both are null where it does."""
    at = F.lit(as_of).cast("timestamp_ntz")
    late = lambda c: F.coalesce(F.col(c) > at, F.lit(False))
    category = (
        F.when(~F.col("safe"), "integrity").when(late("event_at") | late("available_at"), "future").when(late("valid_from") | F.coalesce(F.col("valid_to") <= at, F.lit(False)), "version")
        .when(late("revision_at"), "revision").when(late("ends_at"), "reaction")
    )
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return evidence.withColumn("category", category).withColumn("reason", reasons[F.col("category")])


def fingerprint(hashes: Column) -> Column:
    """An aggregate over hexadecimal digests that tells sets of them apart, whatever their order."""
    part = lambda a: F.sum(F.conv(F.substring(hashes, a, 12), 16, 10).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws("|", F.count(hashes).cast("string"), *[F.coalesce(part(a), F.lit(0)).cast("string") for a in (1, 13, 25, 37)]), 256)


def audit(decided: DataFrame) -> DataFrame:
    """One row for a cutoff: how much evidence was considered, admitted and left out why; its time span and fingerprint.

    Equal contents are considered once.
    """
    each = decided.groupBy("content_hash").agg(F.min(F.struct("ref", "available_at", "category")).alias("e"))
    out = F.count_if(F.col("e.category").isNotNull())
    used = F.col("e.category").isNull()
    return each.agg(
        F.count("*").alias("considered"), (F.count("*") - out).alias("included"), *[F.count_if(F.col("e.category") == c).alias(f"excluded_{c}") for c in REASONS],
        F.min(F.when(used, F.col("e.available_at"))).alias("earliest"), F.max(F.when(used, F.col("e.available_at"))).alias("latest"), fingerprint(F.when(used, F.col("content_hash"))).alias("evidence_fingerprint"),
    )


def versions_at(rows: DataFrame, key: Sequence[str], recorded: str, as_of: str, valid_at: str | None = None, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """A bitemporal table as it was known at ``as_of``: of each key (and stretch of validity) the row recorded last by then.

    With ``valid_at`` only rows that hold at that moment, by what was known.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    known = rows.filter(F.col(recorded) <= at)
    last = Window.partitionBy(*key, valid_from).orderBy(F.col(recorded).desc())
    known = known.withColumn("__place", F.row_number().over(last)).filter("__place = 1").drop("__place")
    if valid_at is None:
        return known
    moment = F.lit(valid_at).cast("timestamp_ntz")
    holds = (F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (F.col(valid_to) > moment))
    newest = Window.partitionBy(*key).orderBy(F.col(valid_from).desc(), F.col(recorded).desc())
    return known.filter(holds).withColumn("__place", F.row_number().over(newest)).filter("__place = 1").drop("__place")


def leaks(outputs: DataFrame, lineage: DataFrame, decided: DataFrame, output: str = "output_id") -> tuple[DataFrame, DataFrame]:
    """What a run's outputs rest on that they mustn't: (one row for each such output, one for each such row that is used).

    ``outputs``: the outputs' ids.  ``lineage``: ``node, parent``, from outputs over what they were made from to ``ref`` of
    evidence.  Outputs: ``output_id, ref, reason, steps``, the nearest bad row, by steps and name.  Rows: ``ref, category,
    reason, available_at``.  A parent that nothing is known of, neither a node nor evidence, is bad: ``unknown evidence``.

    Both walks keep one row for each node: the nearest bad row is handed down from parents to what was made from them, a
    mark that some output uses it up from nodes to parents.  Cycles end, as a node's row changes only for a shorter way.
    """
    scratch = Scratch(outputs.sparkSession, "leaks")
    edges = scratch.put("edges", lineage.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent")).filter("node is not null and parent is not null").distinct())
    known = decided.select("ref", "category", "reason", "available_at")
    ends = edges.select(F.col("parent").alias("ref")).distinct().join(edges.select(F.col("node").alias("ref")).distinct(), "ref", "left_anti")
    unknown = ends.join(known.select("ref"), "ref", "left_anti").select("ref", F.lit("unknown").alias("category"), F.lit("unknown evidence").alias("reason"), F.lit(None).cast("timestamp_ntz").alias("available_at"))
    bad = scratch.put("bad", known.filter("category is not null").dropDuplicates(["ref"]).unionByName(unknown))
    # down: the nearest bad row of each node
    best = scratch.put("best0", bad.select(F.col("ref").alias("node"), F.struct(F.lit(0).alias("steps"), "ref").alias("to")))
    fresh, step = best, 0
    while not fresh.isEmpty():
        step += 1
        offers = edges.join(fresh.withColumnRenamed("node", "parent"), "parent").groupBy("node").agg(F.min(F.struct((F.col("to.steps") + 1).alias("steps"), F.col("to.ref").alias("ref"))).alias("offer"))
        fresh = scratch.put(f"fresh{step}", offers.join(best, "node", "left").filter("to is null or offer < to").select("node", F.col("offer").alias("to")))
        merged = scratch.put(f"best{step}", best.join(fresh.select("node"), "node", "left_anti").unionByName(fresh))
        scratch.drop(f"best{step - 1}", f"fresh{step - 1}")
        best = merged
    # up: what outputs use
    ids = outputs.select(F.col(output).cast("string").alias("node")).distinct()
    used = fresh_used = scratch.put("used0", ids)
    step = 0
    while not fresh_used.isEmpty():
        step += 1
        above = edges.join(fresh_used, "node").select(F.col("parent").alias("node")).distinct()
        fresh_used = scratch.put(f"more{step}", above.join(used, "node", "left_anti"))
        both = scratch.put(f"used{step}", used.unionByName(fresh_used))
        scratch.drop(f"used{step - 1}", f"more{step - 1}")
        used = both
    tainted = ids.join(best, "node").select(F.col("node").alias(output), F.col("to.ref").alias("ref"), F.col("to.steps").alias("steps"))
    rows = bad.join(used.withColumnRenamed("node", "ref"), "ref")
    return tainted.join(bad.select("ref", "reason"), "ref").select(output, "ref", "reason", "steps"), rows


def run_changes(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``key..., change, columns``: rows that one of two runs lacks (``added``, ``removed``), and those that ``changed`` with the names of the columns.

    Values compare by identity, so null equals null.  Rows that a key repeats are compared as the least of them.
    """
    row = F.struct(*columns)
    a, b = (df.groupBy(*key).agg(F.min(row).alias(name)) for df, name in ((left, "before"), (right, "after")))
    both = a.join(b, list(key), "full")
    names = F.filter(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.size(names) > 0, "changed")
    return both.withColumns({"change": change, "columns": F.when(change == "changed", names)}).filter("change is not null").select(*key, "change", "columns")


def compare_runs(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str], inputs: tuple[str, str]) -> DataFrame:
    """``run_changes`` of two runs over one input; ``inputs`` are the fingerprints of what they read, which must be equal."""
    if inputs[0] != inputs[1]:
        raise ValueError("runs can be compared only over identical inputs")
    return run_changes(left, right, key, columns)


#: Milestones by event; fixed values.
MILESTONES = {
    "evidence_started": "first_qualifying_evidence", "candidate_generated": "first_candidate", "case_formed": "first_forming", "case_corroborated": "first_corroborated", "research_ready": "first_research_ready", "case_mature": "first_mature",
}
#: The case of events that belong to the whole episode; a fixed value.
EPISODE = "__episode__"


def milestones(runs: DataFrame, events: DataFrame, anchor: str) -> DataFrame:
    """``case, milestone, first_at, observations, survived``: the first time of each milestone of each case and of the episode.

    ``runs``: ``run_id, benchmark, replay_as_of, variant, comparison, status``; ``events``: ``run_id, case, event, at``.  The
    runs of the anchor's benchmark, variant and comparison that ended well and replay no later moment count.  A case's
    observations are the replays that made it a candidate; it survived if the latest replay did.
    """
    a = runs.filter(F.col("run_id") == anchor).select("benchmark", "variant", "comparison", F.col("replay_as_of").alias("until"))
    # a run's variant and comparison may be null; null is a value
    same = runs.alias("r").join(F.broadcast(a.limit(1)).alias("a"), (F.col("r.benchmark") == F.col("a.benchmark")) & (F.col("r.variant") == F.col("a.variant")) & F.col("r.comparison").eqNullSafe(F.col("a.comparison")))
    same = same.filter("r.replay_as_of <= a.until and r.status in ('completed', 'completed_with_errors')").select("r.run_id", "r.replay_as_of", "a.until")
    seen = events.join(same, "run_id").withColumn("milestone", F.create_map(*[F.lit(x) for pair in MILESTONES.items() for x in pair])[F.col("event")]).filter("milestone is not null")
    each = seen.groupBy("case", "milestone").agg(F.min("at").alias("first_at"), F.count_distinct("replay_as_of").alias("n"), F.max("at").alias("last_at"), F.max("until").alias("until"))
    of = Window.partitionBy("case")
    candidate = lambda c: F.max(F.when(F.col("milestone") == "first_candidate", F.col(c))).over(of)
    cases = each.filter(F.col("case") != EPISODE).select("case", "milestone", "first_at", F.coalesce(candidate("n"), F.lit(0)).alias("observations"), F.coalesce(candidate("last_at") == F.col("until"), F.lit(False)).alias("survived"))
    episode = each.groupBy("milestone").agg(F.min("first_at").alias("first_at")).select(F.lit(EPISODE).alias("case"), "milestone", "first_at", F.lit(None).cast("long").alias("observations"), F.lit(None).cast("boolean").alias("survived"))
    return cases.unionByName(episode)
