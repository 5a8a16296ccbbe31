"""Rows by key: latest, top-n, upserts and versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; ``rank`` names a column for their place.  Spark trims groups before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, whole.  Spark's group limit keeps one row of a key for each task before the shuffle."""
    return top_n(df, keys, order, 1)


def latest_values(df: DataFrame, keys: Sequence[str], ts: str, *columns: str) -> DataFrame:
    """The named columns of each key's latest row, by a hash aggregate."""
    return df.groupBy(*keys).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in columns])


def round_robin(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first row of each group, then the second of each, up to ``n`` rows."""
    ranked = df.withColumn("__turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("__turn") <= n).orderBy("__turn", *order).limit(n).drop("__turn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Old rows whose key isn't among the new ones, and the last new row of each key (by ``version`` if there is one)."""
    new = latest_by(new, keys, [F.desc(version)]) if version else new.dropDuplicates(list(keys))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows as they are; of new keys, the first row by ``order``."""
    return old.unionByName(latest_by(new, keys, order).join(old.select(*keys), list(keys), "left_anti"))


def upsert_greatest(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row for each key with the greatest value of both sides."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def versions(df: DataFrame, keys: Sequence[str], ts: str, content: str) -> DataFrame:
    """Slowly changing rows: a version begins where a key's content differs from the row before.

    Adds ``version``, ``valid_from``, ``valid_to`` (null for the current one) and ``is_current``.
    """
    w = Window.partitionBy(*keys).orderBy(ts, content)
    marked = df.withColumns({"__before": F.lag(content).over(w), "__first": F.row_number().over(w) == 1})
    new = marked.filter(F.col("__first") | ~F.col(content).eqNullSafe(F.col("__before"))).drop("__before", "__first")
    out = new.withColumn("version", F.row_number().over(w)).withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(w))
    return out.withColumn("is_current", F.col("valid_to").isNull())


def revisions(df: DataFrame, keys: Sequence[str], ts: str, content: str, id_: str) -> DataFrame:
    """Ledger rows: repeated content goes, a changed one names the row that it revises in ``revision_of``."""
    w = Window.partitionBy(*keys).orderBy(ts, id_)
    marked = df.withColumns({"__before": F.lag(content).over(w), "__first": F.row_number().over(w) == 1})
    kept = marked.filter(F.col("__first") | ~F.col(content).eqNullSafe(F.col("__before"))).drop("__before", "__first")
    return kept.withColumn("revision_of", F.lag(id_).over(w))


def as_known(df: DataFrame, cutoff: Column, event: str, *available: str) -> DataFrame:
    """Rows whose event time and all of whose availability times (null: always) are at or before the cutoff."""
    keep = F.col(event) <= cutoff
    for c in available:
        keep = keep & (F.col(c).isNull() | (F.col(c) <= cutoff))
    return df.filter(keep)


def retain(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float], slices: int = 1024) -> DataFrame:
    """``by`` and one column for each named share: exact percentiles, interpolated between neighbours; nulls don't count.

    Equal values are counted first.  The counts of ``slices`` even parts of each group's range tell in which part a rank
    lies; only the values of those parts are put in order, so that no task orders a whole group.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    groups = counts.groupBy(*by).agg(F.sum("__n").alias("__total"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    part = F.least(F.lit(slices - 1), F.floor(F.try_divide(F.col("__v") - F.col("__low"), F.col("__high") - F.col("__low")) * slices))
    placed = counts.join(F.broadcast(groups) if not by else groups, by).withColumn("__part", F.coalesce(part, F.lit(0))).select(*by, "__part", "__v", "__n")
    sums = placed.groupBy(*by, "__part").agg(F.sum("__n").alias("__n"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = lambda p: (F.col("__total") - 1) * F.lit(float(p))
    wanted = groups.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), place(p).alias("at"), r(place(p)).cast("long").alias("rank"), F.lit(k).alias("side")) for n, p in shares.items() for k, r in enumerate((F.floor, F.ceil))])).alias("__w"))
    found = wanted.join(sums, by).filter("__w.rank >= __before and __w.rank < __before + __n").select(*by, "__w", "__part", "__before")
    some = placed.join(found.select(*by, "__part").distinct(), [*by, "__part"], "left_semi")
    some = some.withColumn("__to", F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__v")))
    hit = found.join(some, [*by, "__part"]).filter("__w.rank < __before + __to and __w.rank >= __before + __to - __n")
    ends = hit.groupBy(*by, F.col("__w.name").alias("__name")).agg(F.max(F.when(F.col("__w.side") == 0, F.col("__v"))).alias("__a"), F.max(F.when(F.col("__w.side") == 1, F.col("__v"))).alias("__b"), F.max("__w.at").alias("__at"))
    between = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__at") - F.floor("__at"))
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == n, between)).alias(n) for n in shares])
