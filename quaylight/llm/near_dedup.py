"""Near-duplicate groups by SuperMinHash, banding, exact verification and a distributed union-find.

Equal shingle sets are one class.  The classes' SuperMinHash signatures are banded; documents that share a band's bucket
are compared with the bucket's pivot, the member that meets most others.  What remains are links between two members of
a bucket that the pivot doesn't show.  They are found without comparing all members with each other: for a pivot ``p``
the sets ``u`` and ``v`` differ as much as their differences from it, ``|u ^ v| = |(u ^ p) ^ (v ^ p)|``, so two linked
sets of which one isn't linked with the pivot must share over about half of the smaller difference, and hence one of its
rarest elements.  Only members in two components are compared: the links with the pivots join most of a large group, the
links with one member for each of those elements most of the rest.  Members too far from the pivot for this get a pivot of
their own in a next round, as long as rounds halve what is left; then few are near each other, and all pairs that share
one of their rarest elements are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.spread import by_lots, unused
from quaylight.llm.words import Words, distinct_shingles, mix, steps
from quaylight.sources.scratch import Scratch

#: Rows of a band, and the chance that a pair at the threshold shares no band.
BAND_ROWS, MISS = 5, 1e-7
#: Bytes of text in a step: each element of a small set has a row of slots.
STEP = 1 << 20
#: Members of a pivot, or of an element, that one join task gets, about.
SALT_ROWS = 2000
#: A member is far from its pivot from this Jaccard distance on.
FAR = 0.5

_U = np.uint64
_LOW = _U(40)


def band_count(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    chance = (percent / 100) ** rows
    return 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))


def superminhash(docs: np.ndarray, hashes: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """(n_docs, size) signatures of sets given as (text, element) pairs; a text without elements has the largest value.

    Element ``e`` visits the slots in an order of its own, a Fisher-Yates shuffle, and offers the ``j``-th of them the
    value ``j`` plus a random fraction.  All elements take a step at once; a text whose slots are all filled is done, as
    later offers are larger.
    """
    out = np.full(n_docs * size, ~_U(0))
    live = np.arange(len(hashes))
    order: np.ndarray | None = None
    for j in range(size):
        if not len(live):
            break
        random = mix(hashes[live] + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((random >> _LOW) % _U(size - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(live), 1))
                rows = np.arange(len(live))
                order[rows, first] = 0
                order[rows, 0] = first
            rows = np.arange(len(live))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
        np.minimum.at(out, docs[live] * size + slot, (_U(j) << _LOW) | (random & _U((1 << 40) - 1)))
        full = (out.reshape(n_docs, size) != ~_U(0)).all(1)
        on = ~full[docs[live]]
        if j == 0:
            first = slot[on]
        elif order is not None:
            order = order[on]
        live = live[on]
    return out.reshape(n_docs, size)


def _band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each text and band; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), bands, rows)
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), parts.shape[:2]).copy()
    for r in range(rows):
        total = mix(total * _U(0xD1342543DE82EF95) + parts[:, :, r])
    return total


def sketches(docs: DataFrame, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, f1, f2, bands``: the size of each text's shingle set, 128 bits that tell sets apart, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, limit=STEP):
                words = Words(part.column("text"), lower=True)
                n = words.n_docs
                where, hashes = distinct_shingles(words, shingle_words)
                sizes = np.bincount(where, minlength=n)
                prints = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.concatenate([[_U(0)], np.cumsum(mix(hashes ^ _U(salt)), dtype=_U)])
                    at = np.concatenate([[0], np.cumsum(sizes)])
                    prints.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                found = _band_hashes(superminhash(where, hashes, n, bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), found.ravel())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), *prints, lists], names=["doc_id", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id, s``: the sorted hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                words = Words(part.column("text"), lower=True)
                where, hashes = distinct_shingles(words, shingle_words)
                at = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=words.n_docs))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, hashes.view(np.int64))], names=["doc_id", "s"])

    return docs.mapInArrow(run, "doc_id long, s array<long>")


def _with_set(pairs: DataFrame, sets: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """``pairs`` with the set of ``key`` as ``name``.  A frequent ``key`` is split by ``by``, each part with a copy of its set."""
    often = pairs.groupBy(key).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = by_lots(pairs, often.filter("salts > 1"), [key], by, "left").withColumn("salt", F.pmod(F.xxhash64(F.lit(1), by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = sets.join(often, F.col("doc_id") == F.col(key)).select(key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("s").alias(name))
    return salted.join(copies, [key, "salt"]).drop("salt")


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    return _with_set(_with_set(pairs, sets, b, a, "sb"), sets, a, b, "sa")


def _linked(percent: int) -> Column:
    return 100 * F.col("inter") >= percent * (F.col("na") + F.col("nb") - F.col("inter"))


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", name: str = "labels") -> DataFrame:
    """``node, component``: for each node of a link the least node that it reaches.

    A union-find forest in rounds: each node knows a parent that is no larger.  Over each link the other end's
    grandparent, if smaller, becomes the parent of the node and of its present parent, so that roots hook onto roots, and
    every node moves up to its grandparent.  A forest that stays as it was has one root for each component.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other")))
    both = scratch.put(f"{name}_links", both.distinct())
    forest = scratch.put(f"{name}0", both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("parent")))
    step = 0
    while True:
        step += 1
        up = scratch.put(f"{name}_up{step}", forest.join(forest.select(F.col("node").alias("parent"), F.col("parent").alias("above")), "parent").select("node", "parent", "above"))
        near = both.join(up.select(F.col("node").alias("other"), F.col("above").alias("least")), "other").groupBy("node").agg(F.min("least").alias("least"))
        reached = up.join(near, "node").select("node", "parent", F.least("above", "least").alias("least"))
        hooks = reached.select(F.explode(F.array("node", "parent")).alias("node"), "least").groupBy("node").agg(F.min("least").alias("parent"))
        after = scratch.put(f"{name}{step}", hooks)
        still = up.join(after.withColumnRenamed("parent", "then"), "node").filter("parent <> then or parent <> above").isEmpty()
        scratch.drop(f"{name}{step - 1}", f"{name}_up{step}")
        forest = after
        if still:
            scratch.drop(f"{name}_links")
            return forest.select("node", F.col("parent").alias("component"))


def _with_components(rows: DataFrame, labels: DataFrame, node: str, to: str) -> DataFrame:
    """``rows`` with the component of ``node`` as ``to``; a node without links is one of its own."""
    named = labels.select(F.col("node").alias(node), F.col("component").alias("found"))
    return rows.join(named, node, "left").withColumn(to, F.coalesce("found", node)).drop("found")


def _shared_bound(percent: int, na: str, nb: str, da: str, db: str) -> str:
    """SQL: two sets that differ from a third one by ``da`` and ``db`` elements may be linked, by what their differences can share.

    The first element that they share in a common order is the ``pa``-th of one and the ``pb``-th of the other.
    """
    return f"{2 * (100 + percent)} * (1 + least({da} - pa, {db} - pb)) >= {100 + percent} * ({da} + {db}) - {100 - percent} * ({na} + {nb})"


def _salted_pairs(one: DataFrame, two: DataFrame, on: list[str], condition: str) -> DataFrame:
    """``a, b, ca, cb``: distinct pairs of rows with equal keys that fit, and their components.

    A key of ``df`` rows is split: ``one`` by salts, ``two`` by copies.
    """
    parts = F.ceil(F.col("df") / SALT_ROWS).cast("int")
    left = one.withColumn("salt", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("df")
    right = two.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("df")
    return left.join(right, [*on, "salt"]).filter(f"ca <> cb and {condition}").select("a", "b", "ca", "cb").distinct()


def _side(elements: DataFrame, on: list[str], name: str, *more: str) -> DataFrame:
    """Elements as one side of a pair: the columns of ``name`` and those of the key."""
    of = {"member": name, "component": f"c{name}", "n": f"n{name}", "nd": f"d{name}", "place": f"p{name}", "apart": f"apart_{name}"}
    return elements.select(*on, "df", *[F.col(x).alias(y) for x, y in of.items()], *more)


def _mixed(elements: DataFrame, on: list[str]) -> DataFrame:
    """The elements whose members are in several components, with how many members have them."""
    often = elements.groupBy(*on).agg(F.count("*").alias("df"), (F.min("component") != F.max("component")).alias("mixed")).filter("df > 1")
    return elements.join(often, on)


def _in_order(elements: DataFrame, by: list[str], size: str) -> DataFrame:
    """Each row's ``place`` in its set of ``size`` elements, from the rarest on; what no other member has comes first."""
    sets = elements.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("df", "e", "mixed"))).alias("es"))
    placed = sets.select(*by, (F.col(size) - F.size("es") + 1).alias("alone"), F.posexplode("es").alias("i", "x"))
    return placed.filter("x.mixed").select(*by, (F.col("alone") + F.col("i")).alias("place"), F.col("x.e").alias("e"), F.col("x.df").alias("df"))


def _delta_elements(deltas: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Elements that several members of a pivot differ by, where some member is not in the pivot's component.

    ``deltas``: ``round, pivot, member, n, np, linked, delta`` with the symmetric difference from the pivot's set.  A
    result row is an element of a member's difference.  Elements whose members are all in one component are left out.
    """
    by = ["round", "pivot"]
    loose = _with_components(deltas.filter("not linked").select(*by).distinct(), labels, "pivot", "home")
    some = _with_components(by_lots(deltas, loose, by, "member"), labels, "member", "component")
    some = scratch.put("loose", some.withColumn("apart", F.col("component") != F.col("home")).drop("linked"))
    busy = some.filter("apart").select(*by).distinct()
    flat = by_lots(some, busy, by, "member").select(*by, "member", "n", "np", "home", "component", "apart", F.size("delta").alias("nd"), F.explode("delta").alias("e"))
    flat = scratch.put("elements", flat)
    return _in_order(_mixed(flat, [*by, "e"]), [*by, "member", "n", "np", "home", "component", "apart", "nd"], "nd")


def _merged(elements: DataFrame, merged: DataFrame) -> DataFrame:
    """Elements by the components that links between components have made; those of one component only are left out."""
    for name in ("home", "component"):
        elements = _with_components(elements.withColumnRenamed(name, "node"), merged, "node", name).drop("node")
    elements = elements.withColumn("apart", F.col("component") != F.col("home"))
    return _mixed(elements.drop("df"), ["round", "pivot", "e"]).filter("mixed").drop("mixed")


def _delta_candidates(elements: DataFrame, percent: int) -> DataFrame:
    """``a, b, ca, cb``: pairs of a pivot's members in two components that may be linked.

    One of the two, ``a``, is not in the pivot's component and so not linked with it.  With ``c = (1 - t) / (1 + t)``,
    linked sets differ in ``c (|a| + |b|)`` elements at most, and ``a`` differs from the pivot ``p`` by ``da``, more than
    ``c (|a| + |p|)`` elements.  Then ``da`` and ``db`` share more than ``(|db| + c (|p| - |b|)) / 2`` elements, so one of
    the rarest ``|db|`` less that many of ``db`` must be in ``da``; and from their first common element on, both must have
    enough left.
    """
    on = ["round", "pivot", "e"]
    prefix = f"greatest(1, nd - (nd * {100 + percent} + {100 - percent} * (np - n)) div {2 * (100 + percent)})"
    rare, apart = _side(elements.filter(f"place <= {prefix}"), on, "b"), _side(elements.filter("apart"), on, "a")
    # of two that aren't in the pivot's component, the rarest elements of the smaller difference are enough
    return _salted_pairs(apart, rare, on, f"(not apart_b or db < da or (db = da and b > a)) and {_shared_bound(percent, 'na', 'nb', 'da', 'db')}")


def _hub_candidates(elements: DataFrame, percent: int) -> DataFrame:
    """``a, b, ca, cb``: of each element's members one, apart from the pivot's component, with each that may be linked with it.

    No more pairs than elements, though they show most links between members that no pivot shows.
    """
    on = ["round", "pivot", "e"]
    hub = elements.filter("apart").groupBy(*on, "df").agg(F.min_by(F.struct("member", "component", "n", "nd", "place", "apart"), F.xxhash64("member")).alias("hub")).select(*on, "df", "hub.*")
    return _salted_pairs(_side(elements, on, "a"), _side(hub, on, "b"), on, _shared_bound(percent, "na", "nb", "da", "db"))


def _prefix_candidates(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, ca, cb``: all pairs of members in two components that may be linked: they share one of their rarest elements.

    ``members``: ``doc_id, component``.  Linked sets share ``percent`` per cent of each, so of elements ordered from the
    rarest on, one of the first ``n - ceil(n * percent / 100) + 1`` of either is among those of the other, and from the
    first common one on both must have enough left.
    """
    flat = sets.join(members, "doc_id").select(F.col("doc_id").alias("member"), "component", F.lit(True).alias("apart"), F.size("s").alias("n"), F.size("s").alias("nd"), F.explode("s").alias("e"))
    placed = _in_order(_mixed(flat, ["e"]), ["member", "component", "apart", "n", "nd"], "n")
    rare = placed.filter(f"place <= n - ({percent} * n + 99) div 100 + 1")
    lengths = f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na"
    return _salted_pairs(_side(rare, ["e"], "a"), _side(rare, ["e"], "b"), ["e"], f"a < b and {lengths} and {_shared_bound(percent, 'na', 'nb', 'na', 'nb')}")


def linked_members(buckets: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``node, component`` of all linked members of the buckets.  ``buckets``: ``bucket, member``, two or more each.

    First each bucket's members are held against its pivot.  The links found make components, and only pairs of members
    in two components are looked for afterwards: by hubs, then all that are left.
    """
    rounds, apart = 0, 1 - percent / 100
    stars: list[DataFrame] = []
    all_deltas: list[DataFrame] = []

    def check(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.put(f"{name}_pairs", pairs)
        checked = _with_sets(pairs, sets, "a", "b").select("ca", "cb", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("inter"))
        found = scratch.put(name, checked.filter(_linked(percent)).select("ca", "cb").distinct())
        scratch.drop(f"{name}_pairs")
        return found

    while True:
        rounds += 1
        sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"))
        meets = buckets.join(sizes, "bucket").groupBy("member").agg(F.sum("size").alias("meets"))
        best = buckets.join(meets, "member").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("member")).alias("m"))).alias("best"))
        led = scratch.put(f"led{rounds}", buckets.join(best.select("bucket", (-F.col("best.m")).alias("pivot")), "bucket").filter("member <> pivot"))
        found = _with_sets(led.select("pivot", "member").distinct(), sets, "pivot", "member")
        found = found.withColumns({"nb": F.size("sb"), "na": F.size("sa"), "inter": F.size(F.array_intersect("sa", "sb"))})
        distance = 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
        delta = F.when(distance <= FAR + apart, F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
        deltas = scratch.put(f"deltas{rounds}", found.select(F.lit(rounds).alias("round"), "pivot", "member", F.col("nb").alias("n"), F.col("na").alias("np"), _linked(percent).alias("linked"), distance.alias("distance"), delta.alias("delta")))
        stars.append(deltas.filter("linked").select("pivot", "member"))
        all_deltas.append(deltas.filter("delta is not null").drop("distance"))
        # members far from their bucket's pivot are linked with far ones only: they get a pivot of their own
        far = led.join(deltas.filter(F.col("distance") >= FAR).select("pivot", "member"), ["pivot", "member"], "left_semi").select("bucket", "member")
        several = far.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
        buckets = scratch.put(f"far{rounds}", far.join(several, "bucket", "left_semi"))
        before, after = led.count(), buckets.count()
        scratch.drop(f"led{rounds}", f"far{rounds - 1}")
        if 2 * after > before or not after:
            break
    labels = components(reduce(DataFrame.unionByName, stars), scratch, "pivot", "member", "stars")
    elements = scratch.put("mixed", _delta_elements(reduce(DataFrame.unionByName, all_deltas), labels, scratch))
    more = check(_hub_candidates(elements, percent), "hubs")
    if not more.isEmpty():
        elements = _merged(elements, components(more, scratch, "ca", "cb", "hubbed"))
    more = more.unionByName(check(_delta_candidates(elements, percent), "deltas"))
    if after:
        # hardly any is near another: no group is left that makes elements frequent
        members = _with_components(buckets.select(F.col("member").alias("doc_id")).distinct(), labels, "doc_id", "component")
        more = more.unionByName(check(_prefix_candidates(members, sets, percent), "rest"))
    scratch.drop("mixed", "loose", "elements", *(f"deltas{k + 1}" for k in range(rounds)))
    if more.isEmpty():
        return labels
    merged = components(more, scratch, "ca", "cb", "merged")
    alone = merged.join(labels, "node", "left_anti")
    return _with_components(labels.select(F.col("node").alias("member"), F.col("component").alias("of")), merged, "of", "component").select(F.col("member").alias("node"), "component").unionByName(alone)


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Texts are lower-cased in A-Z and cut into words; a text of fewer words than a shingle has is one shingle.  Documents
    whose sets have ``percent`` per cent or more of their union in common are linked; ``component_id`` is the least
    ``doc_id`` that links reach, and ``kept`` marks that document.  A null, empty or blank text is linked with nothing.
    Rows that share a ``doc_id`` are one document, linked by any of its texts; a null id is linked with nothing and kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bands = band_count(percent)
    known = scratch.put("sketches", sketches(rows, shingle_words, bands, BAND_ROWS))
    # one row for each set; its least document stands for the class
    print_ = ["n", "f1", "f2"]
    sets_of = known.filter("n > 0 and doc_id is not null").groupBy(*print_)
    classes = scratch.put("classes", sets_of.agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("bands").alias("bands")))
    members = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("member"))
    several = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    buckets = scratch.put("buckets", members.join(several, "bucket", "left_semi"))
    wanted = buckets.select(F.col("member").alias("doc_id")).distinct()
    sets = scratch.put("sets", shingle_sets(rows.join(wanted, "doc_id", "left_semi"), shingle_words))
    labels = linked_members(buckets, sets, percent, scratch)
    equal = classes.filter("rep <> last").select(*print_, "rep")
    out = known.select("doc_id", *print_).join(equal, print_, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all columns; of repeated rows with one ``doc_id``, all stay."""
    groups = near_duplicate_groups(docs, shingle_words, percent)
    name = unused("gone", docs.columns)
    gone = groups.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
