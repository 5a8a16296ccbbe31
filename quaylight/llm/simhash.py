"""SimHash near-duplicates: fingerprints sorted by Gray rank under a hierarchical index of shared bit patterns.

Fingerprints that differ in at most ``distance`` bits agree on whole blocks of bits, so each goes to one bucket for every
choice of blocks that might agree.  All buckets are sorted by the Gray rank of their fingerprints, by range over the
cluster: neighbours in that order differ in few bits, so a run of them shares many.  A node of the index covers a run: the
bits that all its fingerprints share are its mask, their values its pattern.  Two nodes are held against each other from
the top down; what their parents have compared is not compared again but carried along as accumulated differences.  A pair
of nodes goes as a whole when these exceed the distance, and links as a whole when all other bits couldn't exceed it.

A bucket that several tasks hold is a node for each of them, on top of the tasks' own trees: their masks and patterns are
aggregates, and only pairs of parts that those don't part are looked at, one pair at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.near_dedup import components
from quaylight.llm.spread import by_lots
from quaylight.llm.words import give_back
from quaylight.sources.scratch import Scratch

BITS = 64
SEED = 42
#: Blocks that a fingerprint is cut into besides as many as bits may differ: so many blocks agree at least.
AGREEING = 2
#: Fingerprints below a lowest node, nodes below a higher one, and fingerprints of a bucket that needs no nodes.
LEAF, FANOUT, SMALL = 4, 4, 16
#: Pairs of nodes that are compared at once.
PAIRS = 1 << 15
#: Bytes of a text that are hashed at once, and sorted rows that a task holds, about.
PIECE, TASK_ROWS = 1 << 20, 200_000

_U = np.uint64
_ONES = _U(0xFFFFFFFFFFFFFFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of about ``PIECE`` bytes each time."""
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        to = end.start() if end else len(text)
        yield text[at:to].split()
        at = to


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included; fewer words are one shingle, none are none."""
    carried: list[bytes] = []
    digest, some = xxhash.xxh64_intdigest, False
    for words in _pieces(text.encode().lower()):
        words = carried + words
        if len(words) >= size:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
            some = True
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], _U)
        carried = words[max(0, len(words) - size + 1) :]
    if carried and not some:
        yield np.array([digest(b" ".join(carried), SEED)], _U)


def fingerprint(text: str | None, size: int) -> int:
    """A bit is set if it is in over half the shingles' hashes."""
    total, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text or "", size):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id, print`` (64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text.as_py(), shingle_words) for text in batch.column("text")], _U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])
            give_back()

    return docs.mapInArrow(run, "doc_id long, print long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of 64-bit patterns in the reflected Gray code."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(shift)
    return rank


def block_masks(distance: int) -> list[int]:
    """Masks of ``AGREEING`` blocks of bits: two fingerprints within the distance agree on one mask at least."""
    blocks = distance + AGREEING
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, AGREEING)]


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after links between places ``a`` and ``b``: each place has the least place that it reaches."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


class GrayIndex:
    """The hierarchical index over the fingerprints of one bucket, sorted by Gray rank."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        #: (masks, patterns, first fingerprints) of each level's nodes, from the lowest level up.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step, first = LEAF, np.arange(0, len(prints), LEAF)
        every, some = np.bitwise_and.reduceat(prints, first), np.bitwise_or.reduceat(prints, first)
        while True:
            self.levels.append((~(every ^ some), every, np.append(first, len(prints))))
            if len(first) == 1:
                return
            step, keep = step * FANOUT, np.arange(0, len(first), FANOUT)
            every, some, first = np.bitwise_and.reduceat(every, keep), np.bitwise_or.reduceat(some, keep), first[keep]

    def _spans_one(self, labels: np.ndarray, level: int) -> np.ndarray:
        """Each node's label where all its fingerprints have it, else -1 less its number."""
        first = self.levels[level][2][:-1]
        least, most = np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first)
        return np.where(least == most, least, -1 - np.arange(len(first)))

    def groups(self, distance: int) -> np.ndarray:
        """For each fingerprint the place of the first one that links within the distance reach."""
        labels = np.arange(len(self.prints))
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        # pairs of nodes of a level: their numbers, the bits that are compared and the differences in them
        stack = [(top, zero, zero, np.zeros(1, _U), zero)]
        while stack:
            level, i, j, seen, apart = stack.pop()
            if len(i) > PAIRS:
                stack += [(level, i[k : k + PAIRS], j[k : k + PAIRS], seen[k : k + PAIRS], apart[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
                continue
            masks, patterns, first = self.levels[level]
            shared = masks[i] & masks[j]
            apart = apart + np.bitwise_count((patterns[i] ^ patterns[j]) & shared & ~seen)
            one = self._spans_one(labels, level)
            keep = (apart <= distance) & (one[i] != one[j])
            # a node with itself: its parts are compared with each other
            keep |= (i == j) & (one[i] < 0)
            i, j, seen, apart = i[keep], j[keep], shared[keep], apart[keep]
            near = apart + np.bitwise_count(~seen) <= distance
            if near.any():
                a, b = [], []
                for k in np.flatnonzero(near):
                    members = np.concatenate([np.arange(first[x], first[x + 1]) for x in {int(i[k]), int(j[k])}])
                    a.append(np.full(len(members), members[0]))
                    b.append(members)
                labels = _roots(labels, np.concatenate(a), np.concatenate(b))
                i, j, seen, apart = i[~near], j[~near], seen[~near], apart[~near]
            if not len(i):
                continue
            width, ends = (LEAF, len(self.prints)) if level == 0 else (FANOUT, len(self.levels[level - 1][0]))
            x, y = (np.broadcast_to(v, (len(i), width, width)) for v in ((i[:, None] * width + np.arange(width))[:, :, None], (j[:, None] * width + np.arange(width))[:, None, :]))
            good = (x < ends) & (y < ends) & ((x < y) if level == 0 else (x <= y))
            pair = np.broadcast_to(np.arange(len(i))[:, None, None], good.shape)[good]
            x, y = x[good], y[good]
            if level:
                stack.append((level - 1, x, y, seen[pair], apart[pair]))
            else:
                apart = apart[pair] + np.bitwise_count((self.prints[x] ^ self.prints[y]) & ~seen[pair])
                linked = apart <= distance
                labels = _roots(labels, x[linked], y[linked])
        return labels


def _links(prints: np.ndarray, reps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked fingerprint to the least of its group in the bucket."""
    order = np.argsort(gray_rank(prints), kind="stable")
    prints, reps = prints[order], reps[order]
    labels = GrayIndex(prints).groups(distance)
    least = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, reps)
    to = least[labels]
    linked = to != reps
    return to[linked], reps[linked]


def _small_links(bucket: np.ndarray, prints: np.ndarray, reps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets of ``SMALL`` fingerprints at most, all at once; equal ``bucket`` numbers are neighbours."""
    a, b = [], []
    for step in range(1, SMALL):
        i = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(i):
            break
        near = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= distance]
        a.append(np.minimum(reps[near], reps[near + step]))
        b.append(np.maximum(reps[near], reps[near + step]))
    return (np.concatenate(a), np.concatenate(b)) if a else (reps[:0], reps[:0])


def _runs(bucket: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)


def _bucket_links(bucket: np.ndarray, prints: np.ndarray, reps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    at = _runs(bucket)
    size = np.diff(at)
    small = np.repeat(size <= SMALL, size)
    found = [_small_links(bucket[small], prints[small], reps[small], distance)]
    for k in np.flatnonzero(size > SMALL):
        found.append(_links(prints[at[k] : at[k + 1]], reps[at[k] : at[k + 1]], distance))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``part, key, print, rep`` of sorted rows by whole buckets, several at once; a bucket has a task's rows at most."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy() for c in ("part", "key", "print", "rep")])
        part, key = held[-1][0], held[-1][1]
        new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]))
        if len(new):
            cut = int(new[-1]) + 1
            last = [x[cut:] for x in held[-1]]
            held[-1] = [x[:cut] for x in held[-1]]
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = [last]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _numbered(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]))


_FOUND = "kind string, a long, b long, part int, key long, print long, rep long, task int"


def _scan(distance: int):
    """Links of the buckets of a sorted task, and the rows of its first and its last bucket, which may go on in other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(a))
            return pa.RecordBatch.from_arrays([pa.array(["link"] * len(a), pa.string()), pa.array(a), pa.array(b), none.cast(pa.int32()), *[none.cast(pa.int64())] * 3, none.cast(pa.int32())], names=names)

        def edges(part: np.ndarray, key: np.ndarray, prints: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(part), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(["edge"] * len(part), pa.string()), none, none, pa.array(part), pa.array(key), pa.array(prints), pa.array(reps), pa.array(np.full(len(part), task, np.int32))], names=names)

        names = [x.split()[0] for x in _FOUND.split(", ")]
        first, last = True, None
        for part, key, prints, reps in _columns(batches):
            bucket = _numbered(part, key)
            yield links(*_bucket_links(bucket, prints.view(_U), reps, distance))
            at = _runs(bucket)
            if first:
                yield edges(part[: at[1]], key[: at[1]], prints[: at[1]], reps[: at[1]])
            # the first bucket is not given twice
            last = None if first and len(at) == 2 else tuple(x[at[-2] :] for x in (part, key, prints, reps))
            first = False
        if last is not None:
            yield edges(*last)

    return run


def _pair_scan(distance: int):
    """Links between two parts of a bucket; ``part`` is constant and ``key`` the pair's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, prints, reps in _columns(batches):
            a, b = _bucket_links(_numbered(part, key), prints.view(_U), reps, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_links(classes: DataFrame, distance: int, scratch: Scratch, task_rows: int = TASK_ROWS) -> DataFrame:
    """``a, b``: links that join all fingerprints within ``distance`` bits.  ``classes``: distinct ``print`` and its ``rep``.

    Not all pairs that are near come out, but between any two of those a chain of links does.
    """
    masks = block_masks(distance)
    rank = F.col("print")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    signed = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for k, m in enumerate(masks)])
    dealt = classes.withColumn("rank", rank).select("print", "rep", "rank", F.explode(signed).alias("m")).select(F.col("m.part").alias("part"), F.col("print").bitwiseAND(F.col("m.mask")).alias("key"), "rank", "print", "rep")
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * len(masks) // task_rows))
    by_range = dealt.repartitionByRange(tasks, "part", "key", "rank").sortWithinPartitions("part", "key", "rank").select("part", "key", "print", "rep")
    found = scratch.put("found", by_range.mapInArrow(_scan(distance), _FOUND))
    links = found.filter("kind = 'link'").select("a", "b").distinct()
    # upper nodes: the parts of a bucket that several tasks hold, each with the bits that it shares
    edges = found.filter("kind = 'edge'").select("part", "key", "print", "rep", "task")
    nodes = edges.groupBy("part", "key", "task").agg(F.bit_and("print").alias("every"), F.bit_or("print").alias("some"))
    several = nodes.groupBy("part", "key").agg(F.count("*").alias("parts")).filter("parts > 1").select("part", "key")
    nodes = scratch.put("nodes", nodes.join(several, ["part", "key"]).withColumn("mask", F.expr("~(every ^ some)")).drop("some"))
    one, two = (nodes.select("part", "key", *[F.col(c).alias(f"{c}{k}") for c in ("task", "every", "mask")]) for k in (1, 2))
    pairs = one.join(two, ["part", "key"]).filter(f"task1 < task2 and bit_count((every1 ^ every2) & mask1 & mask2) <= {distance}")
    pairs = scratch.put("pairs", pairs.select("part", "key", "task1", "task2", F.xxhash64("part", "key", "task1", "task2").alias("pair")))
    if pairs.isEmpty():
        return links
    ends = pairs.select("part", "key", "pair", F.explode(F.array("task1", "task2")).alias("task"))
    rows = edges.join(ends, ["part", "key", "task"]).select(F.lit(0).alias("part"), F.col("pair").alias("key"), "print", "rep")
    more = rows.repartition("key").sortWithinPartitions("part", "key").mapInArrow(_pair_scan(distance), "a long, b long")
    return scratch.put("links", links.unionByName(more).distinct())


def near_fingerprint_groups(docs: DataFrame, shingle_words: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs``.

    Texts are lower-cased in A-Z and cut into words.  A bit of the fingerprint is set if it is in over half of the XXH64
    hashes of the text's shingles, repeats included; fewer words than a shingle has are one shingle.  Without words the
    fingerprint is zero, so a null, empty or blank text is linked with others of that kind and with any text whose bits
    are few.  ``component_id`` is the least ``doc_id`` that links of ``distance`` bits or fewer reach.

    Equal fingerprints are one class however many rows have them.  Rows that share a ``doc_id`` are one document, linked by
    any of its texts; a null id is linked with nothing and has no component.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = scratch.put("prints", fingerprints(rows, shingle_words))
    named = known.filter("doc_id is not null")
    classes = scratch.put("classes", named.groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    links = near_links(classes.select("print", "rep"), distance, scratch)
    # rows of one id with several fingerprints link their classes
    several = named.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).filter("x <> y").select("doc_id")
    same = by_lots(named.join(several, "doc_id", "left_semi").distinct(), classes.select("print", "rep"), ["print"], "doc_id").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(links.unionByName(same), scratch)
    reps = classes.join(labels, classes["rep"] == labels["node"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = by_lots(known, reps, ["print"], "doc_id", "left")
    whole = F.lpad(F.lower(F.hex("print")), 16, "0")
    return out.select("doc_id", whole.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
