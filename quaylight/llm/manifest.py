"""Merkle manifest of a dataset: a tree over each language's documents, one tree over those, and a proof for each leaf.

The trees are built in supersteps over RDDs.  Going up, the nodes of a level send their digests to their parents; a parent
that has heard from all its children hashes what they sent and sends on in the next superstep; a node that is alone on its
level is a root and stays silent.  Going down, a node sends each child what the child needs to be folded up to the root:
its place and its siblings' digests, then the node's own steps.  A run of ``FANOUT`` leaves gets its steps once and folds
each leaf's digest there, so no leaf's path is stored or moved.  What a superstep makes is written to the shared folder.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.sources.scratch import Scratch

#: Children of a node.
FANOUT = 8
#: Nodes that one task of a superstep handles, about.
TASK_NODES = 200_000
#: Columns that a leaf's digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: One step towards the root: the place among the siblings and their digests, one after another.
Step = tuple[int, bytes]
#: A tree's name (None is a name) and a node's number in its level.
Key = tuple[str | None, int]

_LEAVES = "tree string, n long, place long, doc_id long, leaf binary, changed binary"
_NODES = "tree string, n long, place long, digest binary, children binary"
_STEPS = "tree string, place long, root binary, subroot binary, slots array<int>, siblings array<binary>"


def digest_of(children: bytes) -> bytes:
    """SHA-256 over the children's digests as hexadecimal text."""
    return hashlib.sha256(children.hex().encode()).digest()


def fold(digest: bytes, steps: Iterable[Step]) -> bytes:
    """The root that a node with this digest leads to."""
    for slot, siblings in steps:
        digest = digest_of(siblings[: 32 * slot] + digest + siblings[32 * slot :])
    return digest


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def leaf_digest(**changed: Column) -> Column:
    """A row's digest: each field's bytes behind their number, ``-`` for null.  ``changed``: other values for some fields."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def placed(rows: DataFrame, tree: str, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``place``, the number of a row in its tree from 0 on, and ``n``, the tree's rows.

    ``rows`` is a table that reads the same each time.  Sorted by range over all trees, so a large tree spreads over many
    tasks; only the sizes of the stretches that a tree has in a task meet, one for each task.
    """

    def numbered(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        before, count = object(), 0
        for batch in batches:
            keys = batch.column(tree).to_pylist()
            at = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                count = count + 1 if key == before else 0
                before, at[i] = key, count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])

    ordered = [F.col(tree).asc_nulls_first(), *order]
    by_range = rows.repartitionByRange(*ordered).withColumn("task", F.spark_partition_id()).sortWithinPartitions(*ordered)
    kinds = ", ".join(f"`{c}` {k}" for c, k in [*rows.dtypes, ("task", "int"), ("at", "long")])
    sorted_ = scratch.put(name, by_range.mapInArrow(numbered, kinds))
    stretches = sorted_.groupBy(tree, "task").agg(F.count("*").alias("size"))
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(F.col(tree).alias("of"), F.col("task").alias("in_task"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"), F.sum("size").over(whole).alias("n"))
    found = sorted_.join(stretches, sorted_["task"].eqNullSafe(stretches["in_task"]) & sorted_[tree].eqNullSafe(stretches["of"]))
    return found.withColumn("place", F.col("first") + F.col("at")).drop("task", "at", "of", "in_task", "first")


def _spot(key: Key) -> int:
    """A key's task; unlike Python's hash, the same on all machines."""
    return zlib.crc32(f"{key[0] is None}{key[0]}/{key[1]}".encode())


def _tasks(spark: SparkSession, nodes: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes // TASK_NODES))


def _table(spark: SparkSession, rows: RDD, schema: str, scratch: Scratch, name: str) -> DataFrame:
    return scratch.put(name, spark.createDataFrame(rows, schema, verifySchema=False))


def rise(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels of all trees, from the parents of leaves on.  ``leaves``: ``tree, n, place, leaf``.

    A level has ``tree, n, place, digest, children``, with ``n`` nodes of its tree in the level; the last one has roots only.
    """
    spark = leaves.sparkSession
    total = leaves.agg(F.count("*").alias("nodes"), F.max("n").alias("n")).first()
    nodes, tallest = total["nodes"], height(total["n"] or 0)
    below = leaves.filter("n > 1").select("tree", "n", "place", F.col("leaf").alias("digest"))
    levels = []

    def complete(node: tuple[tuple[str | None, int, int], Iterable[tuple[int, bytes]]]) -> tuple:
        (tree, place, n), heard = node
        children = [digest for _, digest in sorted(heard)]
        if len(children) != min(FANOUT, n - FANOUT * place):
            raise ValueError(f"node {place} of tree {tree!r} heard from {len(children)} children")
        joined = b"".join(children)
        return tree, -(-n // FANOUT), place, digest_of(joined), joined

    for level in range(1, tallest + 1):
        messages = below.rdd.map(lambda x: ((x[0], x[2] // FANOUT, x[1]), (x[2] % FANOUT, bytes(x[3]))))
        # a parent hears from FANOUT children at most
        parents = messages.groupByKey(_tasks(spark, nodes), _spot).map(complete)
        levels.append(_table(spark, parents, _NODES, scratch, f"{name}{level}"))
        below = levels[-1].filter("n > 1").select("tree", "n", "place", "digest")
        nodes = -(-nodes // FANOUT) + 1
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``tree, n, digest``: each tree's root with the number of its leaves."""
    sizes = leaves.filter("place = 0").select("tree", F.col("n"), F.col("leaf").alias("lone"))
    found = None
    for level in levels:
        tops = level.filter("n = 1").select(F.col("tree").alias("of"), "digest")
        found = tops if found is None else found.unionByName(tops)
    if found is None:
        return sizes.select("tree", "n", F.col("lone").alias("digest"))
    return sizes.join(found, sizes["tree"].eqNullSafe(found["of"]), "left").select("tree", "n", F.coalesce("digest", "lone").alias("digest"))


def sink(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``tree, place, root, subroot, slots, siblings``: for each run of leaves its parent's steps to the root.

    ``tops``: the same columns for each tree's root, besides ``n``, the number of its leaves.  A tree of one leaf has no
    parent of leaves; its row is that of the leaf, with place 0.
    """
    spark = tops.sparkSession
    columns = ["tree", "place", "root", "subroot", "slots", "siblings"]
    # the levels above n leaves, as height() has it
    heights = F.expr(f"size(filter(transform(sequence(0, 20), k -> pow({FANOUT}, k)), width -> width < n))")
    tops = scratch.put(f"{name}_tops", tops.withColumn("height", heights))
    paths = tops.filter(F.col("height") == len(levels)).select(*columns)

    def send(node: tuple[Key, tuple[list, list]]) -> Iterator[tuple]:
        (tree, place), (children, found) = node
        joined, (root, subroot, slots, siblings) = bytes(next(iter(children))), next(iter(found))
        for slot in range(len(joined) // 32):
            others = joined[: 32 * slot] + joined[32 * slot + 32 :]
            yield tree, FANOUT * place + slot, root, subroot, [slot, *slots], [others, *siblings]

    for level in range(len(levels), 1, -1):
        nodes = levels[level - 1]
        tasks = _tasks(spark, nodes.count())
        inner = nodes.rdd.map(lambda x: ((x[0], x[2]), x[4]))
        told = paths.rdd.map(lambda x: ((x[0], x[1]), (bytes(x[2]), bytes(x[3]), list(x[4]), [bytes(s) for s in x[5]])))
        # keys of nodes are unique on both sides; the partitioner is the same, so siblings' messages meet their node
        met = inner.partitionBy(tasks, _spot).cogroup(told.partitionBy(tasks, _spot), tasks)
        below = _table(spark, met.flatMap(send), _STEPS, scratch, f"{name}{level - 1}")
        paths = below.unionByName(tops.filter(F.col("height") == level - 1).select(*columns))
    return paths.unionByName(tops.filter("height = 0").select(*columns)) if levels else paths


def _folded(run: tuple[Key, tuple[Iterable, Iterable]]) -> Iterator[tuple]:
    """The result rows of a run of leaves."""
    leaves, found = run[1]
    root, subroot, slots, siblings = next(iter(found))
    upper = list(zip(slots, siblings, strict=True))
    rows = sorted(leaves, key=lambda x: x[0])
    joined = b"".join(x[3] for x in rows)
    above = b"".join(siblings).hex().encode()
    for slot, (_, n, doc_id, leaf, changed) in enumerate(rows):
        others = joined[: 32 * slot] + joined[32 * slot + 32 :]
        steps = [(slot, others), *upper] if n > 1 else upper
        folded = fold(changed or leaf, steps)
        proof = hashlib.sha256((others.hex().encode() if n > 1 else b"") + above).hexdigest()
        yield doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root


def dataset_manifest(docs: DataFrame, tampered: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs``.

    A leaf is the digest of a row's ``FIELDS``; other columns play no part.  The leaves of a ``lang`` (null is one of its
    own) make a tree in the order of ``doc_id``, and the trees' roots make the tree of the whole table, null first, then by
    UTF-8 bytes.  ``proof_sha256`` covers the siblings' digests from the leaf up to the root.  ``folded_root`` is what a
    leaf and those siblings lead to; of rows that are ``tampered`` it's the leaf of ``changed_text``, which must tell.

    A null id comes first.  Rows of equal ids are ordered by their digests, and equal rows are as many leaves.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("lang").cast("string").alias("lang"), "n_chars", "text", (F.lit(False) if tampered is None else tampered).alias("is_changed"), (F.col("text") if changed_text is None else changed_text).alias("changed_text"))
    other = F.when(F.col("is_changed"), leaf_digest(text=F.col("changed_text")))
    # the number of a written row tells equal rows apart when they are dealt by range
    digests = scratch.put("digests", rows.select(F.col("lang").alias("tree"), "doc_id", leaf_digest().alias("leaf"), other.alias("changed"), F.monotonically_increasing_id().alias("written")))
    leaves = placed(digests, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("written").asc()], scratch, "sorted")
    leaves = scratch.put("leaves", leaves.select("tree", F.col("n").cast("long"), F.col("place").cast("long"), "doc_id", "leaf", "changed"))
    scratch.drop("digests", "sorted")
    levels = rise(leaves, scratch, "level")
    subroots = scratch.put("subroots", roots(leaves, levels))
    # the trees' roots are the leaves of one tree more
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("digest").alias("leaf"), F.col("n").alias("leaves"))
    upper = placed(named, "tree", [F.col("lang").asc_nulls_first()], scratch, "sorted_roots")
    upper = scratch.put("upper", upper.select("tree", F.col("n").cast("long"), F.col("place").cast("long"), "lang", "leaf", "leaves"))
    upper_levels = rise(upper, scratch, "upper_level")
    top = roots(upper, upper_levels).select(F.col("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("root"), F.col("digest").alias("subroot"), F.array().cast("array<int>").alias("slots"), F.array().cast("array<binary>").alias("siblings"), "n")
    runs = sink(upper_levels, top, scratch, "upper_steps")
    tops = scratch.put("tops", _own_steps(upper, upper_levels, runs))
    steps = sink(levels, tops, scratch, "steps")
    told = steps.rdd.map(lambda x: ((x[0], x[1]), (bytes(x[2]), bytes(x[3]), list(x[4]), [bytes(s) for s in x[5]])))
    grouped = leaves.rdd.map(lambda x: ((x[0], x[2] // FANOUT), (x[2] % FANOUT, x[1], x[3], bytes(x[4]), x[5] and bytes(x[5]))))
    tasks = _tasks(spark, leaves.count())
    # a run has FANOUT leaves and one row of steps at most
    done = grouped.partitionBy(tasks, _spot).cogroup(told.partitionBy(tasks, _spot), tasks).flatMap(_folded)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(done, schema, verifySchema=False)


def _own_steps(upper: DataFrame, levels: list[DataFrame], runs: DataFrame) -> DataFrame:
    """``tree, place, root, subroot, slots, siblings, n``: the steps of each language's root, from those of its run."""
    above = runs.select(F.col("place").alias("run"), "root", "slots", "siblings")
    mine = upper.withColumn("run", F.when(F.col("n") > 1, F.floor(F.col("place") / FANOUT)).otherwise(0)).withColumn("slot", (F.col("place") % FANOUT).cast("int"))
    mine = mine.join(above, "run")
    if levels:
        mine = mine.join(levels[0].select(F.col("place").alias("run"), "children"), "run")
        others = F.expr("concat(substring(children, 1, 32 * slot), substring(children, 32 * slot + 33, length(children)))")
        mine = mine.withColumns({"slots": F.concat(F.array("slot"), "slots"), "siblings": F.concat(F.array(others), F.col("siblings"))})
    return mine.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("place"), "root", F.col("leaf").alias("subroot"), "slots", "siblings", F.col("leaves").alias("n"))


def changed_third(doc_id: str = "doc_id") -> Column:
    """The rows of which the driver's contract tampers with the text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def small_letters(text: str = "text") -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
