"""Directed graphs: strongly connected components, and with them the nodes on cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.sources.scratch import Scratch


def _trimmed(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Edges between nodes that have edges both in and out; the others lie on no cycle."""
    now, before, step = edges, -1, 0
    count = now.count()
    while count != before:
        before, step = count, step + 1
        inner = now.join(now.select(F.col("t").alias("f")).distinct(), "f", "left_semi")
        inner = scratch.put(f"{name}_{step}a", inner)
        now = scratch.put(f"{name}_{step}", inner.join(inner.select(F.col("f").alias("t")).distinct(), "t", "left_semi").select("f", "t"))
        scratch.drop(f"{name}_{step}a", f"{name}_{step - 1}")
        count = now.count()
    return now, count


def _colours(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, colour``: the greatest node from which each node can be reached, itself included."""
    nodes = edges.select(F.explode(F.array("f", "t")).alias("node")).distinct()
    now = scratch.put(f"{name}_0", nodes.withColumn("colour", F.col("node")))
    fresh, step = now, 0
    while not fresh.isEmpty():
        step += 1
        offers = edges.join(fresh.withColumnRenamed("node", "f"), "f").groupBy(F.col("t").alias("node")).agg(F.max("colour").alias("offer"))
        fresh = scratch.put(f"{name}_f{step}", now.join(offers, "node").filter("offer > colour").select("node", F.col("offer").alias("colour")))
        after = scratch.put(f"{name}_{step}", now.join(fresh.withColumnRenamed("colour", "better"), "node", "left").select("node", F.coalesce("better", "colour").alias("colour")))
        scratch.drop(f"{name}_{step - 1}", f"{name}_f{step - 1}")
        now = after
    return now


def strong_components(edges: DataFrame, from_node: str = "from_node", to_node: str = "to_node") -> DataFrame:
    """``node, component``: the nodes on cycles, with the least node of those that reach each other.

    Nodes without edges in or out are trimmed.  Each of the others takes the greatest node that reaches it as its colour;
    a node that has its own colour and those of the colour that reach it are one component.  What lies between colours is
    on no cycle and goes, and so do components; the rest goes on, until no edge is left.  Each table has a row for each
    node or edge at most; reachable pairs are never made.  A node with an edge to itself is a component at least.  Rows
    with a null end are no edges; repeated edges count once.
    """
    scratch = Scratch(edges.sparkSession, "strong")
    all_edges = edges.select(F.col(from_node).alias("f"), F.col(to_node).alias("t")).filter("f is not null and t is not null").distinct()
    all_edges = scratch.put("edges", all_edges)
    loops = all_edges.filter("f = t").select(F.col("f").alias("node"))
    now, count = _trimmed(all_edges.filter("f <> t"), scratch, "trim0")
    found, turn = [], 0
    while count:
        turn += 1
        colours = _colours(now, scratch, f"colour{turn}")
        of = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"colour_{c}"))
        inside = scratch.put(f"inside{turn}", now.join(of("f"), "f").join(of("t"), "t").filter("colour_f = colour_t").select("f", "t", F.col("colour_f").alias("colour")))
        members = fresh = scratch.put(f"members{turn}_0", colours.filter("node = colour"))
        step = 0
        while not fresh.isEmpty():
            step += 1
            back = inside.join(fresh.select(F.col("node").alias("t")), "t").select(F.col("f").alias("node"), "colour").distinct()
            fresh = scratch.put(f"fresh{turn}_{step}", back.join(members, "node", "left_anti"))
            more = scratch.put(f"members{turn}_{step}", members.unionByName(fresh))
            scratch.drop(f"members{turn}_{step - 1}", f"fresh{turn}_{step - 1}")
            members = more
        groups = members.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
        found.append(members.join(groups, "colour").select("node", "component"))
        left = inside.join(members.select(F.col("node").alias("f")), "f", "left_anti").join(members.select(F.col("node").alias("t")), "t", "left_anti").select("f", "t")
        now, count = _trimmed(scratch.put(f"left{turn}", left), scratch, f"trim{turn}")
    out = loops.withColumn("component", F.col("node"))
    for part in found:
        out = out.unionByName(part)
    return out.groupBy("node").agg(F.min("component").alias("component"))
