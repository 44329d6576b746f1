"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released


def _named(df: DataFrame, source: DataFrame) -> DataFrame:
    """A view of a materialized table that is released with it."""
    df.written_to = source.written_to
    return df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node it can reach.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their ends by
    doubling and contracts the edges. Only nodes smaller than all their neighbours are left, each with a neighbour
    that hooked, so the nodes at least halve: O(log n) rounds of O(log n) joins, also along a chain in order.
    Loops, repeated edges and edges with a null end are ignored (a looped node still gets its own label).
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = materialize(e.distinct(), "edges")
    labels = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.col("node"))
    labels = materialize(labels, "labels")
    e = e.where("a <> b")
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        hook = both.groupBy("a").agg(F.min("b").alias("m"))
        jump = materialize(hook.select("a", F.least("a", "m").alias("p"), F.lit(True).alias("moved")), "jump")
        while not jump.where("moved").isEmpty():
            before, ends = jump, jump.select(F.col("a").alias("q"), F.col("p").alias("r"))
            jump = jump.select("a", "p").join(ends, F.col("p") == F.col("q"))
            jump = materialize(jump.select("a", F.col("r").alias("p"), (F.col("p") != F.col("r")).alias("moved")), "jump")
            released(before)
        jump = _named(jump.select("a", "p"), jump)
        last = labels, e, jump
        labels = materialize(
            labels.join(jump, labels["label"] == jump["a"], "left").select("node", F.coalesce("p", "label").alias("label")),
            "labels",
        )
        ja, jb = jump.select(F.col("a"), F.col("p").alias("pa")), jump.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e = e.join(ja, "a").join(jb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        e = materialize(e.where("a <> b").distinct(), "edges")
        released(*last)
    return labels


def merged_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of the components ``found`` once ``links`` (a, b) are added: only links between two of them
    are contracted, so what is known already isn't worked through again."""
    side = lambda x: found.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    e = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    e = e.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b")
    e = materialize(e.distinct(), "edges")
    if e.isEmpty():
        return found
    up = connected_components(e)
    # Every label is a node of its own component, so the nodes of ``up`` are such rows of ``found`` or new.
    nodes = found.union(up.select("node", F.col("node").alias("label"))).distinct()
    higher = up.select(F.col("node").alias("low"), F.col("label").alias("least"))
    nodes = nodes.join(higher, nodes["label"] == higher["low"], "left").select("node", F.coalesce("least", "label").alias("label"))
    return materialize(nodes, "labels")
