"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.session import materialize


def _jump(parents: DataFrame) -> DataFrame:
    """Follows (node, parent) pointers to their roots, halving the distance each time."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        moved = parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("next"), "parent")
        moved = materialize(moved, "cc-jump")
        parents = moved.select("node", F.col("next").alias("parent"))
        if moved.where("next <> parent").isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round every node points to its smallest neighbour if that is smaller, pointers are followed to their
    roots, and the graph shrinks to the roots. Hubs vanish in the first round, so later joins have no hot keys.
    Rows with a null end and loops carry no edge.
    """
    live = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _jump(materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent")), "cc-parents"))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "cc-labels")
        a, b = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        mapped = live.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        live = materialize(mapped.distinct(), "cc-edges")
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
