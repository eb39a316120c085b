"""Groups of a graph: each node gets the smallest node that its edges reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.lineage import bounded, checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b) but the smallest of each component.

    component is the smallest node that can be reached. Alternates the
    large-star and small-star steps until the edges stop changing: each step
    is an aggregation with map-side minima and one join. Edges that are null
    or loops count for nothing.
    """
    current = checkpointed(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    before = None
    while True:
        state = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")
        ).first()
        if state.n == 0 or state == before:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = state
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = checkpointed(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        )
        large = checkpointed(
            both.join(bounded(least), "u")
            .where("v > u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        least = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("m")))
        current = checkpointed(
            large.join(bounded(least), "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b): the smallest node of its component."""
    edges = checkpointed(edges.select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    nodes = nodes.where("node IS NOT NULL").distinct()
    found = connected_components(edges).withColumnRenamed("component", "root")
    return nodes.join(bounded(found), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
