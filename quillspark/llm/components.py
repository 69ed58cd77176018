"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join every node's neighbours (large: the greater, small: the smaller and itself) to its least neighbour."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Written out, so that the join reads two plain shuffles: then the engine can split the partition of a node with many neighbours.
    joined = edges.join(materialize(least, "least"), "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges to (node, component), the component being its least node. Nodes without an edge aren't listed.

    Rounds go on until nothing changes, as they must after some log(nodes) squared of them. Each is written out and read back; no links are collected, and no node's neighbours meet in one task unless the
    engine's partial aggregation and its splitting of skewed joins have shortened them.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        edges = materialize(_star(_star(edges, True), False), "edges")
