"""Trees of groups and folders by pointer doubling: as many rounds as the depth has binary digits, each with one row a node and written out.

Round k knows each node's ancestor 2**k up. What is asked is carried along: pairs with the ancestors of given nodes, the largest value above a node,
sums of what is below it, the names from the root on. Pairs are made for the nodes that are asked for alone, and none to find a cycle:
pointers that still lead somewhere after as many rounds as the number of nodes has digits go round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import materialize

#: Levels that descendants are looked for one by one, before all nodes are asked at once.
SHALLOW = 8


def jumps(edges: DataFrame) -> Iterator[DataFrame]:
    """(node, target): the ancestors 1, 2, 4 ... up, of the nodes that have one. A cycle is an error."""
    jump = materialize(edges.where("parent is not null").select("node", F.col("parent").alias("target")), "tree")
    nodes, reach = jump.count(), 1
    while not jump.isEmpty():
        if reach > nodes:
            raise ValueError("the tree has a cycle")
        yield jump
        onwards = jump.select(F.col("node").alias("target"), F.col("target").alias("further"))
        jump, reach = materialize(jump.join(onwards, "target").select("node", F.col("further").alias("target")), "tree"), 2 * reach


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of the seeds (node), every one its own ancestor at depth 0. No pair is made twice, none of other nodes."""
    tables = list(jumps(edges))  # a cycle is found before a pair is made
    rows, reach = seeds.join(edges.select("node"), "node", "left_semi").distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), 1
    for jump in tables:
        onwards = jump.select(F.col("node").alias("ancestor"), F.col("target").alias("further"))
        rows = materialize(rows.unionByName(rows.join(onwards, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("depth") + reach).alias("depth"))), "tree")
        reach *= 2
    return rows


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of every node of a (node, parent) table of any depth."""
    return ancestors(edges, edges.select("node"))


def _carried(edges: DataFrame, own: DataFrame, value: str, joined: Column) -> DataFrame:
    """Every node's value together with those of all its ancestors: ``joined`` is over ``value`` and ``above`` (null if there is none)."""
    rows = edges.select("node").join(own, "node", "left")
    for jump in jumps(edges):
        above = jump.join(rows.select(F.col("node").alias("target"), F.col(value).alias("above")), "target").select("node", "above", F.lit(True).alias("_is_below"))
        rows = materialize(rows.join(above, "node", "left").select("node", F.when(F.col("_is_below"), joined).otherwise(F.col(value)).alias(value)), "tree")
    return rows


def inherited_maximum(edges: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """(node, value): the largest value at a node or above it, of the nodes that have one. own is (node, value)."""
    best = own.groupBy("node").agg(F.max(value).alias(value))
    return _carried(edges, best, value, F.greatest(value, "above")).where(F.col(value).isNotNull())


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of the seeds and all nodes below them, each once. Shallow trees are gone through level by level from the seeds, so that only what is below
    them is touched; what is deeper is found by marks that all nodes inherit."""
    edges = edges.select("node", "parent")
    found = materialize(seeds.join(edges.select("node"), "node", "left_semi").select("node").distinct(), "tree")
    parts, frontier = [found], found
    for _ in range(SHALLOW):
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        below = edges.join(frontier.select(F.col("node").alias("parent")), "parent", "left_semi").select("node")
        frontier = materialize(below.join(reduce(DataFrame.unionByName, parts), "node", "left_anti"), "tree")
        parts.append(frontier)
    marked = inherited_maximum(edges, found.withColumn("mark", F.lit(1)), "mark")
    return marked.select("node")


def paths(edges: DataFrame) -> DataFrame:
    """(node, full_path) of a (node, parent, name) table: the names from the root on. Nodes that no root leads to have none."""
    whole = _carried(edges, edges.select("node", F.struct("name", F.col("parent").isNull().alias("rooted")).alias("at")), "at",
                     F.struct(F.concat_ws("/", F.col("above.name"), F.col("at.name")).alias("name"), (F.col("above.rooted") | F.col("at.rooted")).alias("rooted")))
    return whole.where("at.rooted").select("node", F.col("at.name").alias("full_path"))


def sums_below(edges: DataFrame, own: DataFrame, *values: str) -> DataFrame:
    """(node, values): sums over each node and all below it; 0 where nothing is."""
    rows = edges.select("node").join(own.groupBy("node").agg(*[F.sum(v).alias(v) for v in values]), "node", "left").na.fill(0, list(values))
    for jump in jumps(edges):
        below = jump.join(rows, "node").groupBy(F.col("target").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        rows = materialize(rows.join(below, "node", "left").select("node", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "tree")
    return rows


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth), 0 at the roots."""
    return _carried(edges, edges.select("node", F.lit(1).alias("depth")), "depth", F.col("depth") + F.col("above")).select("node", (F.col("depth") - 1).alias("depth"))


def assembled(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(node, depth, n_children, n_files, n_open): the listing of a tree, with the files below each node, itself included, and how many of
    them are open. files has (node, is_open)."""
    below = sums_below(edges, files.select("node", F.lit(1).alias("n_files"), F.col("is_open").cast("int").alias("n_open")), "n_files", "n_open")
    children = edges.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return depths(edges).join(children, "node", "left").join(below, "node").na.fill(0, ["n_children"]).select("node", "depth", "n_children", "n_files", "n_open")
