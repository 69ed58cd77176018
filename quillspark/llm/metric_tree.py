"""Exact top-k search by inner product with an M-tree.

Vectors of unequal length are made points of one sphere: with M the largest length, x gets the component sqrt(M^2 - |x|^2), a query 0.
Then distance^2 = |q|^2 + M^2 - 2 * score, so nearest points are best scores, and the triangle inequality holds.

The tree has three levels of paged nodes, written as a table with one row for each leaf node. The root's routing objects are pivots:
rows of a bounded sample, far from one another, each with the radius that covers the rows nearest to it. Below, every page of
PAGE_ROWS rows of a pivot is cut by two far rows after another into leaf nodes; a node has its routing object (a row of its own), its
covering radius, its distance to the pivot, and each row's distance to the routing object.

Queries are asked in blocks of ``block_rows`` that share pivots. First each descends to its nearest pivot's nodes, whose k-th score is a
bound; then all nodes are searched whose pivot can hold a better row. A query goes through the nodes of a page best first, by the least distance
that a row of it can have, and stops at the first that can't hold one as good as its k-th. The parent distances rule nodes and rows out before
any distance to them is computed; queries that are at the same node compute together. Every task gives its best k rows of a query at most, and
they are ranked by score and id. Scores are whole numbers; distances only rule out, with a margin for their rounding.

Defined results: rows with a null id, a null vector or a null or non-finite component take no part. Shorter vectors are padded with zeros.
Rows with equal ids are never each other's answer; otherwise each row stands for itself, but equal query rows are asked once. With fewer
than k other rows, all are returned. An empty table gives no rows. Ids are whole numbers. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.vectors import Shape, matrix, scores, shape_of, whole_vectors
from quillspark.session import materialize, new_table_path

#: Rows of the sample that pivots are taken from, pivots, rows of a page and of a leaf node, queries of a block.
SAMPLE_ROWS, MOST_PIVOTS, PAGE_ROWS, NODE_ROWS, BLOCK_ROWS = 8192, 1024, 2048, 64, 2048
#: Relative error of a distance that is allowed for.
MARGIN = 1e-6
NODE = "pivot int, reach double, apart double, radius double, centre int, n int, ids array<long>, flat array<long>, away array<double>"


@dataclass
class Sphere:
    """Distances between vectors, lifted to the sphere of radius sqrt(square)."""

    shape: Shape

    @property
    def square(self) -> float:
        return self.shape.largest

    def lifted(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.concatenate([v, np.sqrt(np.maximum(self.square - (v * v).sum(axis=1), 0.0))[:, None]], axis=1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(d, 0.0))


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Places of n points, each the farthest from those before; fewer if the points are fewer, or equal to those taken."""
    taken, nearest = [0], Sphere.distances(points, points[:1])[:, 0]
    while len(taken) < n and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, Sphere.distances(points, points[taken[-1:]])[:, 0])
    return np.array(taken)


def leaves(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Sets of at most ``most`` places: a set that is too large is halved by the difference of its distances to two far points of it."""
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            yield own
            continue
        to_first = Sphere.distances(points[own], points[own[:1]])[:, 0]
        a = int(to_first.argmax())
        d = Sphere.distances(points[own], points[own[[a]]])[:, 0]
        b = int(d.argmax())
        order = np.argsort(d - Sphere.distances(points[own], points[own[[b]]])[:, 0], kind="stable")
        # Cut at a multiple of the node's size, so that nodes are full.
        half = max(1, round(len(own) / most / 2)) * most
        todo += [own[order[:half]], own[order[half:]]]


def _assigned(sphere: Sphere, pivots: Broadcast) -> Callable:
    """Nearest pivot of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [np.empty(0, np.int64)]
            v = matrix(batch.column(1), sphere.shape)
            for a in range(0, len(v), 4096):
                near.append(Sphere.distances(sphere.lifted(v[a : a + 4096]), pivots.value).argmin(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(near).astype(np.int32))], names=[*batch.schema.names, "pivot"])

    return run


def _noded(sphere: Sphere, pivots: Broadcast, page_rows: int, node_rows: int) -> Callable:
    """Leaf nodes of a group of one pivot's rows, read page by page."""

    def nodes(pivot: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        points = sphere.lifted(v)
        to_pivot = Sphere.distances(points, pivots.value[pivot : pivot + 1])[:, 0]
        rows = []
        for own in leaves(points, node_rows):
            centre = int(Sphere.distances(points[own], points[own].mean(axis=0, keepdims=True))[:, 0].argmin())
            away = Sphere.distances(points[own], points[own[[centre]]])[:, 0]
            rows.append((pivot, float(to_pivot[own].max()), float(to_pivot[own[centre]]), float(away.max()), centre, len(own), ids[own], v[own].astype(np.int64).reshape(-1), away))
        names = [x.split()[0] for x in NODE.split(", ")]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = key[0].as_py(), []
        for batch in batches:
            held.append((batch.column("id").to_numpy(), matrix(batch.column("v"), sphere.shape)))
            while sum(len(x) for x, _ in held) >= page_rows:
                ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
                yield nodes(pivot, ids[:page_rows], v[:page_rows])
                held = [(ids[page_rows:], v[page_rows:])]
        ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(ids):
            yield nodes(pivot, ids, v)

    return run


@dataclass
class Tree:
    """The table of leaf nodes, the root's routing objects (lifted) and their covering radii."""

    nodes: DataFrame
    pivots: np.ndarray
    cover: np.ndarray
    sphere: Sphere


def build_tree(rows: DataFrame, shape: Shape, page_rows: int = PAGE_ROWS, node_rows: int = NODE_ROWS, most_pivots: int = MOST_PIVOTS) -> Tree:
    """Of rows (id, v) of whole_vectors; all of them are in the nodes. Only the pivots come from a sample, of SAMPLE_ROWS rows."""
    sphere, context = Sphere(shape), rows.sparkSession.sparkContext
    sample = rows.select("v").orderBy(F.xxhash64("v", "id"), "id").limit(SAMPLE_ROWS).toArrow()
    points = sphere.lifted(matrix(sample.column("v"), shape))
    pivots = points[far_apart(points, min(most_pivots, ceil(shape.rows / page_rows)))] if len(points) else points
    sent = context.broadcast(pivots)
    # A pivot's rows are dealt over as many groups as its share of the sample tells; a group is read page by page, however large.
    near = Sphere.distances(points, pivots).argmin(axis=1) if len(points) else np.empty(0, np.int64)
    share = np.bincount(near, minlength=len(pivots)) / max(1, len(points))
    groups = F.array(*[F.lit(max(1, ceil(x * shape.rows / page_rows))) for x in share.tolist()]) if len(pivots) else F.array(F.lit(1))
    kinds = "id long, v array<long>, pivot int"
    dealt = rows.select("id", "v").mapInArrow(_assigned(sphere, sent), kinds).withColumn("page", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), groups[F.col("pivot")]))
    nodes = materialize(dealt.groupBy("pivot", "page").applyInArrow(_noded(sphere, sent, page_rows, node_rows), NODE), "metric_tree")
    cover = np.zeros(len(pivots))
    for r in nodes.groupBy("pivot").agg(F.max("reach").alias("reach")).collect():  # a row for each pivot
        cover[r.pivot] = r.reach
    return Tree(nodes, pivots, cover, sphere)


@dataclass
class Queries:
    """A block of queries with the lowest score that each still takes."""

    ids: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    k: int
    sphere: Sphere
    to_pivots: np.ndarray
    square: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, k: int, tree: Tree) -> Queries:
        q = vectors.astype(np.float64)
        length = (q * q).sum(axis=1)
        least = -np.ceil(np.sqrt(length * tree.sphere.square)).astype(np.int64) - 1
        return cls(ids, vectors, least, k, tree.sphere, Sphere.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), tree.pivots), length + tree.sphere.square)

    def reach(self, least: np.ndarray, own: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Distance beyond which nothing has that score, with the margin; of some of the queries."""
        square = self.square[own]
        return np.sqrt(np.maximum(square - 2.0 * least[own], 0.0)) + MARGIN * np.sqrt(square) + MARGIN


class Search:
    """Best-first search of one block in one task; holds the best k rows of each query. ``computed`` counts scores."""

    def __init__(self, queries: Queries):
        self.q, n = queries, len(queries.ids)
        self.lifted = np.concatenate([queries.vectors.astype(np.float64), np.zeros((n, 1))], axis=1)
        self.score = np.full((n, queries.k), np.iinfo(np.int64).min)
        self.id = np.full((n, queries.k), np.iinfo(np.int64).max)
        self.least = queries.least.copy()
        self.reach = queries.reach(self.least)
        self.computed = 0

    def page(self, nodes: list[dict], home: np.ndarray | None = None) -> None:
        """Search some nodes, each query those of its home pivot only if that is given."""
        pivot, apart, radius = (np.array([x[c] for x in nodes]) for c in ("pivot", "apart", "radius"))
        to_pivot = self.q.to_pivots[:, pivot]
        least = np.maximum(np.abs(to_pivot - apart) - radius, 0.0)  # by the parent distance alone
        if home is not None:
            least[home[:, None] != pivot[None]] = np.inf
        asked = least <= self.reach[:, None]
        some = np.flatnonzero(asked.any(axis=1))
        if not len(some):
            return
        centres = self.q.sphere.lifted(np.stack([x["v"][x["centre"]] for x in nodes]))
        to_centre = Sphere.distances(self.lifted[some], centres)
        least = np.where(asked[some], np.maximum(least[some], to_centre - radius), np.inf)
        order = np.argsort(least, axis=1, kind="stable")
        for step in range(len(nodes)):
            turn = order[:, step]
            going = np.flatnonzero(least[np.arange(len(some)), turn] <= self.reach[some])
            if not len(going):
                return
            going = going[np.argsort(turn[going], kind="stable")]
            for own in np.split(going, np.flatnonzero(np.diff(turn[going])) + 1):
                at = turn[own[0]]
                self.node(nodes[at], some[own], to_centre[own, at])

    def node(self, x: dict, own: np.ndarray, to_centre: np.ndarray) -> None:
        """Score the rows of a node that their distance to its routing object doesn't rule out."""
        near = np.abs(to_centre[:, None] - x["away"][None]) <= self.reach[own][:, None]
        rows = np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return
        ids = x["ids"][rows]
        got = scores(self.q.vectors[own], x["v"][rows])
        self.computed += got.size
        fine = near[:, rows] & (got >= self.least[own][:, None]) & (ids[None] != self.q.ids[own][:, None])
        hit = np.flatnonzero(fine.any(axis=1))
        if not len(hit):
            return
        mine, rows = own[hit], np.flatnonzero(fine[hit].any(axis=0))
        new = np.where(fine[np.ix_(hit, rows)], got[np.ix_(hit, rows)], np.iinfo(np.int64).min)
        score = np.concatenate([self.score[mine], new], axis=1)
        named = np.concatenate([self.id[mine], np.where(new > np.iinfo(np.int64).min, ids[rows][None], np.iinfo(np.int64).max)], axis=1)
        best = np.lexsort((named, -(score + 1)), axis=1)[:, : self.q.k]
        self.score[mine], self.id[mine] = np.take_along_axis(score, best, 1), np.take_along_axis(named, best, 1)
        self.least[mine] = np.maximum(self.least[mine], self.score[mine, -1])
        self.reach[mine] = self.q.reach(self.least, mine)


def _nodes(batch: pa.RecordBatch, shape: Shape) -> list[dict]:
    plain = {c: batch.column(c).to_numpy() for c in ("pivot", "apart", "radius", "centre")}
    lists = {c: [x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("ids", "flat", "away")}
    out = []
    for i in range(batch.num_rows):
        ids = lists["ids"][i]
        out.append({c: x[i] for c, x in plain.items()} | {"ids": ids, "away": lists["away"][i], "v": lists["flat"][i].reshape(len(ids), shape.width).astype(shape.dtype)})
    return out


def _searched(block: Broadcast, page_nodes: int, home: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = block.value
        search = Search(q)
        own = q.to_pivots.argmin(axis=1) if home else None
        for batch in batches:
            for a in range(0, batch.num_rows, page_nodes):
                search.page(_nodes(batch.slice(a, page_nodes), q.sphere.shape), own)
        query, place = np.nonzero(search.score > np.iinfo(np.int64).min)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(search.id[query, place]), pa.array(search.score[query, place])], names=["q", "id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _blocks(near: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each pivot's queries: whole pivots together, one of many queries in several."""
    first, parts, block, room = np.zeros(len(near), np.int64), np.ones(len(near), np.int64), 0, block_rows
    for p, n in enumerate(near):
        if n > room and room < block_rows:
            block, room = block + 1, block_rows
        first[p], parts[p] = block, max(1, ceil(n / block_rows))
        block, room = (block, room - n) if n <= room else (block + parts[p], block_rows)
    return first, parts


def search_tree(tree: Tree, asked: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, page_nodes: int = PAGE_ROWS // NODE_ROWS) -> DataFrame:
    """query_id, rank, id and score of the best k rows of the tree for each row (id, v) of ``asked``."""
    spark, shape = asked.sparkSession, tree.sphere.shape
    context, path = spark.sparkContext, new_table_path(spark, "top")
    schema = "query_id long, rank int, id long, score long"
    if not len(tree.pivots):
        return spark.createDataFrame([], schema)
    asked = materialize(asked.select("id", "v").distinct().mapInArrow(_assigned(tree.sphere, context.broadcast(tree.pivots)), "id long, v array<long>, pivot int"), "asked")
    near = np.zeros(len(tree.pivots), np.int64)
    for r in asked.groupBy("pivot").count().collect():
        near[r.pivot] = r["count"]
    first, parts = _blocks(near, block_rows)
    place = F.array(*[F.lit(x) for x in first.tolist()])[F.col("pivot")] + F.pmod(F.xxhash64("id", "v"), F.array(*[F.lit(x) for x in parts.tolist()])[F.col("pivot")])
    asked = asked.withColumn("block", place)
    blocks = sorted(r.block for r in asked.select("block").distinct().collect())
    out = spark.createDataFrame([], schema)
    for b in blocks:
        mine = asked.where(F.col("block") == b).orderBy("id", "v").toArrow()  # block_rows rows, or a few more
        ids, vectors = mine.column("id").to_numpy(), matrix(mine.column("v"), shape)
        block = Queries.of(ids, vectors, k, tree)

        def among(pivots: np.ndarray) -> DataFrame:
            return tree.nodes if len(pivots) == len(tree.pivots) else tree.nodes.where(F.col("pivot").isin(pivots.tolist()))

        homes = among(np.unique(block.to_pivots.argmin(axis=1)))
        found = _ranked(homes.mapInArrow(_searched(context.broadcast(block), page_nodes, True), "q int, id long, score long"), k)
        bound = found.where(F.col("rank") == k).select("q", "score").toArrow()  # a number for each query of the block
        block.least[bound.column("q").to_numpy()] = bound.column("score").to_numpy()
        open_ = np.flatnonzero((block.to_pivots - tree.cover[None] <= block.reach(block.least)[:, None]).any(axis=0))
        names = spark.createDataFrame(pa.table({"q": np.arange(len(ids), dtype=np.int32), "query_id": ids}))
        found = _ranked(among(open_).mapInArrow(_searched(context.broadcast(block), page_nodes, False), "q int, id long, score long"), k)
        out = found.join(F.broadcast(names), "q").select("query_id", "rank", "id", "score")
        if len(blocks) > 1:
            out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path) if len(blocks) > 1 else out


def metric_topk(
    df: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, id and score: the best k other rows of df for each row for which ``asked`` (over the column id) holds."""
    rows = materialize(whole_vectors(df, id_col, vector_col, scale), "vectors")
    shape = shape_of(rows)
    return search_tree(build_tree(rows.select("id", "v"), shape), rows.where(asked).select("id", "v"), k, block_rows)
