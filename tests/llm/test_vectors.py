import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives, metric_tree, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score string"
NAN, INF = float("nan"), float("inf")


def usable(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def product(a, b, scale):
    return sum(math.floor(scale * x) * math.floor(scale * y) for x, y in zip(a, b, strict=False))


def plain_topk(rows, asked, k, scale=1024):
    rows, out = usable(rows), []
    for q in {(r[0], tuple(r[1])) for r in rows if asked(r[0])}:
        best = sorted((-product(q[1], r[1], scale), r[0]) for r in rows if r[0] != q[0])[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def plain_negatives(rows, asked, scale=256):
    rows, out = [r for r in usable(rows) if r[2] is not None], []
    for a in {(r[0], tuple(r[1]), r[2]) for r in rows if asked(r[0])}:
        own = sorted((-product(a[1], r[1], scale), r[0], r[2]) for r in rows if r[0] != a[0])
        for p in [x for x in own if x[2] == a[2]][:5]:
            inside = [x for x in own if x[2] != a[2] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            out += [(a[0], p[1], n + 1, x[1], -p[0], -x[0]) for n, x in enumerate(inside[:5])]
    return sorted(out)


def clustered(seed, n, width=6, copies=0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.randint(0, 3), "x") for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 3, "x") for i in range(copies)]


ODD = [
    (None, [1.0, 1.0], 1, "x"), (10, None, 1, "x"), (11, [1.0, None], 1, "x"), (12, [NAN, 0.0], 1, "x"), (13, [INF, 0.0], 1, "x"), (14, [0.1, 0.2], None, "x"),
    (20, [0.5, 0.5], 1, "x"), (20, [0.5, 0.5], 1, "x"), (20, [0.5, -0.5], 2, "x"), (21, [0.5], 1, "x"), (22, [], 1, "x"), (30, [0.0, 0.0], 1, "x"),
    (31, [0.5, 0.49], 2, "x"), (32, [0.5, 0.49], 2, "x"), (33, [-0.5, -0.5], 1, "x"), (40, [0.45, 0.45], 1, "x"), (40, [0.45, 0.45], 1, "x"),
]


@pytest.mark.parametrize("rows", [ODD, clustered(1, 700, copies=400), clustered(2, 300, width=3)])
def test_topk_against_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = metric_tree.metric_topk(df, F.col("id") % 10 == 0, k=4).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == plain_topk(rows, lambda i: i % 10 == 0, 4)


def test_topk_by_small_pages_and_blocks(spark):
    rows = clustered(3, 600, copies=200)
    whole = vectors.whole_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 1024).cache()
    tree = metric_tree.build_tree(whole, vectors.shape_of(whole), page_rows=50, node_rows=8, most_pivots=10)
    assert tree.nodes.agg(F.sum("n")).first()[0] == 800 and tree.nodes.agg(F.max("n")).first()[0] <= 8 and len(tree.pivots) > 1
    for n in tree.nodes.collect():  # every row within its node's radius, every node within its pivot's
        assert max(n.away) <= n.radius and n.reach <= tree.cover[n.pivot] and n.n == len(n.ids) == len(n.away)
    got = metric_tree.search_tree(tree, whole.where("id % 10 = 0"), k=4, block_rows=16, page_nodes=3).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == plain_topk(rows, lambda i: i % 10 == 0, 4)


def test_bounds_save_scores():
    rng = np.random.default_rng(5)
    centres = rng.uniform(-900, 900, (20, 8))
    v = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 10, (4000, 8)))
    shape = vectors.Shape(4000, 8, float((v * v).sum(axis=1).max()) + 1)
    sphere = metric_tree.Sphere(shape)
    points = sphere.lifted(v)
    pivots = points[metric_tree.far_apart(points, 16)]
    near = metric_tree.Sphere.distances(points, pivots).argmin(axis=1)
    pages = []
    for p in range(len(pivots)):
        own, nodes = np.flatnonzero(near == p), []
        for leaf in metric_tree.leaves(points[own], 32):
            at = own[leaf]
            away = metric_tree.Sphere.distances(points[at], points[at[:1]])[:, 0]
            apart = float(metric_tree.Sphere.distances(points[at[:1]], pivots[p : p + 1])[0, 0])
            nodes.append({"pivot": p, "apart": apart, "radius": away.max(), "centre": 0, "ids": at, "away": away, "v": v[at]})
        pages.append(nodes)
    tree = metric_tree.Tree(None, pivots, np.zeros(len(pivots)), sphere)
    search = metric_tree.Search(metric_tree.Queries.of(np.arange(40), v[:40], 5, tree))
    home = search.q.to_pivots.argmin(axis=1)
    for nodes in pages:
        search.page(nodes, home)
    bounded = metric_tree.Search(metric_tree.Queries.of(np.arange(40), v[:40], 5, tree))
    bounded.least[:] = search.score[:, -1]
    bounded.reach = bounded.q.reach(bounded.least)
    for nodes in pages:
        bounded.page(nodes)
    s = (v[:40] @ v.T).astype(int)
    s[np.arange(40), np.arange(40)] = -(10**9)
    want = np.stack([np.lexsort((np.arange(4000), -row))[:5] for row in s])
    assert (bounded.id == want).all() and bounded.computed < 0.5 * 40 * 4000


@pytest.mark.parametrize("rows", [ODD, clustered(4, 500, copies=300), clustered(5, 200, width=3)])
@pytest.mark.parametrize("block", [7, 1000])
def test_negatives_against_all_pairs(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, block_rows=block).collect()
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got) == want and (want or rows is ODD)


def test_no_vectors_and_vectors_too_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert metric_tree.metric_topk(empty, F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(empty, F.col("id") % 10 == 0).count() == 0
    none = spark.createDataFrame([(1, [], 1, "x"), (2, [], 2, "x")], SCHEMA)
    assert [tuple(r) for r in metric_tree.metric_topk(none, F.lit(True)).orderBy("query_id").collect()] == [(1, 1, 2, 0), (2, 1, 1, 0)]
    large = [(i, [float(3**i), -1.5], i % 2, "x") for i in range(12)]
    got = metric_tree.metric_topk(spark.createDataFrame(large, SCHEMA), F.col("id") % 5 == 0, k=3).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == plain_topk(large, lambda i: i % 5 == 0, 3)
    with pytest.raises(ValueError):
        metric_tree.metric_topk(spark.createDataFrame([(1, [1e30], 1, "x")], SCHEMA), F.lit(True))
