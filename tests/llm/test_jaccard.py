import random
from collections import defaultdict

import pytest

from quillspark.llm import jaccard_join
from quillspark.llm.components import components
from quillspark.llm.jaccard_join import jaccard_classes, keep_one_of_each, least_matches
from tests.llm.brute import WORD

SCHEMA = "doc_id long, text string, id string, key string"


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (rows[i][0], min(ids) if ids else None, len(links[i]))
    return sorted(out.values(), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " \n", "one", "one", "a b c", "a b c", "a b d"]
    for size in (40, 60, 200):
        base = [word() for _ in range(size)]
        for k in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(size)] = word()
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)] + ["long " * 30_000]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [64, 8])
def test_classes_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_BLOCK", block)
    if block == 8:  # many blocks and tiles of a few rows; counts by the product of matrices
        for name, value in {"LARGE_BLOCK": 8, "TILE": 3, "FEW": 0}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(block) + [(None, "one"), (None, None), (20, corpus(block)[20][1])]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in jaccard_classes(docs).collect()), key=str)
    assert got == brute(rows)
    kept = keep_one_of_each(docs)
    want = sorted({i for i, c, _ in brute(rows) if i is not None and i == c})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns


def test_only_copies_go_where_ids_repeat_or_are_null(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "quite another text of nine or ten words here")
    rows = [(3, a), (7, a), (7, b), (9, b), (None, a), (None, c), (None, c), (None, ""), (None, ""), (4, c + " x"), (5, "d e f g h"), (5, "d e f g h"), (5, "e f g h i")]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # c without an id is no near copy of c + " x": 5 of 6 shingles are shared, 0.83, so it is.
    assert sorted(map(tuple, kept), key=str) == sorted([(3, a), (7, b), (None, ""), (None, ""), (4, c + " x"), (5, "d e f g h"), (5, "e f g h i")], key=str)


def test_blocks_meet_once_where_sizes_allow(spark):
    """Every two rows of one part or of neighbouring parts meet in exactly one pair of blocks, others in none."""
    rows = [("g" if i % 3 else "h", i % 5, bytes([i])) for i in range(120)]
    df = spark.createDataFrame(rows, "of string, part long, key binary")
    parts = df.groupBy("of", "part").count().selectExpr("of", "part", "count * 100 as size", "0L as bytes")
    got = jaccard_join._in_block_pairs(df, parts).collect()
    runs, met = defaultdict(list), defaultdict(int)
    for r in got:
        runs[r.of, r.part, r.ordinal].append((r.within, r.role, bytes(r.key)[0]))
    for own in runs.values():
        assert len({w for w, _, _ in own}) == 1
        for i, (within, p, x) in enumerate(own):
            for _, q, y in own[:i]:
                if within or p != q:
                    met[frozenset((x, y))] += 1
    want = {frozenset((i, j)) for i in range(120) for j in range(i) if rows[i][0] == rows[j][0] and abs(rows[i][1] - rows[j][1]) <= 1}
    assert set(met) == want and set(met.values()) == {1}

def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_classes(empty).count() == 0 and keep_one_of_each(empty).count() == 0


def test_bounds_grow_with_the_evidence():
    need = least_matches(0.8, 1e-4)
    assert need[0] == 0 and all(a < b for a, b in zip(need, need[1:])) and need[-1] < 0.8 * 120


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
