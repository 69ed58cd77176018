import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.decontaminate import Index, Q, contaminations, normalize
from quillspark.llm.shuffle_shards import read_shards, shard_digest, write_shards
from quillspark.session import new_table_path

SCHEMA = "doc_id long, text string, _x string, offset long, _Shard int, bucket string, place double, record array<int>"


def shard_rows():
    rest = (3, "b", 0.5, [1, 2])
    rows = [(i, f"text {i % 50} " * (i % 7), None, i, *rest) for i in range(400)]
    return rows + [(5, "twice", None, 1, *rest)] * 2 + [(None, "null id", None, 1, *rest), (None, None, None, None, None, None, None, None), (401, "long " * 100_000, None, 2, *rest)]


def fixed(row):
    return tuple(tuple(x) if isinstance(x, list) else x for x in row)


def test_shards_hold_every_row_in_shuffled_gapless_slots(spark):
    rows = shard_rows()
    path = new_table_path(spark, "test")
    write_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), path, bucket_bytes=20_000)
    back = read_shards(spark, path)
    assert back.columns[-2:] == ["__shard", "_slot"]
    assert Counter(fixed(r) for r in back.select(*SCHEMA.replace(",", " ").split()[::2]).collect()) == Counter(map(fixed, rows))
    got = shard_digest(back).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
        assert r.grown_shard in (r.shard, 16) and r.law == "key" and r["size"] >= 1
    assert set(by_shard) == set(range(16))
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    ids = [r.doc_id for r in sorted(by_shard[3], key=lambda r: r.slot) if r.doc_id is not None]
    assert ids != sorted(ids)
    again = new_table_path(spark, "test")
    write_shards(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2), again, bucket_bytes=20_000)
    assert Counter(map(tuple, shard_digest(read_shards(spark, again)).collect())) == Counter(map(tuple, got))


@pytest.mark.parametrize("equal", [True, False])
def test_rows_of_one_id_are_dealt_over_buckets(spark, equal):
    from pyspark.sql import functions as F

    path = new_table_path(spark, "test")
    rows = [("hot", "t" * 100 if equal else f"{i} " * 30) for i in range(600)] + [(f"id {i}", "x" * 100) for i in range(100)]
    write_shards(spark.createDataFrame(rows, "doc_id string, text string"), path, n_shards=2, bucket_bytes=2_000)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("shard", "bucket").count().collect()]
    assert sum(sizes) == 700 and max(sizes) < 120
    got = shard_digest(read_shards(spark, path), 2)
    assert got.where("doc_id = 'hot'").agg(F.count_distinct("shard")).first()[0] == 1
    assert got.groupBy("shard").agg((F.max("slot") + 1 == F.count_distinct("slot")).alias("ok")).where("ok").count() == 2
    empty = new_table_path(spark, "test")
    write_shards(spark.createDataFrame([], "doc_id string, text string"), empty)
    assert shard_digest(read_shards(spark, empty)).count() == 0


def test_buckets_are_sized_by_whole_records(spark):
    """Short texts with wide other columns: strings, binaries and nested values all count."""
    rows = [(i, "t", "w" * 2_000, bytes(500), [f"{i}" * 100] * 5) for i in range(300)]
    path = new_table_path(spark, "test")
    write_shards(spark.createDataFrame(rows, "doc_id long, text string, wide string, raw binary, tags array<string>"), path, n_shards=2, bucket_bytes=50_000)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("shard", "bucket").count().collect()]
    assert sum(sizes) == 300 and len(sizes) >= 16 and max(sizes) < 50
    assert shard_digest(read_shards(spark, path)).agg(F.sum("size")).first()[0] == 600


def test_whole_query_keeps_the_law(spark):
    import zlib

    from quillspark.llm.queries import op4_external_shuffle

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_external_shuffle(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by_shard = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        by_shard[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(text):
    chars, _ = normalize(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    return "".join(map(chr, chars)).strip()


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 12, 40, 6, 3, 1])] + [(6, None), (7, ""), (8, "ab"), (1, "second of one id " + word())]
    texts = []
    for _, item in items[:6] * 6:
        chars = list(item)
        for _ in range(rng.choice([0, 1, 2, 4, len(item) // 12, len(item) // 8])):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        texts.append(" ".join(word() for _ in range(20)) + " " + "".join(chars).upper() + ", " + " ".join(word() for _ in range(20)))
    texts += [None, "", "...", items[0][1], items[0][1][: len(items[0][1]) // 2], "AB", " ".join([items[2][1]] * 3), texts[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.budget, r.edits) for r in contaminations(docs, bench).collect()}
    index, want = Index([i for i in items if i[1]]), set()
    for d, t in enumerate(texts):
        for item, k in zip(index.items, index.budgets):
            own, item = plain(t or ""), "".join(map(chr, item))
            if len(item) < Q:
                edits = 0 if f" {item} " in f" {own} " else 99
            else:
                edits = least_edits(item, own)
            if edits <= k:
                want.add((d, k, edits))
    assert got == want
    assert contaminations(docs, bench, block_chars=40).count() == contaminations(docs, bench).count() >= len(want)
    assert contaminations(docs.limit(0), bench).count() == contaminations(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "x" * 9])
def test_index_of_tiny_items(text):
    assert Index([(1, text)]).matches(["", "x" * 9, "b"]) == ([(1, 0, 0, 9, 0)] if text == "x" * 9 else [])


def pairs_of(index, texts):
    return {(row, item, edits) for row, item, _, _, edits in index.matches(texts)}


@pytest.mark.parametrize("length", [14, 60, 110])
def test_items_that_share_a_stem(length):
    """Many items begin alike and texts repeat that beginning: all matches are found, none else, and without a blow-up."""
    rng = random.Random(length)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    stem = "what is the answer to this odd question of "[: length * 2 // 3]
    items = [(i, (stem + some(60))[:length].strip()) for i in range(80)]
    index = Index(items)
    texts = [stem * 30, " ".join(stem + some(4) for _ in range(30)), "", "\U0001f600" + items[3][1] + "\U0001f600\U0001f600 ", some(30)]
    for i, (_, item) in enumerate(items[:12]):
        chars = list(item)
        for _ in range(i % 6):
            chars[rng.randrange(len(chars))] = "z"
        texts.append(stem + some(3) + " " + "".join(chars) + " " + stem)
    want = set()
    for row, text in enumerate(texts):
        for i, (_, item) in enumerate(items):
            edits = least_edits(plain(item), plain(text))
            if edits <= index.budgets[i]:
                want.add((row, i, edits))
    assert len(want) >= 3 and pairs_of(index, texts) == want


def test_stem_in_a_long_text_is_quick():
    import time

    rng = random.Random(5)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    stem = "what is the right answer to this odd question of "
    index = Index([(i, stem + some(14)) for i in range(1000)])
    began = time.time()
    assert index.matches([stem * 20_000]) == []
    text = " ".join(stem + some(9) for _ in range(10_000))
    mine = "".join(map(chr, index.items[7]))
    assert pairs_of(index, [text + " " + mine]) == {(0, 7, 0)}
    assert time.time() - began < 60


def test_ids_of_any_type_and_symbols(spark):
    docs = spark.createDataFrame([("a", "\U0001f600\U0001f600 the quick brown fox jumps"), (None, "THE quick,brown fox jumps!"), ("c", None)], "doc_id string, text string")
    bench = spark.createDataFrame([("x", "the quick brown fox jumps"), (None, "quick brown"), ("y", "\U0001f600")], "item_id string, text string")
    got = {tuple(r) for r in contaminations(docs, bench).collect()}
    assert {(r[0], r[1]) for r in got} == {("a", "x"), ("a", None), (None, "x"), (None, None)} and ("a", "x", 3, 28, 0, 1) in got


def test_whole_query_against_its_operator_and_brute_force(spark):
    from quillspark.llm.queries import op3_decontamination

    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, sf).collect()}
    said = [(d.doc_id, plain(d.text or "")) for d in docs]
    exact = {(i, b.item_id) for i, t in said for b in bench if b.text and f" {plain(b.text)} " in f" {t} "}
    assert exact <= got
    near = got - exact
    own, items = dict(said), {b.item_id: plain(b.text) for b in bench}
    assert all(least_edits(items[b], own[i]) <= max(0, min(int(0.08 * len(items[b])), (len(items[b]) - Q) // Q)) for i, b in list(near)[:20])
