import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, tandem_runs
from tests.llm import brute


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def odd_words(rng):
    kind, n = rng.randint(0, 4), rng.randint(0, 70)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return fibonacci(n + 1)
    if kind == 2:
        out = []
        while len(out) < n:
            out += ([rng.choice("abcd") for _ in range(rng.randint(1, 9))] * rng.randint(1, 6))[: rng.randint(1, 50)]
        return out
    return ["x"] * n if kind == 3 else [rng.choice("abcdefghijklmnop") for _ in range(n)]


@pytest.mark.parametrize("limits", [(24, 3), (6, 3), (2, 2), (8, 4)])
def test_runs_against_all_periods(spark, limits):
    rng = random.Random(sum(limits))
    texts = [odd_words(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in tandem_runs.tandem_runs(df, least_words=limits[0], least_periods=limits[1]).collect():
        want = brute.runs(texts[r.doc_id], *limits)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == brute.collapsed(texts[r.doc_id], want)


def test_runs_of_odd_rows(spark):
    period = [f"w{i}" for i in range(3000)]
    long = ["front", *(period * 3), "back"] * 1 + ["tail"] * 200_000
    rows = [
        (1, None, "r"), (2, "", "r"), (3, " \t\n", "r"), (4, "ha " * 24, "r"), (4, "ha " * 24, "r"), (None, "ha " * 23, "r"), (5, "é ß " * 30, "r"),
        (6, " ".join(long), None), (7, "one two three", "r"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").coalesce(1)
    got = tandem_runs.tandem_runs(df).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    said = [[tuple(x) for x in r.runs] for r in got]
    assert said == [[], [], [], [(0, 24, 1)], [(0, 24, 1)], [], [(0, 30, 1)], [(1, 9000, 3000), (9002, 200_000, 1)], []]
    assert [r.collapsed for r in got][:7] == ["", "", "", "ha", "ha", " ".join(["ha"] * 23), "é ß"]
    assert got[7].collapsed.split() == ["front", *period, "back", "tail"] and got[8].collapsed == "one two three"
    assert tandem_runs.tandem_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tandem_runs.tandem_runs(df, least_periods=1)


def test_the_strongest_run_is_exact(spark):
    df = spark.sql("select 1 as doc_id, '' as collapsed, array(named_struct('start', 0L, 'length', 30L, 'period', 7L), named_struct('start', 9L, 'length', 60L, 'period', 14L), named_struct('start', 70L, 'length', 31L, 'period', 7L)) as runs")
    r = tandem_runs.runs_digest(df).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (3, 70, 31, 7, 4428)
    r = tandem_runs.runs_digest(df.withColumn("runs", F.slice("runs", 1, 2))).first()
    assert (r.start, r.length, r.period) == (0, 30, 7)


def test_the_query_against_all_periods(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_tandem_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words, h = brute.WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        want, r = brute.runs(words), got[i]
        assert r.n_runs == len(want) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute.collapsed(words, want).encode()).hexdigest()
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
