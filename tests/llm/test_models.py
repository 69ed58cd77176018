import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(pairs):
    return sum(a == b for a, b in pairs) / len(pairs)


def test_language_on_held_out_rows(spark):
    want = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    got = queries.op2_language_id(spark, SF).collect()
    assert len(got) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert accuracy([(r.lang_pred, want[r.doc_id]) for r in got if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the hat", "en")] * 6 + [("der hund und das haus", "de")] * 6)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "the hat"), (4, "the hat"), (None, "DAS HAUS"), (5, "日本語のテキスト" * 50)]
    got = language.identify_language(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), model).collect()
    assert [r.lang_pred for r in got[:6]] == ["und", "und", "und", "en", "en", "de"]
    assert [r.score for r in got[:3]] == [0.0] * 3 and got[6].rejected
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.fit_languages(empty).predict(["abc"])[0] == ["und"]
    assert language.identify_language(empty, model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    want = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    got = queries.op9_toxicity(spark, SF).collect()
    own = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert len(got) == 1000 and accuracy(own) > 0.93
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in got)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)) + ". "
    rows = []
    for i in range(200):
        body = [sentence() for _ in range(8)]
        if i % 5 == 0:
            body[i % 8] = "Öh you are BADWORD! "
        rows.append((i, "".join(body), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    return docs, labels, rows


def test_toxicity_locates_the_sentence(spark, planted):
    docs, labels, rows = planted
    model = toxicity.fit_toxicity(docs, labels)
    for r in toxicity.score_toxicity(docs, model).collect():
        assert (r.score >= 0.5) == bool(rows[r.doc_id][2])
        assert [rows[r.doc_id][1][s.start : s.stop] for s in r.offending] == (["Öh you are BADWORD"] if rows[r.doc_id][2] else [])
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "Öh YOU are badword", "q"), (4, "...", "q"), (4, "alpha " * 200_000, None)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(odd, model).collect()}
    assert got[1].score == got[2].score == 0 and got[None].score > 0.5
    assert sorted(r.text or "-" for r in toxicity.keep_clean(odd, model).collect())[:3] == ["-", "-", "..."]
    assert toxicity.keep_clean(odd, model).count() == 4 and toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.fit_toxicity(docs.limit(0), labels.limit(0))
    assert toxicity.score_toxicity(docs, none).agg(F.max("score")).first()[0] < 1e-6


def test_toxicity_of_a_long_clean_text(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    rows = duckdb.sql(f"select text from '{SF}/documents.parquet' join (select doc_id, max(toxic) as toxic from '{SF}/labels.parquet' group by 1) using (doc_id) where toxic = 0 order by doc_id").fetchall()
    fine = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string")
    clean = [r.text for r in toxicity.keep_clean(fine, model).collect()]
    long = spark.createDataFrame([(1, "\n".join(clean * 5)), (2, "quiet words here. " * 50_000)], "doc_id long, text string")
    assert len(clean) > 0.9 * len(rows)
    got = toxicity.score_toxicity(long, model).collect()
    assert all(r.score < 0.5 and not r.offending for r in got)
    assert toxicity.keep_clean(long, model).count() == 2


def plain_language(model, text):
    """The nearest centroid with the text's n-grams counted one by one."""
    import numpy as np

    from quillspark.llm.texts import mix

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    chars, out = [], np.zeros(language.DIMENSIONS)
    for c in text + " ":
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            chars.append(low)
        elif chars and chars[-1] != " ":
            chars.append(" ")
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            code = 0
            for c in chars[i : i + n]:
                code = code * 0x110000 + ord(c)
            out[int(mix(np.array([(code + n) % 2**64], np.uint64))[0] >> np.uint64(52))] += 1
    v = np.where(out > 0, np.log1p(out), 0.0) * model.idf
    similarity = model.centers @ (v / max(np.linalg.norm(v), 1e-12))
    return model.languages[int(similarity.argmax())], float(np.clip(similarity.max(), 0, 1))


def test_language_against_plain_counting(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_languages(docs, learn=queries._remainder("id", 3) != 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_language_id(spark, sf).collect():
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-5)


def plain_toxicity(model, text):
    """Noisy-or over sentences that are split and hashed one by one."""
    import numpy as np
    import pyarrow as pa

    from quillspark.llm.texts import Slice, utf8

    clean, some, word = 1.0, False, []
    sentences = [[]]
    for b in (text or "").encode().lower() + b"\n":
        if b >= 128 or chr(b).isalnum():
            word.append(b)
            continue
        if word:
            sentences[-1].append(bytes(word))
            word = []
        if b in b".!?\n":
            sentences.append([])
    for own in filter(None, sentences):
        some = True
        data, offsets = utf8(pa.array([b" ".join(own).decode("utf-8")]))
        s = Slice(data, offsets, 0, 1)
        codes = {int(h) >> (64 - toxicity.BITS) for h in s.hashes(s.words())}
        weights = [float(model.weights[c]) for c in codes if model.weights[c] != 0]
        p = 1 / (1 + np.exp(-(model.bias + sum(weights)))) if weights else 0.0
        clean *= 1 - p
    return 1 - clean * (1 - model.leak) if some else 0.0


def test_toxicity_against_plain_noisy_or(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"), learn=queries._remainder("id", 5) != 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op9_toxicity(spark, sf).collect()
    assert len(got) == len(texts) and all(r.score == pytest.approx(plain_toxicity(model, texts[r.doc_id]), abs=1e-6) for r in got)


@pytest.mark.parametrize("every", [3, 40])
def test_toxicity_is_learnt_at_any_rate(spark, every):
    rng = random.Random(every)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst")
    rows = [(i, " ".join(word() for _ in range(30)) + (" you vile person. " if i % every == 0 else " you fine person. ") + word(), int(i % every == 0)) for i in range(800)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert all((r.score >= 0.5) == bool(rows[r.doc_id][2]) for r in toxicity.score_toxicity(docs, model).collect())


def test_weak_sentences_add_up(spark):
    import numpy as np

    weights = np.zeros(1 << toxicity.BITS, np.float32)
    import pyarrow as pa

    from quillspark.llm.texts import Slice, utf8

    data, offsets = utf8(pa.array(["meh"]))
    s = Slice(data, offsets, 0, 1)
    weights[int(s.hashes(s.words())[0]) >> (64 - toxicity.BITS)] = 3.0
    model = toxicity.ToxicityModel(weights, -5.0, 0.001)
    rows = [(n, "meh you. fine day. " * n) for n in (1, 3, 10, 50)] + [(0, "fine day. " * 10_000)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    alone = 1 / (1 + np.exp(2.0))
    assert all(got[n].score == pytest.approx(1 - 0.999 * (1 - alone) ** n) for n in (1, 3, 10, 50, 0))
    assert got[0].score < 0.01 and got[50].score > 0.99 and not got[50].offending


def test_a_labelled_id_that_comes_often_is_learnt_from_once(spark, planted):
    docs, labels, rows = planted
    often = docs.unionByName(spark.range(20_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("calm words here "), F.col("id").cast("string")).alias("text")))
    seen = []
    train = toxicity.train
    toxicity.train = lambda bags: (seen.append(bags.num_rows), train(bags))[1]
    try:
        model = toxicity.fit_toxicity(often, labels)
    finally:
        toxicity.train = train
    assert seen == [200]
    assert all((r.score >= 0.5) == bool(rows[r.doc_id][2]) for r in toxicity.score_toxicity(docs, model).collect())


def test_training_against_plain_gradients():
    """The loss of the trained model is no worse than that of small changes to its weights."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(6)) + (". you brute. " if i % 4 == 0 else ". you dear. ") + "x", int(i % 4 == 0) ^ (rng.random() < 0.05)) for i in range(400)]
    batch = pa.record_batch([pa.array([t for t, _ in rows]), pa.array([y for _, y in rows], pa.int32())], names=["text", "label"])
    model = toxicity.train(pa.Table.from_batches(list(toxicity._bags(iter([batch])))).combine_chunks())

    def loss(weights):
        changed = toxicity.ToxicityModel(weights, model.bias, model.leak)
        s = np.clip([plain_toxicity(changed, t) for t, _ in rows], 1e-9, 1 - 1e-9)
        return -np.mean([np.log(p if y else 1 - p) for p, (_, y) in zip(s, rows)])

    best = loss(model.weights)
    for k in np.flatnonzero(model.weights):
        for step in (-1.0, 1.0):
            other = model.weights.copy()
            other[k] += step
            assert loss(other) > best - 0.01
