from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from quillspark.functions.language import Profiles, learn_profiles
from quillspark.operators import generations as G, search as S, snapshots as D

SF = "/root/testdata/sf0.001"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = learn_profiles(docs.where("doc_id % 3 <> 1"), "text", "lang")
    want = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet' where doc_id % 3 = 1").fetchall())
    got = [r for r in profiles.identify(docs, "doc_id", "text").collect() if r.doc_id in want]
    said = [r for r in got if r.lang_found is not None]
    assert len(got) == len(want) and len(said) > 0.9 * len(want) and sum(r.lang_found == want[r.doc_id] for r in said) > 0.97 * len(said)


def test_all_texts_and_languages_teach(spark):
    # 2,500 texts of a language: those of one trigram are more by one only if all are counted. 70 languages more, of two texts each.
    rows = [("aaa" if i % 2 else "bbb", "en") for i in range(2_500)] + [("aaa", "en")] + [(chr(0x4E00 + i) * 3, f"l{i:02d}") for i in range(70)] * 2
    profiles = learn_profiles(spark.createDataFrame(rows, "t string, lang string"), "t", "lang")
    assert len(profiles.languages) == 71
    k = profiles.languages.index("en")
    own = sorted((w[k], t) for t, w in profiles.weights.items() if w[k])
    assert own == [(295, "bbb"), (296, "bb "), (297, " bb"), (298, "aaa"), (299, "aa "), (300, " aa")]


def test_scripts_doubts_and_odd_rows(spark):
    rows = [("the cat and the hat that they had", "en"), ("der hund und das haus und der hut", "de")] * 3 + [("x", None), (None, "en")]
    profiles = learn_profiles(spark.createDataFrame(rows, "t string, lang string"), "t", "lang")
    assert profiles.languages == ("de", "en") and max(w[0] for w in profiles.weights.values()) == 300
    texts = ["the hat that the cat had", "DAS HAUS UND DER HUND", "山上有一座小屋", "これは小屋です", "작은 집", "маленький дом", "το μικρό σπίτι", "בית קטן", "", None, "12 !?", "qqq zzz", "the der", "Hund 山"]
    df = spark.createDataFrame(list(enumerate(texts)), "lang_found long, script string")
    got = {r[0]: (r[1], r[2]) for r in profiles.identify(df, "lang_found", "script").collect()}
    assert [got[i][0] for i in range(12)] == ["en", "de", "zh", "ja", "ko", "ru", "el", "he", None, None, None, None]
    assert all(got[i][1] == 1.0 for i in range(2, 8)) and all(got[i] == (None, 0.0) for i in range(8, 12))
    assert got[12][0] is None and 0.5 <= got[12][1] < 0.65 and got[13][0] == "de"
    empty = spark.createDataFrame([], "t string, lang string")
    none = learn_profiles(empty, "t", "lang")
    assert none == Profiles((), {}) and profiles.identify(empty.withColumn("id", F.lit(1)), "id", "t").count() == 0


def test_a_walk_goes_on_where_it_ended(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=(i * 7) % 40), i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k int").cache()
    plain = [r[0] for r in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])) if r[2] == 2]
    for limit, windows, size in ((7, 64, 50), (30, 2, 16), (500, 64, 33), (80, 64, 400)):
        got, after = [], None
        for _ in range(60):
            page, after = S.date_walk(df, F.col("k") == 2, limit, after, None, windows, size)
            own = [r.id for r in page.collect()]
            assert len(own) <= limit
            got += own
            if after is None:
                break
        assert got == plain
    page, after = S.date_walk(df, F.col("k") == 9, 5, None, None, 2, 50)  # the windows are used up before a row is found
    assert page.count() == 0 and after is not None
    assert S.date_walk(df.limit(0), F.col("k") == 2, 5)[1] is None
    old, _ = S.date_walk(df, F.col("k") == 2, 100, None, F.lit(t0 + timedelta(minutes=10)))
    assert all(r.ts <= t0 + timedelta(minutes=10) for r in old.collect()) and old.count() > 0


def test_pairs_of_unusable_generations_have_no_changes(spark):
    files = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "n", None), (2, "a", "x"), (2, "b", "y"), (2, "n", None), (2, "c", "z"), (3, "a", "q")], "generation int, path string, sha string")
    states = spark.createDataFrame([(1, "superseded"), (2, "ready"), (3, "building")], "generation int, status string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 1), (2, 2), (1, 9)], "base int, target int")
    got = {tuple(r) for r in D.diffs(files, states, pairs).collect()}
    assert got == {(1, 2, "b", "modified"), (1, 2, "c", "added"), (2, 1, "b", "modified"), (2, 1, "c", "deleted")}


def test_staged_translations_count(spark):
    live = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, record_hash string")
    staged = spark.createDataFrame([(1, "a", 1)], "document_id long, record_hash string, chunk_count long")
    chunks = spark.createDataFrame([(1, "a")], "document_id long, record_hash string")
    translated = spark.createDataFrame([(1, "a"), (1, "old"), (2, "old"), (2, "old"), (3, "gone")], "document_id long, record_hash string")
    assert G.verify_rebuild(live, staged, chunks).first().chunk_hash_mismatch == 0
    assert G.verify_rebuild(live, staged, chunks, translated).first().chunk_hash_mismatch == 3
