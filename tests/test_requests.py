from dataclasses import replace
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.operators import metadata as M, requests as R, search as S

DEFS = (M.MetadataDef("k", "integer"), M.MetadataDef("tag", "keyword"), M.MetadataDef("old", "integer", state="building"), M.MetadataDef("plain", "keyword", sortable=False))


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["red fox", "blue fox", "red hen", "green owl", "red fox and hen"]
    docs = [
        (i, f"story {i}", [f"story {i}", f"a {words[i % 5]} walks", "- the end -"], f"h{i}", "s" + str(i % 2), datetime(2024, 1, 1 + i % 28), '{"k": %d, "tag": "t%d"}' % (i, i % 3))
        for i in range(60)
    ]
    documents = spark.createDataFrame(docs, "document_id long, title string, lines array<string>, record_hash string, source string, published_at timestamp, metadata_json string").cache()
    # The word "translated" is in translations alone; that of 3 was made from another version.
    translated = [(i, "en", f"story {i}", [f"translated {words[i % 5]}"], f"h{i}" if i != 3 else "old") for i in (2, 3, 5)]
    translations = spark.createDataFrame(translated, "document_id long, target_locale string, title string, lines array<string>, source_record_hash string")
    vectors = spark.createDataFrame([(i, i, 1, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, document_id long, chunk_index int, embedding array<double>").cache()
    return R.Corpus(documents, translations, vectors, "m1", DEFS, 4)


def embed(_):
    return [1.0, 2.0, 3.0]


def shown(page):
    return [(r.document_id, r.chunk_index, r.content_locale) for r in page.items.orderBy("rank").collect()]


def overlap(hits):
    return S.overlap_scores(hits, "red fox")


def broken(_):
    raise TimeoutError("no answer")


def test_pages_join_to_the_whole_order(corpus):
    whole = R.search(corpus, R.SearchRequest("red fox", 100), embed=embed)
    assert whole.has_more is False and whole.next_cursor is None and whole.total == whole.items.count()
    for reranker in (None, overlap):
        everything = shown(R.search(corpus, R.SearchRequest("red fox", 100), embed=embed, reranker=reranker))
        request, got, seen = R.SearchRequest("red fox", 25), [], 0
        while True:
            page = R.search(corpus, request, embed=embed, reranker=reranker)
            got += shown(page)
            assert page.reranked == (reranker is not None) and (page.prev_cursor is None) == (seen == 0)
            seen += 1
            if page.next_cursor is None:
                break
            request = replace(request, cursor=page.next_cursor)
        assert seen >= 3 and got[:80] == everything[:80]


def test_foreign_cursors_are_refused(corpus):
    request = R.SearchRequest("red fox", 5)
    local, reranked = R.search(corpus, request, embed=embed).next_cursor, R.search(corpus, request, embed=embed, reranker=overlap).next_cursor
    again = replace(request, cursor=local)
    for other, c, settings in [
        (replace(again, query="red hen"), corpus, R.SearchSettings()), (replace(again, limit=6), corpus, R.SearchSettings()), (replace(again, locale="de"), corpus, R.SearchSettings()),
        (replace(again, filters=R.Filters(source="s1")), corpus, R.SearchSettings()), (again, replace(corpus, generation=5), R.SearchSettings()),
        (again, corpus, R.SearchSettings(weights=S.FusionWeights(0.4, 0.4))),
    ]:
        with pytest.raises(ValueError, match="another search"):
            R.search(c, other, settings, embed=embed)
    with pytest.raises(ValueError, match="local order"):
        R.search(corpus, again, embed=embed, reranker=overlap)
    with pytest.raises(ValueError, match="reranked order"):
        next(R.search_stream(corpus, replace(request, cursor=reranked), embed=embed))
    context = R._context(corpus, request, R.SearchSettings())
    with pytest.raises(ValueError, match="beginning of a page"):
        R.search(corpus, replace(request, cursor=R.encode_search_cursor(3, False, context)), embed=embed)
    for odd in ("", "xx", "e30="):
        with pytest.raises(ValueError, match="can't be read"):
            R.search(corpus, replace(request, cursor=odd), embed=embed)
    for wrong in (replace(request, limit=0), replace(request, limit=101), replace(request, page=0), replace(request, query="  ")):
        with pytest.raises(ValueError):
            R.search(corpus, wrong, embed=embed)


def test_two_stages_and_a_failing_reranker(corpus):
    request = R.SearchRequest("red fox", 10)
    stages = list(R.search_stream(corpus, request, embed=embed, reranker=overlap))
    assert [s for s, _ in stages] == ["local", "reranked"] and shown(stages[0][1]) == shown(R.search(corpus, request, embed=embed))
    scores = [r.rerank_score for r in stages[1][1].items.orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True) and scores[0] == 1.0
    failed = R.search(corpus, request, embed=embed, reranker=broken)
    assert failed.rerank_error == "TimeoutError" and not failed.reranked and shown(failed) == shown(stages[0][1])


def test_the_fallback_names_its_reason(corpus):
    request = R.SearchRequest("red fox", 10)
    words = shown(R.search(replace(corpus, vectors=None), request, embed=embed))
    for reason, c, e, identity in [("not_configured", corpus, None, None), ("not_vectorized", replace(corpus, vectors=None), embed, None), ("identity_mismatch", corpus, embed, "m2"), ("runtime", corpus, broken, None)]:
        page = R.search(c, request, embed=e, identity=identity)
        assert page.fallback == reason and shown(page) == words
    assert R.search(corpus, request, embed=embed).fallback is None


def test_vectors_alone_and_each_sides_own_text(corpus):
    page = R.search(corpus, R.SearchRequest("red fox", 10), R.SearchSettings(hybrid=False), embed=embed, reranker=overlap)
    rows = page.items.orderBy("rank").collect()
    assert not page.reranked and [r.score for r in rows] == sorted((r.vector_score for r in rows), reverse=True) and all(r.keyword_score is None for r in rows)
    only = R.search(replace(corpus, vectors=None), R.SearchRequest("translated", 10))
    assert sorted(shown(only)) == [(2, 0, "en"), (5, 0, "en")] and only.total == 2
    assert shown(R.search(replace(corpus, vectors=None), R.SearchRequest("translated", 10, locale="fr"))) == []
    assert shown(R.search(replace(corpus, vectors=None, translations=None), R.SearchRequest("translated", 10))) == []


def test_filters_hold_for_both_channels(corpus):
    filters = R.Filters("s1", datetime(2024, 1, 5), "2024-01-20", (M.MetadataFilter("k", "range", min=10), M.MetadataFilter("tag", "in", ["t0", "t1"])))
    page = R.search(corpus, R.SearchRequest("red fox", 100, filters=filters), embed=embed)
    got = {r.document_id for r in page.items.collect()}
    assert got == {i for i in range(60) if i % 2 and 4 <= i % 28 <= 19 and i >= 10 and i % 3 < 2}
    with pytest.raises(ValueError, match="declared"):
        R.search(corpus, R.SearchRequest("red", filters=R.Filters(metadata=(M.MetadataFilter("zz", "exists"),))), embed=embed)


SORT = (R.SortKey("tag", True, True), R.SortKey("published_at"))


def pages(corpus, query, **more):
    got, seen = [], []
    while True:
        page = R.query_documents(corpus.documents, query, DEFS, **more)
        got += [r.document_id for r in page.items.orderBy("place").collect()]
        seen.append(page)
        if not page.has_more:
            return got, seen
        query = replace(query, cursor=page.next_cursor)


@pytest.mark.parametrize("limit", [1, 7, 200])
def test_document_pages_join_to_the_plain_order(corpus, limit):
    few = replace(corpus, documents=corpus.documents.where("document_id < 20"))
    got, seen = pages(few, R.DocumentQuery(R.Filters(metadata=(M.MetadataFilter("k", "range", min=3, max=16),)), SORT, limit))
    assert got == sorted(range(3, 17), key=lambda i: (-(i % 3), i % 28, i)) and all(p.n_hydrated <= limit + 1 and p.n_dropped == 0 for p in seen)
    assert seen[-1].next_cursor is None


def test_a_stale_index_neither_adds_nor_leaves_out(spark, corpus):
    values = corpus.documents.select("document_id", F.get_json_object("metadata_json", "$.k").cast("long").alias("k"), F.concat(F.lit("t"), F.col("document_id") % 3).alias("tag"), F.lit("p").alias("plain"))
    stale = values.withColumn("k", F.when(F.col("document_id") % 2 == 0, 5).otherwise(F.col("k")))  # says 5 of all even documents
    query = R.DocumentQuery(R.Filters(metadata=(M.MetadataFilter("k", "range", max=12),)), (R.SortKey("k", False, True),), 4)
    got, seen = pages(corpus, query, values=stale)
    assert sorted(got) == list(range(13)) and sum(p.n_dropped for p in seen) > 0
    assert all(p.items.count() == 4 for p in seen[:-1])
    page = R.query_documents(corpus.documents, query, DEFS, recheck=F.col("document_id") % 3 == 0)
    assert [r.document_id for r in page.items.orderBy("place").collect()] == [0, 3, 6, 9] and page.has_more


def test_queries_are_checked_before_they_are_planned(corpus):
    ask = lambda **k: R.query_documents(corpus.documents, R.DocumentQuery(**k), DEFS)
    for k, said in [
        ({"limit": 0}, "limit"), ({"limit": 201}, "limit"), ({"sort": (R.SortKey("title"),) * 4}, "sort keys"), ({"sort": (R.SortKey("nope", metadata=True),)}, "declared"),
        ({"sort": (R.SortKey("old", metadata=True),)}, "ready"), ({"sort": (R.SortKey("plain", metadata=True),)}, "sortable"), ({"sort": (R.SortKey("lines"),)}, "sort key"),
        ({"filters": R.Filters(metadata=(M.MetadataFilter("old", "exists"),))}, "ready"),
    ]:
        with pytest.raises(ValueError, match=said):
            ask(**k)
    cursor = ask(sort=(R.SortKey("published_at"),), limit=5).next_cursor
    with pytest.raises(ValueError, match="another query"):
        ask(sort=(R.SortKey("title"),), limit=5, cursor=cursor)
    empty = R.query_documents(corpus.documents.limit(0), R.DocumentQuery(), DEFS)
    assert empty.items.count() == 0 and not empty.has_more and empty.next_cursor is None


def test_cursors_keep_types():
    values = [datetime(2024, 5, 1, 2, 3, 4, 5), Decimal("1.50"), None, "x", 7, 1.5, datetime(2024, 5, 1).date()]
    assert M.decode_cursor({"a": 1}, M.encode_cursor({"a": 1}, values, Decimal("3"))) == (values, Decimal("3"))


def test_weights_are_clamped():
    w = S.FusionWeights(0.9, 0.5)
    assert (w.vector, w.keyword, w.boost) == (0.9, pytest.approx(0.1), pytest.approx(0.0)) and S.FusionWeights(2, -1) == S.FusionWeights(1, 0) and S.FusionWeights().boost == pytest.approx(0.1)


def test_the_next_page_takes_the_candidates(corpus):
    asked = []

    def count(_):
        asked.append(1)
        return embed(_)

    request = R.SearchRequest("red fox", 10)
    first = R.search(corpus, request, embed=count)
    again = replace(request, cursor=first.next_cursor)
    plain = shown(R.search(corpus, again, embed=embed))
    assert shown(R.search(corpus, again, embed=count, candidates=first.candidates)) == plain and len(asked) == 1
    # Another search, corpus or window isn't given them; nor is one whose candidates were a fallback's.
    other = replace(request, query="red hen")
    assert shown(R.search(corpus, other, embed=count, candidates=first.candidates)) == shown(R.search(corpus, other, embed=embed)) and len(asked) == 2
    R.search(replace(corpus, generation=5), request, embed=count, candidates=first.candidates)
    R.search(corpus, replace(request, page=9), embed=count, candidates=first.candidates)
    assert len(asked) == 4
    failed = R.search(corpus, request, embed=broken)
    assert failed.fallback == "runtime" and R.search(corpus, request, embed=embed, candidates=failed.candidates).fallback is None


def test_the_second_page_searches_once(spark, monkeypatch):
    from quillspark.plans import catalogue

    calls, collect = [], R.collect_candidates
    monkeypatch.setattr(R, "collect_candidates", lambda *a, **k: calls.append(1) or collect(*a, **k))
    assert catalogue.QUERIES["search_next_page"](spark, "/root/testdata/sf0.001").count() == 8 and len(calls) == 1


def test_only_the_nearest_documents_lines_are_made(spark):
    made = spark.sparkContext.accumulator(0)

    def lines(i):
        made.add(1)
        return [f"story {i}"]

    documents = spark.range(500).select(F.col("id").alias("document_id"), F.lit("t").alias("title"), F.udf(lines, "array<string>")("id").alias("lines"))
    vectors = spark.createDataFrame([(i, i, 0, [1.0, float(i), 1.0]) for i in range(500)], "vec_id long, document_id long, chunk_index int, embedding array<double>")
    page = R.search(R.Corpus(documents, None, vectors, "m1"), R.SearchRequest("story", 10), R.SearchSettings(hybrid=False), embed=embed)
    assert page.items.count() == 10 and made.value <= S.LEAST_CANDIDATES


def test_each_sides_lines_are_made_once(spark):
    """Lines once for the originals and once for the translations, no filter makes them anew; untranslated chunks aren't moved."""
    from quillspark.plans.corpus import corpus as of
    from quillspark.plans.registry import Tables

    c = of(Tables(spark, "/root/testdata/sf0.001"))
    rows = S.searchable(*c.narrowed("the and"), "en", "the and")
    plan = S.keyword_search(rows, "the and", None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(text") == 2 and plan.count("posexplode(lines") == 2
    whole = S.searchable(c.documents, c.translations, "en")
    key = ["document_id", "chunk_index", "content_locale", "keyword_score", "match_reason"]
    got, want = (sorted(map(tuple, S.keyword_search(x, "the and", None).select(*key).collect())) for x in (rows, whole))
    assert got == want and {r[2] for r in got} == {"original", "en"}
