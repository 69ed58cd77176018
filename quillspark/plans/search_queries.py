"""Text and search queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.functions import text as X
from quillspark.operators import metadata as M, requests as R, search as S
from quillspark.plans.corpus import CHUNKS_SQL, LINES_SQL, SEARCHABLE_SQL, chunks, chunks_of, corpus, searchable_chunks
from quillspark.plans.registry import Tables, query

PHRASE = "the and"
PHRASE_SQL = "'the and'"
_SCORE_SQL = f"""
{SEARCHABLE_SQL}, hits AS (
  SELECT document_id, chunk_index, title, chunk_text, content_locale, is_fallback,
    round((lower(title) = {PHRASE_SQL})::INT * 1.20 + (lower(title) LIKE '%the and%')::INT * 1.00 + (lower(chunk_text) LIKE '%the and%')::INT * 0.82 + 0.35, 6)::DOUBLE AS keyword_score,
    CASE WHEN lower(title) = {PHRASE_SQL} THEN 'title_exact' WHEN lower(title) LIKE '%the and%' THEN 'title_phrase'
      WHEN lower(chunk_text) LIKE '%the and%' THEN 'chunk_phrase' ELSE 'all_terms' END AS match_reason
  FROM searchable
  WHERE lower(title) LIKE '%the and%' OR lower(chunk_text) LIKE '%the and%'
    OR (contains(lower(concat(title, ' ', chunk_text)), 'the') AND contains(lower(concat(title, ' ', chunk_text)), 'and')))
"""


@query("normalize_docs", rf"SELECT doc_id, trim(regexp_replace({LINES_SQL}[1], '\s+', ' ', 'g')) AS title, array_to_string({LINES_SQL}, chr(10) || chr(10)) AS body FROM documents")
def normalize_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.element_at(X.normalized_lines(F.col("text")), 1).alias("title"), X.normalize_body(F.col("text")).alias("body"))


@query("normalize_body", f"SELECT doc_id, array_to_string({LINES_SQL}, chr(10) || chr(10)) AS body FROM documents")
def normalize_body(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_body(F.col("text")).alias("body"))


@query("meaningful_line", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '[\p{L}\p{N}]')) AS n_meaningful FROM l GROUP BY doc_id")
def meaningful_line(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike(X.MEANINGFUL)).alias("n_meaningful"))


@query("meaningful_chunk", rf"WITH {CHUNKS_SQL} SELECT document_id, chunk_index FROM chunks WHERE length(regexp_replace(chunk_text, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 2")
def meaningful_chunk(t: Tables) -> DataFrame:
    return chunks(t).where(X.meaningful(F.col("chunk_text"))).select("document_id", "chunk_index")


@query("record_hash", f"SELECT doc_id, sha256(concat_ws(chr(10), {LINES_SQL}[1], '', array_to_string({LINES_SQL}, chr(10) || chr(10)), concat('doc://', doc_id), '{{}}')) AS record_hash FROM documents")
def record_hash(t: Tables) -> DataFrame:
    lines = X.normalized_lines(F.col("text"))
    uri = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", X.record_hash(F.element_at(lines, 1), F.lit(None).cast("string"), F.array_join(lines, "\n\n"), uri, F.lit("{}")).alias("record_hash"))


@query("query_hash", "SELECT item_id, sha256(lower(trim(text))) AS query_hash FROM benchmark")
def query_hash(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.sha2(F.lower(F.trim("text")), 256).alias("query_hash"))


@query(
    "chunk_uuid",
    rf"""WITH {CHUNKS_SQL}, h AS (SELECT document_id, chunk_index, sha1(unhex('{X.URL_NAMESPACE}') || encode(concat_ws(':', source, document_id, chunk_index))) AS h FROM chunks)
    SELECT document_id, chunk_index, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', 1 + (('0x' || h[17:17])::INT % 4), 1), h[18:20], '-', h[21:32]) AS chunk_id FROM h""",
)
def chunk_uuid(t: Tables) -> DataFrame:
    name = F.concat_ws(":", "source", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))
    return chunks(t).select("document_id", "chunk_index", X.uuid5_url(name).alias("chunk_id"))


@query("kw_search", f"WITH {CHUNKS_SQL}, {_SCORE_SQL} SELECT document_id, chunk_index, content_locale, keyword_score, match_reason FROM hits ORDER BY keyword_score DESC, document_id DESC, chunk_index, content_locale LIMIT 20")
def kw_search(t: Tables) -> DataFrame:
    return S.keyword_search(searchable_chunks(t, PHRASE), PHRASE).select("document_id", "chunk_index", "content_locale", "keyword_score", "match_reason")


@query("kw_score", f"WITH {CHUNKS_SQL}, {_SCORE_SQL} SELECT document_id, chunk_index, content_locale, keyword_score FROM hits")
def kw_score(t: Tables) -> DataFrame:
    return S.keyword_search(searchable_chunks(t, PHRASE), PHRASE, None).select("document_id", "chunk_index", "content_locale", "keyword_score")


@query("kw_reason", f"WITH {CHUNKS_SQL}, {_SCORE_SQL} SELECT match_reason, content_locale, count(*) AS n FROM hits GROUP BY 1, 2")
def kw_reason(t: Tables) -> DataFrame:
    return S.keyword_search(searchable_chunks(t, PHRASE), PHRASE, None).groupBy("match_reason", "content_locale").agg(F.count("*").alias("n"))


@query("all_terms_filter", f"WITH {CHUNKS_SQL} SELECT document_id, chunk_index FROM chunks WHERE contains(lower(concat(title, ' ', chunk_text)), 'the') AND contains(lower(concat(title, ' ', chunk_text)), 'with')")
def all_terms_filter(t: Tables) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "title", "chunk_text"))
    return chunks(t).where(hay.contains("the") & hay.contains("with")).select("document_id", "chunk_index")


@query("literal_contains", "SELECT doc_id FROM documents WHERE contains(text, '%') AND contains(text, '&&')")
def literal_contains(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").contains("%") & F.col("text").contains("&&")).select("doc_id")


@query("ilike_multi", "SELECT c_custkey FROM customer WHERE c_name ILIKE concat('%', trim(' 0001 '), '%') OR c_mktsegment ILIKE concat('%', trim(' 0001 '), '%')")
def ilike_multi(t: Tables) -> DataFrame:
    pattern = f"%{' 0001 '.strip()}%"
    return t.customer.where(F.col("c_name").ilike(pattern) | F.col("c_mktsegment").ilike(pattern)).select("c_custkey")


@query("all_terms_division", f"WITH {CHUNKS_SQL}, terms(term) AS (VALUES ('the'), ('and'), ('with')) SELECT document_id FROM chunks JOIN terms ON contains(lower(chunk_text), term) GROUP BY document_id HAVING count(DISTINCT term) = 3")
def all_terms_division(t: Tables) -> DataFrame:
    found = F.filter(F.array(*[F.lit(x) for x in ("the", "and", "with")]), lambda x: F.contains(F.lower("chunk_text"), x))
    return chunks(t).select("document_id", F.explode(found).alias("term")).groupBy("document_id").agg(F.count_distinct("term").alias("n")).where("n = 3").select("document_id")


@query("term_chunk_join", f"WITH {CHUNKS_SQL}, terms(term) AS (VALUES ('the'), ('nicht'), ('pour')) SELECT term, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM chunks JOIN terms ON contains(lower(chunk_text), term) GROUP BY term")
def term_chunk_join(t: Tables) -> DataFrame:
    found = F.filter(F.array(*[F.lit(x) for x in ("the", "nicht", "pour")]), lambda x: F.contains(F.lower("chunk_text"), x))
    rows = chunks(t).select("document_id", F.explode(found).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"))


def _target(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 0").select("embedding").first()[0]


_COSINE_SQL = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS vector_score"


@query("knn_cosine", f"SELECT vec_id, {_COSINE_SQL} FROM embeddings ORDER BY vector_score DESC, vec_id LIMIT 10")
def knn_cosine(t: Tables) -> DataFrame:
    return S.knn(t.embeddings, _target(t), 10).select("vec_id", "vector_score")


@query("knn_filtered", f"SELECT vec_id, label, {_COSINE_SQL} FROM embeddings WHERE label IN (1, 2, 3) ORDER BY vector_score DESC, vec_id LIMIT 10")
def knn_filtered(t: Tables) -> DataFrame:
    return S.knn(t.embeddings, _target(t), 10, F.col("label").isin(1, 2, 3)).select("vec_id", "label", "vector_score")


@query("knn_scoped", f"SELECT vec_id, {_COSINE_SQL} FROM embeddings e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en') ORDER BY vector_score DESC, vec_id LIMIT 10")
def knn_scoped(t: Tables) -> DataFrame:
    scope = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return S.knn(t.embeddings.join(scope, "vec_id", "left_semi"), _target(t), 10).select("vec_id", "vector_score")


@query("vector_validate", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid FROM embeddings")
def vector_validate(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", S.valid_vector(F.col("embedding"), 64).alias("valid"))


@query("vector_mode", f"SELECT vec_id, d.lang, {_COSINE_SQL} FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id ORDER BY vector_score DESC, vec_id LIMIT 15")
def vector_mode(t: Tables) -> DataFrame:
    best = S.knn(t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id"), _target(t), 15)
    return best.select("vec_id", "lang", "vector_score")


WINDOW, _ = S.candidate_window(16)


def _vector_channel(t: Tables) -> DataFrame:
    """The nearest documents' first chunks: only the best are hydrated."""
    eligible = t.documents.where(F.col("text").rlike(X.MEANINGFUL)).select(F.col("doc_id").alias("vec_id"))
    best = S.knn(t.embeddings.join(eligible, "vec_id", "left_semi"), _target(t), WINDOW).select(F.col("vec_id").alias("doc_id"), "vector_score")
    rows = chunks_of(t.documents.join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi")).where("chunk_index = 0")  # WINDOW rows
    return rows.join(F.broadcast(best.withColumnRenamed("doc_id", "document_id")), "document_id")


def _hybrid(t: Tables) -> DataFrame:
    return S.fuse(_vector_channel(t), S.keyword_search(searchable_chunks(t, PHRASE), PHRASE, WINDOW), PHRASE)


_HYBRID_SQL = f"""WITH {CHUNKS_SQL}, {_SCORE_SQL},
kw AS (SELECT * FROM hits ORDER BY keyword_score DESC, document_id DESC, chunk_index, content_locale LIMIT 80),
vec AS (SELECT document_id, chunk_index, title, chunk_text, {_COSINE_SQL} FROM chunks c JOIN embeddings e ON e.vec_id = c.document_id WHERE chunk_index = 0 ORDER BY vector_score DESC, vec_id LIMIT 80),
both_ AS (SELECT document_id, chunk_index, title, chunk_text, 'original' AS content_locale, true AS is_fallback, vector_score, NULL::DOUBLE AS keyword_score, NULL AS mark, 0 AS channel FROM vec
  UNION ALL SELECT document_id, chunk_index, title, chunk_text, content_locale, is_fallback, NULL, keyword_score, match_reason, 1 FROM kw),
merged AS (SELECT document_id, chunk_index, arg_min(title, (is_fallback, channel, content_locale)) AS title, arg_min(chunk_text, (is_fallback, channel, content_locale)) AS chunk_text,
  arg_min(content_locale, (is_fallback, channel, content_locale)) AS content_locale, max(vector_score) AS vector_score, max(keyword_score) AS keyword_score,
  arg_min(mark, (-keyword_score, content_locale)) FILTER (WHERE mark IS NOT NULL) AS mark FROM both_ GROUP BY 1, 2),
scored AS (SELECT *, least(greatest(coalesce(vector_score, 0), 0), 1) * 0.55::DOUBLE + least(coalesce(keyword_score, 0), 2.37::DOUBLE) / 2.37::DOUBLE * 0.35::DOUBLE AS base,
  CASE WHEN lower(trim(title)) = {PHRASE_SQL} THEN 1.8::DOUBLE WHEN contains(lower(trim(title)), {PHRASE_SQL}) THEN 1.4::DOUBLE WHEN contains(lower(chunk_text), {PHRASE_SQL}) THEN 1.0::DOUBLE ELSE 0 END AS tier FROM merged),
final AS (SELECT document_id, chunk_index, content_locale, chunk_text, round(base + least(tier * 0.1::DOUBLE, 1 - base), 6) AS score,
  concat_ws('+', CASE WHEN vector_score IS NOT NULL THEN 'semantic' END, CASE WHEN mark IN ('title_exact', 'title_phrase') THEN 'title' WHEN mark IS NOT NULL THEN 'keyword' END) AS match_reason,
  vector_score IS NOT NULL AND keyword_score IS NOT NULL AS in_both FROM scored)
"""


@query("hybrid_score", _HYBRID_SQL + "SELECT document_id, chunk_index, content_locale, score, match_reason FROM final")
def hybrid_score(t: Tables) -> DataFrame:
    return _hybrid(t).select("document_id", "chunk_index", "content_locale", "score", "match_reason")


@query("hybrid_merge", _HYBRID_SQL + "SELECT count(*) AS n, count(*) FILTER (WHERE in_both) AS n_both, count(*) FILTER (WHERE content_locale = 'en') AS n_translated FROM final")
def hybrid_merge(t: Tables) -> DataFrame:
    both = F.col("vector_score").isNotNull() & F.col("keyword_score").isNotNull()
    return _hybrid(t).agg(F.count("*").alias("n"), F.count_if(both).alias("n_both"), F.count_if(F.col("content_locale") == "en").alias("n_translated"))


@query("match_reason", _HYBRID_SQL + "SELECT match_reason, count(*) AS n FROM final GROUP BY 1")
def match_reason(t: Tables) -> DataFrame:
    return _hybrid(t).groupBy("match_reason").agg(F.count("*").alias("n"))


@query("search_window", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 2100 AS requested, o_custkey % 90 AS candidate_limit, o_orderkey % 3 = 0 AS filtered, o_custkey % 4000 AS found FROM orders),
w AS (SELECT *, requested < 2000 AS can_probe, least(2000, greatest(CASE WHEN requested < 2000 THEN requested + 1 ELSE requested END, 80, candidate_limit, 1) * CASE WHEN filtered THEN 8 ELSE 1 END) AS room FROM r),
c AS (SELECT *, least(found, room) AS collected, found >= room AS capped FROM w)
SELECT id, room, greatest(collected, CASE WHEN collected > requested THEN requested + 1 ELSE 0 END) AS total, CASE WHEN collected > requested THEN true WHEN NOT can_probe OR capped THEN NULL ELSE false END AS has_more FROM c""")
def search_window(t: Tables) -> DataFrame:
    r = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2100).alias("requested"), (F.col("o_custkey") % 90).alias("candidate_limit"), (F.col("o_orderkey") % 3 == 0).alias("filtered"),
        (F.col("o_custkey") % 4000).alias("found"),
    )
    fetch, can_probe = S.candidate_window_of(F.col("requested"), F.col("candidate_limit"), F.col("filtered"))
    c = r.withColumn("room", fetch).withColumn("can_probe", can_probe)
    state = S.window_state(F.least("found", "room"), F.col("requested"), F.col("can_probe"), F.col("found") >= F.col("room"))
    return c.select("id", "room", state.alias("w")).select("id", "room", "w.total", "w.has_more")


@query("page_slice", _HYBRID_SQL + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id, chunk_index) AS rn FROM final) SELECT document_id, chunk_index, score, rn FROM r WHERE rn > 8 AND rn <= 16")
def page_slice(t: Tables) -> DataFrame:
    return S.ranked(_hybrid(t), F.desc("score"), F.col("document_id"), F.col("chunk_index")).where("rank > 8 and rank <= 16").select("document_id", "chunk_index", "score", F.col("rank").alias("rn"))


_SNAPSHOT_SQL = ", snapshot AS (SELECT * FROM final ORDER BY score DESC, document_id, chunk_index LIMIT 40)"


@query("rerank_apply", _HYBRID_SQL + _SNAPSHOT_SQL + ", s AS (SELECT document_id, chunk_index, round((document_id % 17) / 17.0::DOUBLE, 6) AS rerank_score FROM snapshot WHERE document_id % 3 = 0) SELECT document_id, chunk_index, score, rerank_score FROM final LEFT JOIN s USING (document_id, chunk_index) ORDER BY rerank_score DESC NULLS LAST, score DESC, document_id, chunk_index LIMIT 12")
def rerank_apply(t: Tables) -> DataFrame:
    hits = _hybrid(t)
    scores = S.rerank_snapshot(hits).where("document_id % 3 = 0").select("document_id", "chunk_index", F.round(F.col("document_id") % 17 / 17.0, 6).alias("rerank_score"))
    return S.apply_rerank(hits, scores, 12).select("document_id", "chunk_index", "score", "rerank_score")


_TERMS_SQL = "[" + ", ".join(f"'{x}'" for x in sorted(set(X.query_terms(PHRASE)))) + "]"


@query("rerank_overlap", _HYBRID_SQL + _SNAPSHOT_SQL + rf""", s AS (SELECT document_id, chunk_index, round(len(list_filter({_TERMS_SQL}, lambda x: list_contains(string_split_regex(lower(chunk_text), '[\s[:punct:]]+'), x))) / len({_TERMS_SQL})::DOUBLE, 6) AS rerank_score
FROM snapshot) SELECT document_id, chunk_index, score, rerank_score FROM final LEFT JOIN s USING (document_id, chunk_index) ORDER BY rerank_score DESC NULLS LAST, score DESC, document_id, chunk_index LIMIT 60""")
def rerank_overlap(t: Tables) -> DataFrame:
    hits = _hybrid(t)
    return S.apply_rerank(hits, S.overlap_scores(S.rerank_snapshot(hits), PHRASE), 60).select("document_id", "chunk_index", "score", "rerank_score")


@query("rrf_fusion", f"""WITH {CHUNKS_SQL}, {_SCORE_SQL},
kw AS (SELECT document_id AS id, row_number() OVER (ORDER BY max(keyword_score) DESC, document_id) AS rank FROM hits GROUP BY document_id ORDER BY rank LIMIT 50),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_COSINE_SQL.removesuffix(' AS vector_score')} DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM v) GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def rrf_fusion(t: Tables) -> DataFrame:
    kw = S.keyword_search(searchable_chunks(t, PHRASE), PHRASE, None).groupBy(F.col("document_id").alias("id")).agg(F.max("keyword_score").alias("s")).orderBy(F.desc("s"), "id").limit(50)
    vec = S.knn(t.embeddings, _target(t), 50).withColumnRenamed("vec_id", "id")
    return S.reciprocal_rank_fusion(S.ranked(kw, F.desc("s"), F.col("id")), S.ranked(vec, F.desc("vector_score"), F.col("id")), "id", 20)


@query("code_lexical", f"""WITH {CHUNKS_SQL}, c AS (SELECT concat(source, '/', document_id, '.', lang) AS path, lang, source, chunk_index, lower(chunk_text) AS body FROM chunks),
s AS (SELECT path, chunk_index, round((CASE WHEN path = 'the and' THEN 1.20 WHEN contains(path, 'the and') THEN 0.90 ELSE 0 END)::DOUBLE + contains(body, 'the and')::INT * 0.82 + (contains(body, 'the') AND contains(body, 'and'))::INT * 0.30, 6)::DOUBLE AS score
  FROM c WHERE starts_with(path, 'src1') AND lang = 'en' AND source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) % 2 = 0 OR min(doc_id) < 15) AND (contains(path, 'the and') OR contains(body, 'the and') OR (contains(body, 'the') AND contains(body, 'and'))))
SELECT * FROM s ORDER BY score DESC, path, chunk_index LIMIT 20""")
def code_lexical(t: Tables) -> DataFrame:
    docs = t.documents.where((F.col("lang") == "en") & F.col("source").startswith("src1"))  # the path begins with the source
    active = t.documents.groupBy(F.col("source").alias("generation")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n % 2 = 0 or first < 15")
    c = chunks_of(docs).select(
        F.col("source").alias("generation"), F.concat("source", F.lit("/"), F.col("document_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("lang").alias("language"), "chunk_index", "chunk_text"
    )
    return S.code_search(c, active, PHRASE, 20, "src1", "en").select("path", "chunk_index", "score")


@query("rerank_text", rf"SELECT doc_id, concat('Title: ', {LINES_SQL}[1], chr(10), 'Source: ', source, chr(10), array_to_string({LINES_SQL}, chr(10))) AS rerank_text FROM documents")
def rerank_text(t: Tables) -> DataFrame:
    lines = X.normalized_lines(F.col("text"))
    return t.documents.select("doc_id", F.concat(F.lit("Title: "), F.element_at(lines, 1), F.lit("\nSource: "), "source", F.lit("\n"), F.array_join(lines, "\n")).alias("rerank_text"))


@query("date_search", "SELECT event_id AS id, ts FROM events WHERE ts <= (SELECT max(ts) FROM events WHERE event_type = 'error') AND event_type IN ('error', 'click') ORDER BY ts DESC, event_id LIMIT 50")
def date_search(t: Tables) -> DataFrame:
    ceiling = t.events.where("event_type = 'error'").agg(F.max("ts")).first()[0]
    rows = t.events.where(F.col("event_type").isin("error", "click")).select(F.col("event_id").alias("id"), "ts")
    return S.date_page(rows, 50, ceiling=F.lit(ceiling))


_WALK_SQL = "SELECT event_id AS id, ts, user_id FROM events WHERE user_id % 7 = 3 AND ts <= (SELECT max(ts) FROM events WHERE event_type = 'error') ORDER BY ts DESC, event_id LIMIT 60"


@query("date_walk", _WALK_SQL)
def date_walk(t: Tables) -> DataFrame:
    """Sixty rows that a filter behind the order keeps, as two pages: the second goes on where the first ended."""
    ceiling = F.lit(t.events.where("event_type = 'error'").agg(F.max("ts")).first()[0])
    rows, keep = t.events.select(F.col("event_id").alias("id"), "ts", "user_id"), F.col("user_id") % 7 == 3
    first, after = S.date_walk(rows, keep, 25, ceiling=ceiling, window_rows=128)
    second, _ = S.date_walk(rows, keep, 35, after, ceiling, window_rows=128)
    return first.unionByName(second)


@query("date_ceiling", "SELECT event_type, max(ts) AS ceiling FROM events GROUP BY 1")
def date_ceiling(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.max("ts").alias("ceiling"))


@query("semantic_only", f"WITH b AS (SELECT vec_id, {_COSINE_SQL} FROM embeddings ORDER BY vector_score DESC, vec_id LIMIT 20) SELECT vec_id, vector_score, n_chars FROM b JOIN documents ON doc_id = vec_id")
def semantic_only(t: Tables) -> DataFrame:
    best = S.knn(t.embeddings, _target(t), 20).select("vec_id", "vector_score")
    return best.join(t.documents.select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")


@query("hydrate_join", "SELECT d.doc_id, d.source, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.label < 5")
def hydrate_join(t: Tables) -> DataFrame:
    return t.documents.join(t.embeddings.where("label < 5"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "source", "label")


@query("upsert_last_wins", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def upsert_last_wins(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("retry_backoff", "SELECT DISTINCT l_linenumber AS attempt, least(300, (5 * pow(2, l_linenumber - 1))::BIGINT) AS seconds FROM lineitem")
def retry_backoff(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linenumber").alias("attempt")).distinct().withColumn("seconds", X.retry_seconds(F.col("attempt")))


@query("same_language", "SELECT a.lang AS a, b.lang AS b, lower(split_part(a.lang, '-', 1)) = lower(split_part(b.lang, '-', 1)) AS same FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT concat(upper(lang), '-XX') AS lang FROM documents) b")
def same_language(t: Tables) -> DataFrame:
    langs = t.documents.select("lang").distinct()
    other = langs.select(F.concat(F.upper("lang"), F.lit("-XX")).alias("b"))
    tag = lambda c: F.lower(F.split_part(c, F.lit("-"), F.lit(1)))
    return langs.select(F.col("lang").alias("a")).crossJoin(other).withColumn("same", tag(F.col("a")) == tag(F.col("b")))


@query("topn_per_group", "SELECT l_partkey, l_returnflag, l_linenumber, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_linenumber, l_orderkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn <= 3")
def topn_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy("l_returnflag", "l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_partkey", "l_returnflag", "l_linenumber", "l_orderkey")


# whole requests

_PAGE = 8
_FILTERED = R.Filters(published_after="2024-02-01", published_before="2024-11-30", metadata=(M.MetadataFilter("size", "range", min=100),))


def _request(cursor: str | None = None, filters: R.Filters = R.Filters()) -> R.SearchRequest:
    return R.SearchRequest(PHRASE, _PAGE, cursor=cursor, filters=filters)


def _shown(page: R.SearchPage) -> DataFrame:
    more = F.lit(page.has_more).alias("has_more")
    return page.items.select("rank", "document_id", "chunk_index", "content_locale", "score", "match_reason", more, F.lit(page.total).alias("total"))


def _searched_sql(rank_from: int, rank_to: int) -> str:
    return _HYBRID_SQL + f""", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id, chunk_index) AS rank, (SELECT count(*) FROM final) AS n FROM final)
SELECT rank, document_id, chunk_index, content_locale, score, match_reason, least(n, {rank_to + 1}) > {rank_to} AS has_more, least(n, {rank_to + 1}) AS total FROM r WHERE rank > {rank_from} AND rank <= {rank_to}"""


@query("search_page", _searched_sql(0, _PAGE))
def search_page(t: Tables) -> DataFrame:
    """The first page of a composed search."""
    return _shown(R.search(corpus(t), _request(), embed=lambda phrase: _target(t)))


@query("search_next_page", _searched_sql(_PAGE, 2 * _PAGE))
def search_next_page(t: Tables) -> DataFrame:
    """The second page, by the first one's cursor, over the same candidates."""
    c, embed = corpus(t), lambda phrase: _target(t)
    first = R.search(c, _request(), embed=embed)
    return _shown(R.search(c, _request(first.next_cursor), embed=embed, candidates=first.candidates))


@query("search_reranked", _HYBRID_SQL + _SNAPSHOT_SQL + rf""", s AS (SELECT document_id, chunk_index, round(len(list_filter({_TERMS_SQL}, lambda x: list_contains(string_split_regex(lower(chunk_text), '[\s[:punct:]]+'), x))) / len({_TERMS_SQL})::DOUBLE, 6) AS rerank_score FROM snapshot),
r AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC NULLS LAST, score DESC, document_id, chunk_index) AS rank FROM final LEFT JOIN s USING (document_id, chunk_index))
SELECT rank, document_id, chunk_index, score, rerank_score FROM r WHERE rank <= {_PAGE}""")
def search_reranked(t: Tables) -> DataFrame:
    """The second stage of a streamed search: the same candidates, reranked."""
    *_, (stage, page) = R.search_stream(corpus(t), _request(), embed=lambda phrase: _target(t), reranker=lambda hits: S.overlap_scores(hits, PHRASE))
    return page.items.where(F.lit(stage == "reranked")).select("rank", "document_id", "chunk_index", "score", "rerank_score")


@query("search_filtered", f"""WITH {CHUNKS_SQL}, {_SCORE_SQL},
passing AS (SELECT doc_id AS document_id FROM documents WHERE doc_id % 366 BETWEEN 31 AND 334 AND n_chars >= 100)
SELECT document_id, chunk_index, arg_min(content_locale, (is_fallback, content_locale)) AS content_locale, max(keyword_score) AS word_score
FROM (SELECT * FROM hits JOIN passing USING (document_id) ORDER BY keyword_score DESC, document_id DESC, chunk_index, content_locale LIMIT 640) GROUP BY 1, 2""")
def search_filtered(t: Tables) -> DataFrame:
    """The words' channel under all kinds of filters, as the fallback of a search without vectors takes it."""
    c = corpus(t)
    request = _request(filters=_FILTERED)
    found = R.collect_candidates(c, request, R.SearchSettings(), None, None, S.candidate_window(_PAGE, filtered=True)[0])
    words = found.rows.where("keyword_score is not null").select("document_id", "chunk_index", "content_locale", F.col("keyword_score").alias("word_score"))
    return words


# structured document queries

_QUERY = R.DocumentQuery(R.Filters(published_after="2024-03-01", metadata=(M.MetadataFilter("size", "range", min=200), M.MetadataFilter("lang", "in", ["en", "fr"]))), (R.SortKey("size", True, True), R.SortKey("published_at")), 20)
_QUERY_SQL = """WITH r AS (SELECT doc_id AS document_id, n_chars AS size, row_number() OVER (ORDER BY n_chars DESC, doc_id % 366, doc_id) AS place FROM documents
  WHERE doc_id % 366 >= 60 AND n_chars >= 200 AND lang IN ('en', 'fr')) """


def _documents_page(t: Tables, query_: R.DocumentQuery) -> R.DocumentPage:
    c = corpus(t)
    return R.query_documents(c.documents, query_, c.definitions)


def _listed(page: R.DocumentPage) -> DataFrame:
    return page.items.select("document_id", F.get_json_object("metadata_json", "$.size").cast("long").alias("size"), "place", F.lit(page.has_more).alias("has_more"))


@query("documents_page", _QUERY_SQL + "SELECT document_id, size, place, (SELECT count(*) FROM r) > 20 AS has_more FROM r WHERE place <= 20")
def documents_page(t: Tables) -> DataFrame:
    """The first page of documents by typed filters and sort keys."""
    return _listed(_documents_page(t, _QUERY))


@query("documents_next_page", _QUERY_SQL + "SELECT document_id, size, place - 20 AS place, (SELECT count(*) FROM r) > 40 AS has_more FROM r WHERE place > 20 AND place <= 40")
def documents_next_page(t: Tables) -> DataFrame:
    """The second page, by the first one's cursor."""
    return _listed(_documents_page(t, replace(_QUERY, cursor=_documents_page(t, _QUERY).next_cursor)))
