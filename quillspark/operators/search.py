"""Search: keyword scoring, exact vector scan, hybrid fusion, rerank order, rank fusion, date order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.text import query_terms

# The most that keyword channels add up to, the constant of rank fusion, and the sizes of candidate windows.
KEYWORD_CAP = 2.37
RRF_CONSTANT = 60
MOST_CANDIDATES, LEAST_CANDIDATES, FILTER_FACTOR, RERANK_CANDIDATES = 2_000, 80, 8, 40


def candidate_window(requested: int, candidate_limit: int = RERANK_CANDIDATES, filtered: bool = False) -> tuple[int, bool]:
    """How many candidates each channel gives for the first ``requested`` hits, and whether one beyond them can be looked for."""
    can_probe = requested < MOST_CANDIDATES
    fetch = max(requested + 1 if can_probe else requested, LEAST_CANDIDATES, candidate_limit, 1) * (FILTER_FACTOR if filtered else 1)
    return min(fetch, MOST_CANDIDATES), can_probe


def candidate_window_of(requested: Column, candidate_limit: Column, filtered: Column) -> tuple[Column, Column]:
    """The same of columns, for a table of requests."""
    can_probe = requested < MOST_CANDIDATES
    fetch = F.greatest(F.when(can_probe, requested + 1).otherwise(requested), F.lit(LEAST_CANDIDATES), candidate_limit, F.lit(1))
    return F.least(F.lit(MOST_CANDIDATES), fetch * F.when(filtered, FILTER_FACTOR).otherwise(1)), can_probe


def window_state(collected: Column, requested: Column, can_probe: Column, capped: Column) -> Column:
    """Struct of total, a lower bound, and has_more: unknown (null) if nothing could be looked for or a channel gave all it may."""
    more = collected > requested
    total = F.when(more, F.greatest(collected, requested + 1)).otherwise(collected)
    return F.struct(total.alias("total"), F.when(more, True).when(~can_probe | capped, F.lit(None).cast("boolean")).otherwise(False).alias("has_more"))


def may_match(text: Column, phrase: str) -> Column:
    """False only for documents no part of which can match the phrase: every match holds each of its terms."""
    return reduce(lambda a, b: a & b, [F.lower(text).contains(t) for t in query_terms(phrase)], F.lit(True))


def searchable(documents: DataFrame, translations: DataFrame | None, locale: str, phrase: str | None = None) -> DataFrame:
    """Chunks to search for readers of a locale: those of all documents, as fallbacks, and of translations that were made from the document as it is.

    documents: document_id, title, lines, record_hash; translations: document_id, target_locale, title, lines, source_record_hash. With a phrase,
    translated chunks that don't match it are left out before versions are compared, so that no others are moved.
    """
    columns = ["document_id", "title", "content_locale", "is_fallback"]

    def cut(side: DataFrame, *more: str) -> DataFrame:
        # Of an inner explode Spark infers a filter on the size of lines, and makes them once more for it.
        return side.select(*columns, *more, F.posexplode_outer("lines").alias("chunk_index", "chunk_text")).where("chunk_index is not null")

    rows = cut(documents.select("document_id", "title", "lines", F.lit("original").alias("content_locale"), F.lit(True).alias("is_fallback")))
    if translations is not None:
        current = documents.select("document_id", F.col("record_hash").alias("source_record_hash"))
        own = translations.where(F.col("target_locale") == locale).withColumn("content_locale", F.col("target_locale")).withColumn("is_fallback", F.lit(False))
        own = cut(own, "source_record_hash")
        own = own if phrase is None else own.where(matches(phrase))
        rows = rows.unionByName(own.join(current, ["document_id", "source_record_hash"], "left_semi").drop("source_record_hash"))
    return rows


@dataclass(frozen=True)
class FusionWeights:
    """Shares of the channels and, what is left, of the boost: the vector's is between 0 and 1, the keywords' no more than it leaves."""

    vector: float = 0.55
    keyword: float = 0.35

    def __post_init__(self) -> None:
        object.__setattr__(self, "vector", min(max(self.vector, 0.0), 1.0))
        object.__setattr__(self, "keyword", min(max(self.keyword, 0.0), 1.0 - self.vector))

    @property
    def boost(self) -> float:
        return max(0.0, 1 - self.vector - self.keyword)


def _ways(phrase: str) -> tuple[Column, Column, Column, Column]:
    """The title is the phrase, or holds it; the text holds it; both together hold all its terms."""
    low = phrase.strip().lower()
    terms = query_terms(low)
    title, body = F.lower("title"), F.lower("chunk_text")
    like = f"%{low}%"
    all_terms = reduce(lambda a, b: a & b, [F.concat_ws(" ", title, body).contains(t) for t in terms]) if terms else F.lit(False)
    return title == low, title.like(like), body.like(like), all_terms


def matches(phrase: str) -> Column:
    """Whether a chunk is a hit of keyword_search."""
    _, in_title, in_body, all_terms = _ways(phrase)
    return in_title | in_body | all_terms


def keyword_search(chunks: DataFrame, phrase: str, limit: int | None = 20, id_desc: bool = True) -> DataFrame:
    """Phrase or all-terms search over title and chunk_text.

    The phrase is a LIKE pattern, so % and _ in it are wildcards; once it has a term, every hit gets the terms' weight.
    One scan, one top-k: no shuffle but the k best rows of each task.
    """
    exact, in_title, in_body, all_terms = _ways(phrase)
    score = exact.cast("int") * 1.20 + in_title.cast("int") * 1.00 + in_body.cast("int") * 0.82 + F.lit(0.35 if query_terms(phrase) else 0.0)
    reason = F.when(exact, "title_exact").when(in_title, "title_phrase").when(in_body, "chunk_phrase").otherwise("all_terms")
    hits = chunks.where(in_title | in_body | all_terms).withColumn("keyword_score", F.round(score, 6)).withColumn("match_reason", reason)
    if limit is None:
        return hits
    doc = F.col("document_id").desc() if id_desc else F.col("document_id").asc()
    last = ["content_locale"] if "content_locale" in chunks.columns else []
    return hits.orderBy(F.desc("keyword_score"), doc, "chunk_index", *last).limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, target: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k most similar rows by cosine, exactly: the filter reaches the scan, each task keeps its k best."""
    rows = vectors if where is None else vectors.where(where)
    x, norm = F.col("embedding"), sum(float(v) * float(v) for v in target) ** 0.5
    score = F.round(dot(x, F.array(*[F.lit(float(v)) for v in target])) / (F.sqrt(dot(x, x)) * F.lit(norm)), 6)
    return rows.withColumn("vector_score", score).orderBy(F.desc("vector_score"), "vec_id").limit(k)


def image_candidates(limit: int) -> int:
    """How many vectors an image search looks at for ``limit`` images."""
    return min(3 * limit, 200)


def search_images(vectors: DataFrame, active: DataFrame, links: DataFrame, target: list[float], limit: int, parents: int, where: Column, *order: Column) -> DataFrame:
    """(point_id, vector_score, document_id) of the ``limit`` best images and up to ``parents`` documents of each, by ``order`` over links.

    vectors has (vec_id, point_id, embedding); a point counts once, by its best vector. Points that aren't in active (point_id) are
    stale and left out. An image without a document has none (null).
    """
    best = knn(vectors, target, image_candidates(limit), where).groupBy("point_id").agg(F.max("vector_score").alias("vector_score"))
    best = best.join(active.select("point_id"), "point_id", "left_semi").orderBy(F.desc("vector_score"), "point_id").limit(limit)
    own = links.join(F.broadcast(best.select("point_id")), "point_id", "left_semi")  # ``limit`` rows
    own = own.withColumn("_rn", F.row_number().over(Window.partitionBy("point_id").orderBy(*order))).where(F.col("_rn") <= parents).select("point_id", "document_id")
    return best.join(own, "point_id", "left").select("point_id", "vector_score", "document_id")


def valid_vector(v: Column, dimension: int) -> Column:
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def fuse(vector: DataFrame, keyword: DataFrame, phrase: str, weights: FusionWeights = FusionWeights()) -> DataFrame:
    """Full outer merge of both channels by (document_id, chunk_index), with the local score and the reason.

    A translation replaces the fallback to its original, whichever channel it comes from; scores are the channels' largest. The reason
    is "semantic" with the vector channel, "title" or "keyword" by the keyword channel's reason, or both.
    """
    keys = ["document_id", "chunk_index"]

    def channel(df: DataFrame, number: int) -> DataFrame:
        had = lambda c, default: F.col(c) if c in df.columns else default
        return df.select(
            *keys, "title", "chunk_text", had("vector_score", F.lit(None).cast("double")).alias("vector_score"), had("keyword_score", F.lit(None).cast("double")).alias("keyword_score"),
            had("match_reason", F.lit(None).cast("string")).alias("mark"), had("content_locale", F.lit("original")).alias("content_locale"),
            had("is_fallback", F.lit(True)).alias("is_fallback"), F.lit(number).alias("channel"),
        )

    both = channel(vector, 0).unionByName(channel(keyword, 1))
    shown = F.min_by(F.struct("title", "chunk_text", "content_locale", "is_fallback"), F.struct("is_fallback", "channel", "content_locale")).alias("shown")
    mark = F.min_by("mark", F.when(F.col("mark").isNotNull(), F.struct(-F.col("keyword_score"), "content_locale"))).alias("mark")
    merged = both.groupBy(*keys).agg(F.max("vector_score").alias("vector_score"), F.max("keyword_score").alias("keyword_score"), shown, mark)
    merged = merged.select(*keys, "shown.*", "vector_score", "keyword_score", "mark")
    low = phrase.strip().lower()
    title, body = F.lower(F.trim("title")), F.lower("chunk_text")
    tier = F.when(title == low, 1.8).when(title.contains(low), 1.4).when(body.contains(low), 1.0).otherwise(0.0)
    base = F.least(F.greatest(F.coalesce("vector_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * weights.vector
    base += F.least(F.coalesce("keyword_score", F.lit(0.0)), F.lit(KEYWORD_CAP)) / KEYWORD_CAP * weights.keyword
    said = F.concat_ws("+", F.when(F.col("vector_score").isNotNull(), "semantic"), F.when(F.col("mark").isin("title_exact", "title_phrase"), "title").when(F.col("mark").isNotNull(), "keyword"))
    scored = merged.withColumn("score", F.round(base + F.least(tier * weights.boost, 1 - base), 6)).withColumn("match_reason", F.when(said == "", "keyword").otherwise(said))
    return scored.drop("mark")


def rerank_snapshot(hits: DataFrame, most: int = RERANK_CANDIDATES) -> DataFrame:
    """The first hits in local order: what a reranker sees."""
    return hits.orderBy(F.desc("score"), "document_id", "chunk_index").limit(most)


def cached_scores(wanted: DataFrame, hot: DataFrame, persisted: DataFrame) -> DataFrame:
    """(request, id, score): hot scores before persisted ones, only for requests of which every wanted (request, id) has one."""
    both = hot.select("id", "score", F.lit(0).alias("tier")).unionByName(persisted.select("id", "score", F.lit(1).alias("tier")))
    best = both.groupBy("id").agg(F.min_by("score", "tier").alias("score"))
    rows = wanted.join(best, "id", "left")
    lacking = rows.where("score is null").select("request").distinct()
    return rows.join(lacking, "request", "left_anti").select("request", "id", "score")


def code_search(chunks: DataFrame, active: DataFrame, phrase: str, limit: int, prefix: str | None = None, language: str | None = None) -> DataFrame:
    """Chunks (generation, path, language, chunk_index, chunk_text) of active generations with the phrase in their path or text, or all its
    code tokens in their text. Score: path equal 1.20 or containing 0.90, text containing 0.82, all tokens 0.30."""
    from quillspark.functions.text import code_tokens

    low, tokens = phrase.strip().lower(), code_tokens(phrase)
    rows = chunks.join(active, "generation", "left_semi")
    rows = rows if prefix is None else rows.where(F.col("path").startswith(prefix))
    rows = rows if language is None else rows.where(F.col("language") == language)
    path, body = F.lower("path"), F.lower("chunk_text")
    in_path, in_body = path.contains(low), body.contains(low)
    all_tokens = reduce(lambda a, b: a & b, [body.contains(t) for t in tokens]) if tokens else F.lit(False)
    score = F.when(path == low, 1.20).when(in_path, 0.90).otherwise(0.0) + in_body.cast("int") * 0.82 + all_tokens.cast("int") * 0.30
    hits = rows.where(in_path | in_body | all_tokens).withColumn("score", F.round(score, 6))
    return hits.orderBy(F.desc("score"), "path", "chunk_index").limit(limit)


def search_mode(is_configured: bool, is_vectorized: bool, identity: str | None, wanted_identity: str | None, failed: bool = False) -> tuple[str, str | None]:
    """Whether code search goes by vectors or falls back to words, and why."""
    checks = [("not_configured", not is_configured), ("not_vectorized", not is_vectorized), ("identity_mismatch", identity != wanted_identity), ("runtime", failed)]
    reason = next((name for name, wrong in checks if wrong), None)
    return ("lexical" if reason else "semantic", reason)


def overlap_scores(hits: DataFrame, phrase: str) -> DataFrame:
    """A rerank score where no model is at hand: the share of the phrase's distinct terms among the words of chunk_text."""
    terms = sorted(set(query_terms(phrase)))
    words = F.split(F.lower("chunk_text"), r"[\s\p{Punct}]+")
    shared = F.size(F.array_intersect(F.array(*map(F.lit, terms)), words)) if terms else F.lit(0)
    return hits.select("document_id", "chunk_index", F.round(shared / max(1, len(terms)), 6).alias("rerank_score"))


def apply_rerank(hits: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Scored hits first, by rerank score; the rest in local order."""
    joined = hits.join(scores, ["document_id", "chunk_index"], "left")
    return joined.orderBy(F.col("rerank_score").desc_nulls_last(), F.desc("score"), "document_id", "chunk_index").limit(limit)


def reciprocal_rank_fusion(lexical: DataFrame, vector: DataFrame, key: str, limit: int) -> DataFrame:
    """Sum of 1 / (60 + rank) over two ranked lists of (key, rank); ties by key."""
    part = lambda df: df.select(key, (1.0 / (RRF_CONSTANT + F.col("rank"))).alias("part"))
    fused = part(lexical).unionAll(part(vector)).groupBy(key).agg(F.round(F.sum("part"), 8).alias("score"))
    return fused.orderBy(F.desc("score"), key).limit(limit)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Rank of the rows of a bounded top-k list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def date_page(df: DataFrame, limit: int, after: tuple | None = None, ceiling: Column | None = None) -> DataFrame:
    """Newest first by (ts desc, id asc), after a key; rows above the ceiling belong to a later snapshot."""
    rows = df if ceiling is None else df.where(F.col("ts") <= ceiling)
    if after is not None:
        ts, last = after
        rows = rows.where((F.col("ts") < F.lit(ts)) | ((F.col("ts") == F.lit(ts)) & (F.col("id") > last)))
    return rows.orderBy(F.desc("ts"), "id").limit(limit)


def date_walk(df: DataFrame, keep: Column, limit: int, after: tuple | None = None, ceiling: Column | None = None, windows: int = 64, window_rows: int = 4_096) -> tuple[DataFrame, tuple | None]:
    """The next ``limit`` rows for which ``keep`` holds, newest first by (ts desc, id), and the key to go on behind, None at the end. Rows are looked at in windows, each of
    which is complete to its last key; when the windows are used up, the page is what was found so far, and the walk goes on from there."""
    found, parts = 0, []
    for _ in range(windows):
        window = date_page(df, window_rows, after, ceiling).withColumn("_keep", F.coalesce(keep, F.lit(False)))
        seen = window.select("ts", "id", "_keep").collect()  # window_rows keys
        fine = [(r.ts, r.id) for r in seen if r._keep][: limit - found]
        found += len(fine)
        end = fine[-1] if fine and found == limit else (seen[-1].ts, seen[-1].id) if seen else after
        if fine:
            kept = date_page(df, window_rows, after, ceiling).where(F.coalesce(keep, F.lit(False)))
            parts.append(kept.where((F.col("ts") > F.lit(end[0])) | ((F.col("ts") == F.lit(end[0])) & (F.col("id") <= F.lit(end[1])))))
        after = end
        if found == limit or len(seen) < window_rows:
            more = found == limit and not date_page(df, 1, after, ceiling).isEmpty()
            after = after if more else None
            break
    rows = reduce(DataFrame.unionByName, parts) if parts else df.limit(0)
    return rows.orderBy(F.desc("ts"), "id"), after
