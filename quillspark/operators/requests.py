"""Whole requests over a corpus: composed search with pages and cursors, and structured document queries.

``search`` checks a request, filters documents, asks the vector and the keyword channel for the same window, merges and orders them and cuts the
page out. Candidates are bounded (MOST_CANDIDATES for each channel) and written once; a page is a DataFrame over them, and the next page can be given them. A cursor is bound to the
query, the filters, the page size, the settings, the corpus's generation and the order (local or reranked) it was made in; any other is refused.
``search_stream`` gives the page in local order first and then, if a reranker changed the order, the reranked one, from the same candidates.

``query_documents`` finds a page's keys by metadata filters and sort keys first, and only then fetches those documents; it checks the filters again on
what it fetched, and goes on behind the last key until the page is full.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import MEANINGFUL
from quillspark.operators import metadata as M, search as S
from quillspark.session import materialize

LARGEST_PAGE, LARGEST_QUERY_PAGE, MOST_SORT_KEYS, VERSION = 100, 200, 3, 1
ITEM = ("document_id", "chunk_index", "content_locale", "title", "chunk_text", "score", "vector_score", "keyword_score", "match_reason")


@dataclass(frozen=True)
class Filters:
    source: str | None = None
    published_after: datetime | str | None = None
    published_before: datetime | str | None = None
    metadata: tuple[M.MetadataFilter, ...] = ()

    def column(self, definitions: tuple[M.MetadataDef, ...]) -> Column | None:
        """A condition over documents; None if there is none. Bounds are inclusive."""
        parts = []
        if self.source is not None:
            parts.append(F.col("source") == self.source)
        if self.published_after is not None:
            parts.append(F.col("published_at") >= F.lit(self.published_after).cast("timestamp"))
        if self.published_before is not None:
            parts.append(F.col("published_at") <= F.lit(self.published_before).cast("timestamp"))
        if self.metadata:
            parts.append(M.compile_filters(list(self.metadata), list(definitions)))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int = 8
    page: int = 1
    cursor: str | None = None
    locale: str = "en"
    filters: Filters = Filters()


@dataclass(frozen=True)
class SearchSettings:
    hybrid: bool = True
    weights: S.FusionWeights = S.FusionWeights()
    candidate_limit: int = S.RERANK_CANDIDATES


@dataclass(frozen=True)
class Corpus:
    """documents: document_id, title, lines (array<string>), record_hash, source, published_at, metadata_json. translations: document_id, target_locale, title,
    lines, source_record_hash. vectors: vec_id, document_id, chunk_index, embedding; identity names what made them. narrowed, if given, maps a phrase to
    the documents and translations without those that can't match it, told before their lines are made."""

    documents: DataFrame
    translations: DataFrame | None = None
    vectors: DataFrame | None = None
    identity: str | None = None
    definitions: tuple[M.MetadataDef, ...] = ()
    generation: int = 0
    narrowed: Callable[[str], tuple[DataFrame, DataFrame | None]] | None = None


@dataclass
class SearchPage:
    items: DataFrame
    offset: int
    limit: int
    total: int
    has_more: bool | None
    reranked: bool
    next_cursor: str | None
    prev_cursor: str | None
    fallback: str | None = None
    rerank_error: str | None = None
    candidates: Candidates | None = None


def _hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def _context(corpus: Corpus, request: SearchRequest, settings: SearchSettings) -> dict:
    filters = asdict(request.filters) | {"locale": request.locale}
    return {"query": _hash(request.query.strip()), "filters": _hash(filters), "limit": request.limit, "settings": _hash(asdict(settings)), "generation": corpus.generation}


def encode_search_cursor(offset: int, reranked: bool, context: dict) -> str:
    said = {"v": VERSION, "offset": offset, "order": "reranked" if reranked else "local"} | context
    return base64.urlsafe_b64encode(json.dumps(said, sort_keys=True).encode()).decode()


def decode_search_cursor(cursor: str, context: dict) -> tuple[int, str]:
    """Offset and order of a cursor; an unreadable, misaligned or foreign one is refused, and why."""
    try:
        said = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        offset, order, version = said["offset"], said["order"], said["v"]
    except (ValueError, KeyError, TypeError, binascii.Error) as e:
        raise ValueError("the cursor can't be read") from e
    if version != VERSION or not isinstance(offset, int) or offset < 0 or order not in ("local", "reranked"):
        raise ValueError("the cursor can't be read")
    for name, value in context.items():
        if said.get(name) != value:
            raise ValueError(f"the cursor belongs to another search: {name} changed; start again from the first page")
    if offset % context["limit"]:
        raise ValueError("the cursor isn't at the beginning of a page")
    return offset, order


def _offset(request: SearchRequest, context: dict) -> tuple[int, str | None]:
    if not 1 <= request.limit <= LARGEST_PAGE:
        raise ValueError(f"limit must be between 1 and {LARGEST_PAGE}")
    if request.page < 1:
        raise ValueError("page must be 1 or more")
    if not request.query.strip():
        raise ValueError("the query is empty")
    return decode_search_cursor(request.cursor, context) if request.cursor is not None else ((request.page - 1) * request.limit, None)


def _filtered(documents: DataFrame, corpus: Corpus, request: SearchRequest) -> DataFrame:
    where = request.filters.column(corpus.definitions)
    return documents if where is None else documents.where(where)


@dataclass
class Candidates:
    """Both channels' rows, written once; ``made_for`` is the search they belong to."""

    rows: DataFrame
    hybrid: bool
    capped: bool
    fallback: str | None = None
    made_for: tuple | None = None


def _nearest(corpus: Corpus, request: SearchRequest, target: list[float], room: int) -> tuple[DataFrame, int]:
    """The best rows of the vector channel with their texts, and how many there were. Only the best are hydrated."""
    vectors = corpus.vectors
    if request.filters != Filters():
        vectors = vectors.join(_filtered(corpus.documents, corpus, request).select("document_id"), "document_id", "left_semi")
    best = materialize(S.knn(vectors, target, room).select("document_id", "chunk_index", "vector_score"), "nearest")  # room rows
    # The ids reach the scan; behind a join, lines would be made of every document first.
    ids = [r["document_id"] for r in best.select("document_id").distinct().collect()]
    own = corpus.documents.where(F.col("document_id").isin(ids)).join(F.broadcast(best), "document_id").select("document_id", "title", "chunk_index", F.try_element_at("lines", F.col("chunk_index") + 1).alias("chunk_text"), "vector_score")
    return own.where(F.coalesce(F.col("chunk_text").rlike(MEANINGFUL), F.lit(False))), best.count()


def collect_candidates(corpus: Corpus, request: SearchRequest, settings: SearchSettings, embed: Callable[[str], list[float]] | None, wanted_identity: str | None, room: int) -> Candidates:
    """Both channels' rows in the local order's columns. Without usable vectors, words alone are searched, and ``fallback`` says why."""
    target, failed = None, False
    mode, reason = S.search_mode(embed is not None, corpus.vectors is not None, corpus.identity, wanted_identity if wanted_identity is not None else corpus.identity)
    if mode == "semantic":
        try:
            target = embed(request.query)
        except Exception:  # noqa: BLE001  whatever a provider raises
            failed = True
        mode, reason = S.search_mode(True, True, None, None, failed)
    if not settings.hybrid and target is not None:
        near, n = _nearest(corpus, request, target, room)
        rows = near.select("document_id", "chunk_index", F.lit("original").alias("content_locale"), "title", "chunk_text", F.col("vector_score").alias("score"), "vector_score",
                           F.lit(None).cast("double").alias("keyword_score"), F.lit("semantic").alias("match_reason"))
        return Candidates(materialize(rows, "candidates"), False, n >= room)
    documents, translations = corpus.narrowed(request.query) if corpus.narrowed is not None else (corpus.documents, corpus.translations)
    chunks = S.searchable(_filtered(documents, corpus, request), translations, request.locale, request.query)
    words = materialize(S.keyword_search(chunks, request.query, room), "keyword")
    n_words = words.count()
    near, n = _nearest(corpus, request, target, room) if target is not None else (words.limit(0).select("document_id", "chunk_index", "title", "chunk_text", F.lit(0.0).alias("vector_score")), 0)
    fused = S.fuse(near, words, request.query, settings.weights).select(*ITEM)
    return Candidates(materialize(fused, "candidates"), True, n >= room or n_words >= room, reason)


def _page(found: Candidates, ranked: DataFrame, n: int, request: SearchRequest, offset: int, context: dict, reranked: bool, error: str | None = None) -> SearchPage:
    requested = offset + request.limit
    can_probe = requested < S.MOST_CANDIDATES
    collected = min(n, requested + 1 if can_probe else S.MOST_CANDIDATES)
    has_more = True if collected > requested else None if not can_probe or found.capped else False
    items = ranked.where((F.col("rank") > offset) & (F.col("rank") <= requested))
    cursor = lambda at: encode_search_cursor(at, reranked, context)
    return SearchPage(
        items, offset, request.limit, max(collected, requested + 1) if has_more else collected, has_more, reranked,
        cursor(requested) if has_more and requested < S.MOST_CANDIDATES else None, cursor(max(0, offset - request.limit)) if offset else None, found.fallback, error, found,
    )


def _local(rows: DataFrame) -> DataFrame:
    """Bounded candidates in local order, with their rank."""
    return S.ranked(rows, F.desc("score"), F.col("document_id"), F.col("chunk_index"))


def search_stream(
    corpus: Corpus, request: SearchRequest, settings: SearchSettings = SearchSettings(), embed: Callable[[str], list[float]] | None = None,
    reranker: Callable[[DataFrame], DataFrame] | None = None, identity: str | None = None, candidates: Candidates | None = None,
) -> Iterator[tuple[str, SearchPage]]:
    """("local", page), then ("reranked", page) if the reranker gave an order. The reranker maps the snapshot's chunks to (document_id, chunk_index, rerank_score);
    if it fails, the local order stands. A cursor is checked against the order before any page is given. ``candidates`` of an earlier page, found with the same
    ``embed``, are taken if this page has the same search and window."""
    context = _context(corpus, request, settings)
    offset, order = _offset(request, context)
    room, _ = S.candidate_window(offset + request.limit, max(1, settings.candidate_limit), bool(request.filters.metadata))
    made_for = (context, room, identity, corpus.identity, embed is not None)
    if candidates is not None and candidates.made_for == made_for and candidates.fallback is None:
        found = candidates
    else:
        found = collect_candidates(corpus, request, settings, embed, identity, room)
        found.made_for = made_for
    n, scores, error = found.rows.count(), None, None

    def rerank() -> tuple[DataFrame | None, str | None]:
        if reranker is None or not found.hybrid or not n:
            return None, None
        try:
            got = materialize(reranker(S.rerank_snapshot(found.rows, settings.candidate_limit)).select("document_id", "chunk_index", "rerank_score"), "reranked")
            return (got, None) if not got.isEmpty() else (None, None)
        except Exception as e:  # noqa: BLE001  whatever a provider raises
            return None, type(e).__name__

    if order is not None:  # the order must be known before a page of it is given
        scores, error = rerank()
        if (order == "reranked") != (scores is not None):
            raise ValueError(f"the cursor belongs to the {order} order, which this search doesn't have; start again from the first page")
    yield "local", _page(found, _local(found.rows), n, request, offset, context, False, error)
    if order is None:
        scores, error = rerank()
    if scores is not None:
        joined = found.rows.join(scores, ["document_id", "chunk_index"], "left")
        ranked = S.ranked(joined, F.col("rerank_score").desc_nulls_last(), F.desc("score"), F.col("document_id"), F.col("chunk_index"))
        yield "reranked", _page(found, ranked, n, request, offset, context, True)
    elif error is not None:
        yield "failed", _page(found, _local(found.rows), n, request, offset, context, False, error)


def search(
    corpus: Corpus, request: SearchRequest, settings: SearchSettings = SearchSettings(), embed: Callable[[str], list[float]] | None = None,
    reranker: Callable[[DataFrame], DataFrame] | None = None, identity: str | None = None, candidates: Candidates | None = None,
) -> SearchPage:
    """The last page that search_stream gives: reranked if the reranker gave an order, else local."""
    return list(search_stream(corpus, request, settings, embed, reranker, identity, candidates))[-1][1]


@dataclass(frozen=True)
class SortKey:
    """A column of documents, or the path of a declared metadata field."""

    name: str
    descending: bool = False
    metadata: bool = False


@dataclass(frozen=True)
class DocumentQuery:
    filters: Filters = Filters()
    sort: tuple[SortKey, ...] = ()
    limit: int = 50
    cursor: str | None = None


@dataclass
class DocumentPage:
    items: DataFrame
    has_more: bool
    next_cursor: str | None
    n_candidates: int
    n_hydrated: int
    n_dropped: int


SORTABLE = ("document_id", "published_at", "updated_at", "title", "source")


def check_query(query: DocumentQuery, definitions: tuple[M.MetadataDef, ...]) -> None:
    """Limits and definitions, before anything is planned."""
    if not 1 <= query.limit <= LARGEST_QUERY_PAGE:
        raise ValueError(f"limit must be between 1 and {LARGEST_QUERY_PAGE}")
    if len(query.sort) > MOST_SORT_KEYS:
        raise ValueError(f"no more than {MOST_SORT_KEYS} sort keys")
    by_path = {d.path: d for d in definitions}
    for path in [f.path for f in query.filters.metadata] + [k.name for k in query.sort if k.metadata]:
        if path not in by_path:
            raise ValueError(f"{path} isn't declared")
        if by_path[path].state != "ready":
            raise ValueError(f"{path} isn't ready")
    for k in query.sort:
        if k.metadata and not by_path[k.name].sortable:
            raise ValueError(f"{k.name} isn't sortable")
        if not k.metadata and k.name not in SORTABLE:
            raise ValueError(f"{k.name} is no sort key")


def query_documents(
    documents: DataFrame, query: DocumentQuery, definitions: tuple[M.MetadataDef, ...] = (), values: DataFrame | None = None, recheck: Column | None = None,
) -> DocumentPage:
    """A page of documents (document_id, source, published_at, metadata_json and more). ``values`` is an index of metadata, document_id and a column for each ready path
    (dots as in the path), which candidates are found by; without it, they are found by metadata_json itself. What was fetched is checked by
    metadata_json (and ``recheck``) again, so a stale index neither adds rows nor leaves the page short."""
    check_query(query, definitions)
    by_path = {d.path: d for d in definitions}
    request = {"filters": asdict(query.filters), "sort": [asdict(k) for k in query.sort], "limit": query.limit}
    plain = Filters(query.filters.source, query.filters.published_after, query.filters.published_before)
    rows = documents if (where := plain.column(())) is None else documents.where(where)
    if values is None:
        keyed = rows if not query.filters.metadata else rows.where(M.compile_filters(list(query.filters.metadata), list(definitions)))
        typed = {d.path: d.typed() for d in definitions}
    else:
        names = [f"`{d.path}`" for d in definitions if d.state == "ready"]
        own = values.select(F.col("document_id").alias("_document_id"), F.struct(*names).alias("_values"))
        keyed = rows.join(own, F.col("document_id") == F.col("_document_id"), "left")
        typed = {d.path: F.col("_values").getField(d.path) for d in definitions}
        for f in query.filters.metadata:
            keyed = keyed.where(M.compile_typed(f, by_path[f.path], typed[f.path]))
    # Keys alone go through the sort: of every task the page's rows at most.
    keys = [(f"_sort{i}", "desc" if k.descending else "asc") for i, k in enumerate(query.sort)]
    first = lambda d, x: F.try_element_at(x, F.lit(1)) if d.array else x
    keyed = keyed.select("document_id", *[(first(by_path[k.name], typed[k.name]) if k.metadata else F.col(k.name)).alias(f"_sort{i}") for i, k in enumerate(query.sort)])
    after = None
    if query.cursor is not None:
        after = M.decode_cursor(request, query.cursor)
        if len(after[0]) != len(keys):
            raise ValueError("the cursor's sort keys aren't the query's")
    again = F.lit(True) if not query.filters.metadata else M.compile_filters(list(query.filters.metadata), list(definitions))
    again = again if recheck is None else again & F.coalesce(recheck, F.lit(False))
    parts, kept, n_candidates, n_hydrated = [], [], 0, 0
    while True:
        found = M.page(keyed, keys, "document_id", query.limit, after).collect()  # limit + 1 rows of keys
        if not found:
            break
        n_candidates += len(found)
        ids = [r["document_id"] for r in found]
        fetched = materialize(documents.where(F.col("document_id").isin(ids)).withColumn("_fine", again), "hydrated")
        fine = {r["document_id"]: r["_fine"] for r in fetched.select("document_id", "_fine").collect()}
        n_hydrated += len(fine)
        kept += [r for r in found if fine.get(r["document_id"])]
        parts.append(fetched.where("_fine").drop("_fine"))
        if len(kept) > query.limit or len(found) <= query.limit:
            break
        after = ([found[-1][c] for c, _ in keys], found[-1]["document_id"])
    shown = kept[: query.limit]
    spark = documents.sparkSession
    places = spark.createDataFrame([(r["document_id"], i + 1) for i, r in enumerate(shown)], f"document_id {documents.schema['document_id'].dataType.simpleString()}, place int")
    whole = parts[0] if parts else documents.limit(0)
    for p in parts[1:]:
        whole = whole.unionByName(p)
    has_more = len(kept) > query.limit
    cursor = M.encode_cursor(request, [shown[-1][c] for c, _ in keys], shown[-1]["document_id"]) if has_more else None
    return DocumentPage(whole.join(F.broadcast(places), "document_id").orderBy("place"), has_more, cursor, n_candidates, n_hydrated, n_candidates - len(kept))
