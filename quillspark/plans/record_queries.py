"""Access, validity, replacement, audits and converted documents, over the driver's tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.signatures import hmac_sha256, signed
from quillspark.functions.text import normalize_body, normalized_lines
from quillspark.operators import access as A, documents as X, images as I, search as S, snapshots as D, trees as G
from quillspark.plans.corpus import CHUNKS_SQL, LINES_SQL, SNAPSHOT_SQL, baseline, chunks, target
from quillspark.plans.registry import Tables, query
from quillspark.plans.relational_queries import _UP_SQL, _edges

# access

_SCOPES = {
    "public": (A.Scope(), "public"),
    "member": (A.Scope(private=(1, 3)), "public OR group_id IN (1, 3)"),
    "path": (A.Scope(private=(1, 3), path="NATION_3"), "(public OR group_id IN (1, 3)) AND full_path = 'NATION_3'"),
    "allowed": (A.Scope(private=(1,), allowed=(0, 1, 2)), "(public OR group_id = 1) AND group_id IN (0, 1, 2)"),
    "none allowed": (A.Scope(private=(1,), allowed=()), "false"),
    "unknown path": (A.Scope(private=(1,), path="nowhere", path_is_known=False), "false"),
}


@query("acl_filter", "WITH r AS (SELECT c_custkey, c_nationkey AS group_id, n_regionkey % 2 = 0 AS public, n_name AS full_path FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey) "
       + " UNION ALL ".join(f"SELECT '{k}' AS scope, c_custkey FROM r WHERE {sql}" for k, (_, sql) in _SCOPES.items()))
def acl_filter(t: Tables) -> DataFrame:
    visibility = F.when(F.col("n_regionkey") % 2 == 0, "public").otherwise("private")
    rows = t.customer.join(t.nation, F.expr("n_nationkey = c_nationkey"), "left").select("c_custkey", F.col("c_nationkey").alias("group_id"), visibility.alias("visibility"), F.col("n_name").alias("full_path"))
    seen = F.array(*[F.when(A.visible(scope), k) for k, (scope, _) in _SCOPES.items()])
    return rows.select(F.explode(F.array_compact(seen)).alias("scope"), "c_custkey")


@query("hidden_state_filter", "SELECT event_id FROM events WHERE CASE event_type WHEN 'click' THEN 'staged' WHEN 'error' THEN 'pending' WHEN 'view' THEN 'ready' END IS DISTINCT FROM 'staged' AND event_type <> 'error'")
def hidden_state_filter(t: Tables) -> DataFrame:
    state = F.expr("CASE event_type WHEN 'click' THEN 'staged' WHEN 'error' THEN 'pending' WHEN 'view' THEN 'ready' END")
    return t.events.where(A.not_hidden(state)).select("event_id")


@query("registry_exclusions", """WITH x AS (SELECT event_id AS id FROM events WHERE event_type = 'error' AND event_id % 3 <> 1 UNION SELECT event_id + 1 FROM events WHERE event_type = 'error' AND event_id % 3 <> 0)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM x)""")
def registry_exclusions(t: Tables) -> DataFrame:
    phase = F.expr("CASE event_id % 3 WHEN 0 THEN 'staging' WHEN 1 THEN 'retiring' ELSE 'other' END")
    kind = F.when(F.col("event_type") == "error", "document").otherwise("file")
    registry = t.events.select(kind.alias("kind"), phase.alias("phase"), F.array("event_id").alias("staged_ids"), F.array(F.col("event_id") + 1).alias("retired_ids"))
    return t.documents.join(A.excluded_ids(registry, "document").withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select("doc_id")


_SOURCE = {
    "key": "c_custkey", "is_enabled": "c_custkey % 9 <> 0", "is_deleting": "c_custkey % 14 = 0", "is_dirty": "c_custkey % 4 = 0", "interval_seconds": "CASE WHEN c_custkey % 3 <> 0 THEN 86400 * 200 END",
    "created_at": "TIMESTAMP '1999-01-01 00:00:00'",
}
_DUE_NOW = "TIMESTAMP '2001-07-01 00:00:30'"


@query("due_sources", f"""WITH last AS (SELECT o_custkey, max(o_orderdate) AS tried_at, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS indexed_at FROM orders GROUP BY 1),
s AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _SOURCE.items())}, tried_at, indexed_at FROM customer LEFT JOIN last ON o_custkey = c_custkey)
SELECT key FROM s WHERE is_enabled AND NOT is_deleting AND (tried_at IS NULL OR tried_at <= {_DUE_NOW} - INTERVAL 60 SECOND)
  AND (is_dirty OR (interval_seconds IS NOT NULL AND greatest(coalesce(indexed_at, created_at), coalesce(tried_at, created_at)) + to_seconds(interval_seconds) <= {_DUE_NOW}))
  AND key NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 70 = 0)""")
def due_sources(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("tried_at"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("indexed_at"))
    sources = t.customer.join(last, "c_custkey", "left").select(*[F.expr(v).alias(k) for k, v in _SOURCE.items()], "tried_at", "indexed_at")
    return A.due_sources(sources, t.orders.where("o_orderkey % 70 = 0").select(F.col("o_custkey").alias("key")), F.expr(_DUE_NOW)).select("key")


@query("snapshot_limits", """WITH b AS (SELECT source, md5(text) AS sha, count(*) AS n, max(n_chars * 900) AS size FROM documents GROUP BY 1, 2),
s AS (SELECT source, sum(n) AS files, count(*) AS blobs, max(size) AS largest, sum(size) AS total FROM b GROUP BY 1)
SELECT source, files, blobs, total, CASE WHEN files > 16384 THEN 'too_many_files' WHEN blobs > 16384 THEN 'too_many_blobs' WHEN largest > 8388608 THEN 'file_too_large' WHEN total > 67108864 THEN 'total_too_large' ELSE 'ok' END AS verdict FROM s""")
def snapshot_limits(t: Tables) -> DataFrame:
    return A.snapshot_verdicts(t.documents.select("source", F.md5("text").alias("sha"), (F.col("n_chars") * 900).alias("bytes")), "source")


@query("safe_path", r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path, md5(url) AS sha FROM pages)
SELECT page_id, path <> '' AND length(path) <= 1024 AND len(string_split(path, '/')) <= 32 AND NOT regexp_matches(path, '[\x00-\x1f\x7f\\]') AND NOT regexp_matches(concat('/', path, '/'), '//|/\.\.?/') AS path_ok,
  length(path) BETWEEN 1 AND 255 AND NOT regexp_matches(path, '[\x00-\x20\x7f~^:?*\[\\]|\.\.|@\{') AND NOT regexp_matches(concat('/', path, '/'), '//|/\.|\.lock/|^/-|\./$|^/@/$') AS ref_ok,
  page_id % 2 = 0 AS sha_ok FROM p""")
def safe_path(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*/", "")
    sha = F.when(F.col("page_id") % 2 == 0, F.sha2("url", 256)).otherwise(F.concat(F.md5("url"), F.lit("G")))
    return t.pages.select("page_id", A.safe_path(path).alias("path_ok"), A.safe_ref(path).alias("ref_ok"), A.safe_sha(sha).alias("sha_ok"))


@query("url_normalize", r"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'http://', 'https://') WHEN 1 THEN replace(replace(url, 'http://', 'https://'), '://', '://user@') ELSE url END AS url FROM pages)
SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), '^[^@]*@', '')) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path,
  nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+[^?#]*/([^/?#]*)', 1), '') AS file_name, url LIKE 'https://%' AND url NOT LIKE '%@%' AS importable FROM u""")
def url_normalize(t: Tables) -> DataFrame:
    secure = F.replace("url", F.lit("http://"), F.lit("https://"))
    url = F.when(F.col("page_id") % 4 == 0, secure).when(F.col("page_id") % 4 == 1, F.replace(secure, F.lit("://"), F.lit("://user@"))).otherwise(F.col("url"))
    rows = t.pages.select("page_id", url.alias("url"))
    return rows.select(
        "page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"),
        A.url_file_name(F.col("url")).alias("file_name"), A.importable_url(F.col("url")).alias("importable"),
    )


_GIVEN_SQL = "CASE WHEN page_id % 5 = 0 THEN concat(' up/', page_id, '.pdf ') WHEN page_id % 5 = 1 THEN ' ' END"
_MEDIA_SQL = "CASE WHEN page_id % 2 = 0 THEN 'application/pdf' ELSE 'text/plain' END"


@query("remote_file_names", rf"""WITH n AS (SELECT page_id, {_MEDIA_SQL} AS media, coalesce(CASE WHEN page_id % 5 = 0 THEN concat('up/', page_id, '.pdf') END,
  CASE WHEN page_id % 3 = 0 THEN concat(page_id, '.txt') WHEN page_id % 7 = 1 THEN '' END, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]*/(?:.*/)?([^/]+)/*$', 1), '')) AS c FROM pages),
m AS (SELECT page_id, media, CASE WHEN regexp_extract(c, '([^/]*)$', 1) NOT IN ('', '.', '..') THEN regexp_extract(c, '([^/]*)$', 1) END AS name FROM n)
SELECT page_id, name, coalesce(CASE WHEN NOT contains(name, '.') OR name LIKE '%.json' THEN CASE WHEN name LIKE '%.json' THEN media = 'text/plain' ELSE true END WHEN name LIKE '%.pdf' THEN media = 'application/pdf'
  WHEN name LIKE '%.txt' OR name LIKE '%.md' THEN media = 'text/plain' ELSE false END, false) AS fits FROM m""")
def remote_file_names(t: Tables) -> DataFrame:
    """Names of downloads by request, header and URL, and whether the media type fits them."""
    header = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('attachment; filename="a\\'), F.col("page_id").cast("string"), F.lit('.txt"; size=3'))).when(F.col("page_id") % 7 == 1, 'inline; filename=""')
    rows = t.pages.select("page_id", A.remote_file_name(F.expr(_GIVEN_SQL), header, F.col("url")).alias("name"), F.expr(_MEDIA_SQL).alias("media"))
    return rows.select("page_id", "name", A.media_fits(F.col("name"), F.col("media")).alias("fits"))


# validity and locales

_TRANSLATIONS_SQL = f"""d AS (SELECT doc_id AS document_id, lang, md5(text) AS record_hash, {LINES_SQL} AS lines FROM documents),
t AS (SELECT document_id, 'en' AS target_locale, CASE WHEN document_id % 3 = 0 THEN md5(record_hash) ELSE record_hash END AS source_record_hash, concat('In English: ', lines[1]) AS title,
  list_transform(lines, lambda x: concat(x, ' (translated)')) AS lines FROM d WHERE lang <> 'en')"""


def _localized(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.documents.select(F.col("doc_id").alias("document_id"), "lang", F.md5("text").alias("record_hash"), normalized_lines(F.col("text")).alias("lines"))
    docs = docs.withColumn("title", F.element_at("lines", 1))
    source = F.when(F.col("document_id") % 3 == 0, F.md5("record_hash")).otherwise(F.col("record_hash"))
    translated = docs.where("lang <> 'en'").select(
        "document_id", F.lit("en").alias("target_locale"), source.alias("source_record_hash"), F.concat(F.lit("In English: "), "title").alias("title"),
        F.transform("lines", lambda x: F.concat(x, F.lit(" (translated)"))).alias("lines"),
    )
    return docs, translated


@query("valid_translation_join", f"WITH {_TRANSLATIONS_SQL} SELECT t.document_id, target_locale FROM t JOIN d ON d.document_id = t.document_id AND d.record_hash = t.source_record_hash")
def valid_translation_join(t: Tables) -> DataFrame:
    docs, translated = _localized(t)
    keys = docs.select("document_id", F.col("record_hash").alias("source_record_hash"))
    return translated.join(keys, ["document_id", "source_record_hash"], "left_semi").select("document_id", "target_locale")


@query("localized_read", f"""WITH {_TRANSLATIONS_SQL}
SELECT d.document_id, CASE WHEN t.lines IS NULL THEN 'original' ELSE 'en' END AS content_locale, t.lines IS NULL AS is_fallback, coalesce(t.title, d.lines[1]) AS title,
  len(coalesce(t.lines, d.lines)) AS n_chunks, md5(array_to_string(coalesce(t.lines, d.lines), chr(10))) AS body_md5 FROM d LEFT JOIN t ON d.document_id = t.document_id AND d.record_hash = t.source_record_hash""")
def localized_read(t: Tables) -> DataFrame:
    rows = X.localized(*_localized(t), "en")
    return rows.select("document_id", "content_locale", "is_fallback", "title", F.size("lines").alias("n_chunks"), F.md5(F.array_join("lines", "\n")).alias("body_md5"))


# counters and quotas

@query("sync_outcome", f"""WITH {SNAPSHOT_SQL}, {CHUNKS_SQL}, n AS (SELECT concat(source, '/', document_id, '.', lang) AS path, count(*) AS n FROM chunks GROUP BY 1)
SELECT count(*) AS seen, count(*) FILTER (WHERE b.sha IS DISTINCT FROM t.sha) AS changed, coalesce(sum(n) FILTER (WHERE b.sha IS DISTINCT FROM t.sha), 0)::BIGINT AS n_chunks FROM target t LEFT JOIN base b USING (path) LEFT JOIN n USING (path)""")
def sync_outcome(t: Tables) -> DataFrame:
    _, changes = D.upsert(baseline(t), target(t), ["path"], "sha")
    n = chunks(t).groupBy(F.concat("source", F.lit("/"), F.col("document_id").cast("string"), F.lit("."), "lang").alias("path")).agg(F.count("*").alias("n"))
    rows = changes.select("path", "changed").join(n, "path", "left")
    return rows.agg(F.count("*").alias("seen"), F.count_if("changed").alias("changed"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("n"))), F.lit(0)).alias("n_chunks"))


@query("monthly_usage", """WITH RECURSIVE u AS (SELECT user_id, event_id, value, CASE WHEN user_id % 5 = 0 THEN 'lifetime' ELSE strftime(ts, '%Y-%m') END AS bucket, row_number() OVER (PARTITION BY user_id, CASE WHEN user_id % 5 = 0 THEN 'lifetime' ELSE strftime(ts, '%Y-%m') END ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, bucket, k, event_id, true AS accepted, value AS total FROM u WHERE k = 1
  UNION ALL SELECT u.user_id, u.bucket, u.k, u.event_id, r.total + u.value <= 900, CASE WHEN r.total + u.value <= 900 THEN r.total + u.value ELSE r.total END FROM r JOIN u ON u.user_id = r.user_id AND u.bucket = r.bucket AND u.k = r.k + 1)
SELECT user_id, bucket, event_id, accepted FROM r""")
def monthly_usage(t: Tables) -> DataFrame:
    usage = t.events.select("user_id", "ts", "event_id", "value")
    return D.within_quota(usage, 900.0, "user_id", "ts", "value", "event_id", F.col("user_id") % 5 == 0).select("user_id", "bucket", "event_id", "accepted")


@query("rerank_cache_merge", """WITH w AS (SELECT doc_id % 50 AS request, doc_id AS id FROM labels), hot AS (SELECT doc_id AS id, quality AS score FROM labels WHERE doc_id % 2 = 0), old AS (SELECT doc_id AS id, toxic AS score FROM labels WHERE doc_id % 50 % 7 <> 3),
s AS (SELECT request, w.id, coalesce(hot.score, old.score) AS score FROM w LEFT JOIN hot USING (id) LEFT JOIN old USING (id)) SELECT * FROM s WHERE request NOT IN (SELECT request FROM s WHERE score IS NULL)""")
def rerank_cache_merge(t: Tables) -> DataFrame:
    wanted = t.labels.select((F.col("doc_id") % 50).alias("request"), F.col("doc_id").alias("id"))
    hot = t.labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("quality").alias("score"))
    return S.cached_scores(wanted, hot, t.labels.where("doc_id % 50 % 7 <> 3").select(F.col("doc_id").alias("id"), F.col("toxic").alias("score")))


# replacement and deletion

@query("chunk_replace", """WITH old AS (SELECT l_orderkey AS document_id, l_partkey AS id, l_quantity AS body FROM lineitem WHERE l_linenumber < 3), old1 AS (SELECT id, arg_min(document_id, (document_id, body)) AS document_id, arg_min(body, (document_id, body)) AS body FROM old GROUP BY 1),
fresh AS (SELECT l_orderkey AS document_id, l_partkey AS id, l_quantity AS body FROM lineitem WHERE l_linenumber > 4 AND l_orderkey % 4 = 0), kept AS (SELECT id, document_id, body FROM old1 WHERE document_id NOT IN (SELECT document_id FROM fresh)),
one AS (SELECT id, arg_min(document_id, (document_id, body)) AS document_id, arg_min(body, (document_id, body)) AS body FROM fresh GROUP BY 1)
SELECT * FROM kept UNION ALL SELECT * FROM one WHERE id NOT IN (SELECT id FROM kept)""")
def chunk_replace(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("body"), "l_linenumber")
    old = D.latest(rows.where("l_linenumber < 3").drop("l_linenumber"), ["id"], F.col("document_id"), F.col("body"))
    return D.replace_owned(old, rows.where("l_linenumber > 4 and document_id % 4 = 0").drop("l_linenumber"), "document_id", ["id"]).select("id", "document_id", "body")


@query("vector_replace", """WITH fresh AS (SELECT vec_id + 1 AS vec_id, label, embedding FROM embeddings WHERE label % 3 = 0)
SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM (SELECT vec_id, label, embedding FROM embeddings WHERE label % 3 <> 0 UNION ALL SELECT * FROM fresh WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 3 <> 0))""")
def vector_replace(t: Tables) -> DataFrame:
    fresh = t.embeddings.where("label % 3 = 0").select((F.col("vec_id") + 1).alias("vec_id"), "label", "embedding")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4)
    return D.replace_owned(t.embeddings.select("vec_id", "label", "embedding"), fresh, "label", ["vec_id"]).select("vec_id", "label", total.alias("total"))


@query("count_points", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY 1")
def count_points(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 3 <> 0").groupBy("label").agg(F.count("*").alias("n"))


@query("tombstone_anti", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def tombstone_anti(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey")


@query("pending_purges", """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND (o_custkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1999-12-31')
ORDER BY CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END NULLS FIRST, o_orderdate, o_orderkey LIMIT 200""")
def pending_purges(t: Tables) -> DataFrame:
    tombstones = t.orders.selectExpr("o_orderkey AS id", "o_orderdate AS deleted_at", "CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END AS tried_at", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS purged_at")
    return D.pending_purges(tombstones, F.expr("TIMESTAMP '2000-01-01'"), "1 day", 200).select("id")


@query("capped_digest", "SELECT doc_id, strlen(text) AS size, strlen(text) <= 4000 AS fits, CASE WHEN strlen(text) <= 4000 THEN sha256(text) END AS sha256 FROM documents")
def capped_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", D.capped_digest(F.encode("text", "UTF-8"), 4000).alias("d")).select("doc_id", "d.size", "d.fits", "d.sha256")


# audits

_AUDIT_SQL = f"""docs AS (SELECT DISTINCT conv_id FROM conversations), parts AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN ' - ' ELSE text END AS text FROM conversations WHERE conv_id % 5 <> 1 AND NOT (conv_id % 5 = 2 AND turn = 0)),
whole AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d, min(turn) AS a, max(turn) AS b, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM parts GROUP BY 1),
bodies AS (SELECT conv_id, n, d, a, b, array_to_string({LINES_SQL}, chr(10) || chr(10)) AS body FROM whole)"""


@query("version_audit", f"""WITH {_AUDIT_SQL} SELECT conv_id AS document_id, CASE WHEN n IS NULL THEN 'zero_chunks' WHEN a <> 0 OR b <> n - 1 OR d <> n THEN 'non_contiguous_or_duplicate' WHEN body = '' THEN 'blank_body' WHEN conv_id % 11 = 0 THEN 'hash_mismatch' ELSE 'eligible' END AS verdict
FROM docs LEFT JOIN bodies USING (conv_id)""")
def version_audit(t: Tables) -> DataFrame:
    text = F.when(F.col("conv_id") % 7 == 0, " - ").otherwise(F.col("text"))
    parts = t.conversations.where("conv_id % 5 <> 1 and not (conv_id % 5 = 2 and turn = 0)").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), text.alias("chunk_text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n")
    stored = t.conversations.groupBy(F.col("conv_id").alias("document_id")).agg(whole.alias("raw"))
    stored = stored.select("document_id", F.when(F.col("document_id") % 11 == 0, "old").otherwise(F.sha2(normalize_body(F.col("raw")), 256)).alias("record_hash"))
    return D.audit_documents(stored, parts, lambda body: F.sha2(body, 256))


@query("reassemble_segments", """WITH s AS (SELECT conv_id AS id, role = 'user' AS translatable, role = 'user' AND conv_id % 9 = 4 AND turn = 2 AS missing, printf('body:%06d', turn) AS segment_id, text FROM conversations)
SELECT id, CASE WHEN NOT bool_or(missing) THEN string_agg(CASE WHEN translatable THEN '[' || text || ']' ELSE text END || chr(10), '' ORDER BY segment_id) END AS body, min(segment_id) FILTER (WHERE missing) AS first_missing FROM s GROUP BY 1""")
def reassemble_segments(t: Tables) -> DataFrame:
    segments = t.conversations.select(
        F.col("conv_id").alias("id"), F.format_string("body:%06d", "turn").alias("segment_id"), "text", F.lit("\n").alias("suffix"), (F.col("role") == "user").alias("translatable"), "turn"
    )
    translated = segments.where("translatable and not (id % 9 = 4 and turn = 2)").select("id", "segment_id", F.concat(F.lit("["), "text", F.lit("]")).alias("translation"))
    return D.reassemble(segments.drop("turn"), translated)


# converted documents and images

_SHEET_SQL = "list(CASE WHEN l_returnflag = 'R' THEN concat('L', l_linenumber, ' | ', l_partkey) ELSE concat('L', l_linenumber, ' | ', l_partkey, ' | ', l_returnflag) END ORDER BY l_linenumber, l_partkey, l_returnflag)"


@query("sheet_sections", f"WITH s AS (SELECT l_orderkey AS doc_id, l_suppkey % 2 AS k, array_to_string({_SHEET_SQL}, chr(10)) AS body FROM lineitem GROUP BY 1, 2) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS ordinal, concat('S', k) AS name, body FROM s")
def sheet_sections(t: Tables) -> DataFrame:
    cell = lambda c: F.struct(c.cast("string").alias("text"))
    flag = F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).otherwise(F.col("l_returnflag"))  # a repeat of the cell before
    row = F.struct("l_linenumber", "l_partkey", "l_returnflag", F.array(cell(F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))), cell(F.col("l_partkey")), cell(flag), cell(F.lit(" "))).alias("cells"))
    tables = t.lineitem.groupBy("l_orderkey", (F.col("l_suppkey") % 2).alias("k")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("grid"))
    sheets = tables.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "grid"))).alias("sheets"))
    ref = lambda i: F.array(F.struct(F.concat(F.lit("#/tables/"), i.cast("string")).alias("$ref")))
    groups = F.transform("sheets", lambda s, i: F.struct(F.concat(F.lit("sheet: S"), s["k"].cast("string")).alias("name"), ref(i).alias("children")))
    doc = F.to_json(F.struct(groups.alias("groups"), F.transform("sheets", lambda s: F.struct(F.struct(s["grid"].alias("grid")).alias("data"))).alias("tables")))
    return X.sheet_sections(sheets.select(F.col("l_orderkey").alias("doc_id"), doc.alias("json")), "doc_id", "json")


_CELL_SQL = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query("converter_body", f"""WITH r AS (SELECT conv_id, turn, text, CASE WHEN {_CELL_SQL} IN ('', role) THEN role ELSE role || ' | ' || {_CELL_SQL} END AS said FROM conversations)
SELECT conv_id, string_agg(said, chr(10) || chr(10) ORDER BY -(turn % 2), turn, text, said) AS body FROM r GROUP BY 1""")
def converter_body(t: Tables) -> DataFrame:
    """Turns as tables (of an empty and of a repeated cell), those of odd number in the group that the body names first; texts are no part of it."""
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") % 2).alias("odd"), "turn", "text", "role"))).alias("s"))
    ref = lambda kind, i: F.struct(F.concat(F.lit(f"#/{kind}/"), i.cast("string")).alias("$ref"))
    cell = lambda x: F.struct(x.alias("text"))
    tables = F.transform("s", lambda x: F.struct(F.struct(F.array(F.array(cell(x["role"]), cell(F.lit(" ")), cell(x["role"]), cell(x["text"]))).alias("grid")).alias("data")))
    own = lambda odd: F.transform(F.filter(F.transform("s", lambda x, i: F.struct(x["odd"].alias("odd"), ref("tables", i).alias("ref"))), lambda p: p["odd"] == odd), lambda p: p["ref"])
    group = lambda odd: F.struct(F.concat(own(odd), F.array(ref("pictures", F.lit(0)))).alias("children"))
    children = F.array(ref("groups", F.lit(1)), ref("texts", F.lit(0)), ref("groups", F.lit(0)), ref("groups", F.lit(7)))
    doc = F.to_json(F.struct(F.struct(children.alias("children")).alias("body"), F.array(group(0), group(1)).alias("groups"), tables.alias("tables"), F.array(cell(F.lit("no part"))).alias("texts")))
    return rows.select("conv_id", X.body_text(doc).alias("body"))


_IMAGE_SQL = {
    0: ("89504E470D0A1A0A", "\x00\x00\x00\x00acTL\x00\x00\x00\x00    IDAT"), 1: ("89504E470D0A1A0A", "\x00\x00\x00\x00IDAT\x00\x00\x00\x00    acTL"), 2: ("FFD8FFE0", "JFIF acTL"), 3: ("52494646000000005745425056503858", "    \x02 data"), 4: ("5249464600000000574542505650384C", "    \x02 data"), 5: ("", "acTL"),
}


@query("image_kind_sniff", """SELECT p_partkey, CASE WHEN p_partkey % 6 < 2 THEN 'png' WHEN p_partkey % 6 = 2 THEN 'jpeg' WHEN p_partkey % 6 < 5 THEN 'webp' END AS kind, p_partkey % 6 IN (0, 3) AS animated FROM part""")
def image_kind_sniff(t: Tables) -> DataFrame:
    image = F.lit(None).cast("binary")
    for k, (head, rest) in _IMAGE_SQL.items():
        image = F.when(F.col("p_partkey") % 6 == k, F.unhex(F.lit(head + rest.encode().hex()))).otherwise(image)
    rows = t.part.select("p_partkey", image.alias("content"), F.lit("x").alias("name"), F.lit("").alias("media"))
    return I.image_verdicts(rows, "p_partkey", "content", "name", "media").select("p_partkey", "kind", "animated")


#: A PNG of a size by the part, with a text chunk that says acTL, and for some an animation chunk, a cut after 20 bytes, another name or media type.
_SIDE_SQL = "CASE WHEN p_partkey % 10 = 3 THEN 9000 WHEN p_partkey % 10 = 4 THEN 8000 WHEN p_partkey % 10 = 5 THEN 0 ELSE p_size END"


@query("image_verdicts", f"""SELECT p_partkey, CASE WHEN p_partkey % 10 <> 9 THEN 'png' END AS kind, CASE WHEN p_partkey % 10 NOT IN (2, 9) THEN ({_SIDE_SQL})::BIGINT END AS width, p_partkey % 10 = 1 AS animated,
CASE p_partkey % 10 WHEN 0 THEN 'ok' WHEN 1 THEN 'animated' WHEN 2 THEN 'bad_header' WHEN 3 THEN 'too_wide' WHEN 4 THEN 'too_many_pixels' WHEN 5 THEN 'no_pixels' WHEN 6 THEN 'disagree' WHEN 7 THEN 'unsupported' WHEN 8 THEN 'other_kind' ELSE 'no_image' END AS verdict FROM part""")
def image_verdicts(t: Tables) -> DataFrame:
    k, side = F.col("p_partkey") % 10, F.expr(_SIDE_SQL)
    chunk = lambda name, body, n: F.concat(F.lit(f"{n:08x}{name.encode().hex()}"), body, F.lit("00000000"))
    number = F.lpad(F.lower(F.hex(side.cast("long"))), 8, "0")
    whole = F.concat(
        F.lit("89504e470d0a1a0a"), chunk("IHDR", F.concat(number, number, F.lit("0806000000")), 13), chunk("tEXt", F.lit(b"acTL".hex()), 4),
        F.when(k == 1, chunk("acTL", F.lit("00" * 8), 8)).otherwise(""), chunk("IDAT", F.lit(""), 0),
    )
    content = F.unhex(F.when(k == 2, F.substring(whole, 1, 40)).when(k == 9, F.lit(b"plain text".hex())).otherwise(whole))
    rows = t.part.select(
        "p_partkey", content.alias("content"), F.when(k == 6, "a.jpg").when(k == 7, "a.gif").when(k == 8, "a.webp").otherwise("a.PNG").alias("name"), F.when(k == 8, "").when(k == 7, "").otherwise("image/png").alias("media")
    )
    return I.image_verdicts(rows, "p_partkey", "content", "name", "media").select("p_partkey", "kind", "width", "animated", "verdict")


_SECRET = b"a key of the hook that is longer than one block of the hash, which is sixty-four bytes"


@query("webhook_signed", f"""WITH h AS (SELECT event_id, sha256(unhex('{bytes(b ^ 0x5C for b in hashlib.sha256(_SECRET).digest().ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in hashlib.sha256(_SECRET).digest().ljust(64, bytes(1))).hex()}') || encode(props)))) AS mac FROM events)
SELECT event_id, mac, event_id % 5 IN (0, 1) AS valid FROM h""")
def webhook_signed(t: Tables) -> DataFrame:
    """Events as bodies of a hook: rightly signed by either header, by both but one of them wrong, cut short, or not at all."""
    mac = hmac_sha256(F.col("props"), _SECRET)
    k = F.col("event_id") % 5
    raw = F.when(k.isin(0, 2), F.upper(mac)).when(k == 3, F.substring(mac, 1, 63))
    hub = F.when(k.isin(0, 1), F.concat(F.lit("sha256="), mac)).when(k == 2, F.concat(F.lit("sha256="), F.sha2("props", 256)))
    return t.events.select("event_id", mac.alias("mac"), signed(F.col("props"), _SECRET, raw, hub).alias("valid"))


@query("tree_assembly", _UP_SQL + """, f AS (SELECT 'c' || o_custkey AS node, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'F') AS o FROM orders GROUP BY 1)
SELECT e.node, (SELECT max(depth) FROM up WHERE up.node = e.node) AS depth, (SELECT count(*) FROM edges c WHERE c.parent = e.node) AS n_children, coalesce(sum(f.n), 0)::BIGINT AS n_files, coalesce(sum(f.o), 0)::BIGINT AS n_open
FROM edges e JOIN up b ON b.ancestor = e.node LEFT JOIN f ON f.node = b.node GROUP BY e.node""")
def tree_assembly(t: Tables) -> DataFrame:
    files = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), (F.col("o_orderstatus") != "F").alias("is_open"))
    edges = _edges(t)
    return G.assembled(edges, files.join(edges.select("node"), "node", "left_semi"))
