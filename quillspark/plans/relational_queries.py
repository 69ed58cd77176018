"""Metadata, joins, aggregates, windows, paging, sets, trees, snapshots and writes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.operators import metadata as M, snapshots as D, trees as G
from quillspark.plans.corpus import CHUNKS_SQL, SNAPSHOT_SQL, baseline, chunks, target
from quillspark.plans.registry import Tables, query

K = M.MetadataDef("k", "integer")


def _md(t: Tables) -> DataFrame:
    return t.events.withColumn("metadata_json", F.col("props"))


def _filtered(name: str, f: M.MetadataFilter, where: str, d: M.MetadataDef = K) -> None:
    @query(name, f"SELECT event_id FROM events WHERE {where}")
    def run(t: Tables) -> DataFrame:
        return _md(t).where(M.compile_filter(f, d)).select("event_id")


_X = "try_cast(props->>'$.k' AS BIGINT)"
_filtered("md_exists", M.MetadataFilter("k", "exists"), "props->>'$.k' IS NOT NULL")
_filtered("md_eq", M.MetadataFilter("k", "eq", 7), f"{_X} = 7")
_filtered("md_in", M.MetadataFilter("k", "in", [1, 5, "9"]), f"{_X} IN (1, 5, 9)")
_filtered("md_range", M.MetadataFilter("k", "range", min=10, max=20), f"{_X} BETWEEN 10 AND 20")


@query("md_contains", "SELECT conv_id FROM (SELECT conv_id, list(role) AS r FROM conversations GROUP BY 1) WHERE list_contains(r, 'assistant')")
def md_contains(t: Tables) -> DataFrame:
    docs = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list("role").alias("roles"))).alias("metadata_json"))
    return docs.where(M.compile_filter(M.MetadataFilter("roles", "contains", "assistant"), M.MetadataDef("roles", "keyword", array=True))).select("conv_id")


@query("md_conjunction", f"SELECT event_id FROM events WHERE {_X} >= 50 AND props->>'$.k' IS NOT NULL AND {_X} IN (50, 60, 70)")
def md_conjunction(t: Tables) -> DataFrame:
    filters = [M.MetadataFilter("k", "range", min=50), M.MetadataFilter("k", "exists", True), M.MetadataFilter("k", "in", [50, 60, 70])]
    return _md(t).where(M.compile_filters(filters, [K])).select("event_id")


@query("md_untyped", "SELECT event_id FROM events WHERE try_cast(props->>'$.k' AS DOUBLE) >= 90")
def md_untyped(t: Tables) -> DataFrame:
    return t.events.where(M.untyped_compare(F.get_json_object("props", "$.k"), "gte", 90)).select("event_id")


@query("metadata_extract", f"SELECT event_id, 'k' AS path, 0 AS ordinal, ({_X})::VARCHAR AS value FROM events WHERE {_X} IS NOT NULL")
def metadata_extract(t: Tables) -> DataFrame:
    return M.extract(_md(t), [K], "event_id")


@query("metadata_merge", "SELECT event_id, props->>'$.k' AS k, event_type AS kind FROM events")
def metadata_merge(t: Tables) -> DataFrame:
    section, own = F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type"))
    merged = F.map_concat(F.map_filter(section, lambda k, v: ~k.isin("kind", "record_hash")), own)
    return t.events.select("event_id", merged["k"].alias("k"), merged["kind"].alias("kind"))


@query("published_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-07'")
def published_range(t: Tables) -> DataFrame:
    return t.events.where("ts >= timestamp'2024-01-05' and ts <= timestamp'2024-01-07'").select("event_id")


@query("locale_filter", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'original') OR lang IS NULL OR lang = ''")
def locale_filter(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang").isin("fr", "original", "") | F.col("lang").isNull()).select("doc_id")


@query("glob_match", "SELECT concat(source, '/', doc_id, '.', lang) AS path FROM documents WHERE regexp_full_match(concat(source, '/', doc_id, '.', lang), 'src1[^/]/.*\\.en')")
def glob_match(t: Tables) -> DataFrame:
    from quillspark.functions.paths import glob_regex

    return t.documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path")).where(F.col("path").rlike(glob_regex("src1?/**.en")))


@query("line_window", f"WITH {CHUNKS_SQL} SELECT document_id, chunk_index FROM chunks WHERE chunk_index + 1 >= 3 AND chunk_index + 1 <= 5")
def line_window(t: Tables) -> DataFrame:
    return chunks(t).where("chunk_index + 1 >= 3 and chunk_index + 1 <= 5").select("document_id", "chunk_index")


# joins

@query("left_sort_join", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 100")
def left_sort_join(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").orderBy(F.col("quality").desc_nulls_last(), "doc_id").select("doc_id", "quality").limit(100)


@query("semi_join", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi_join(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("missing_versions", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_versions(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return D.latest(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("latest_annotations", "SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def latest_annotations(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


# aggregates

@query("count_chunks", f"WITH {CHUNKS_SQL} SELECT count(*) AS n FROM chunks")
def count_chunks(t: Tables) -> DataFrame:
    return chunks(t).agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'running' END"


def _items(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("status", F.expr(_STATUS))


@query("status_rollup", f"SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE {_STATUS} = 'failed') AS n_failed, count(*) FILTER (WHERE {_STATUS} = 'succeeded') AS n_succeeded FROM lineitem GROUP BY 1")
def status_rollup(t: Tables) -> DataFrame:
    return _items(t).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "succeeded").alias("n_succeeded"))


@query("health_rollup", "SELECT count(*) FILTER (WHERE event_type = 'error') AS n_errors, min(ts) FILTER (WHERE event_type = 'error') AS oldest_error, max(ts) AS newest FROM events")
def health_rollup(t: Tables) -> DataFrame:
    return t.events.agg(F.count_if(F.col("event_type") == "error").alias("n_errors"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("oldest_error"), F.max("ts").alias("newest"))


@query("group_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("json_rollup", "SELECT n_regionkey, '[' || string_agg('{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM nation GROUP BY 1")
def json_rollup(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(rows).alias("nations"))


@query("id_sets", "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS ids FROM nation GROUP BY 1")
def id_sets(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")).cast("array<string>"), ",").alias("ids"))


@query("overlap_any", "SELECT c_custkey % 10 AS bucket, bool_or(list_has_any([c_nationkey], [1, 2, 3])) AS hit FROM customer GROUP BY 1")
def overlap_any(t: Tables) -> DataFrame:
    hit = F.arrays_overlap(F.array("c_nationkey"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return t.customer.groupBy((F.col("c_custkey") % 10).alias("bucket")).agg(F.bool_or(hit).alias("hit"))


@query("quota_usage", "SELECT source, max(s) AS largest, sum(s) AS total FROM (SELECT source, lang, sum(n_chars) AS s FROM documents GROUP BY 1, 2) GROUP BY 1")
def quota_usage(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.sum("n_chars").alias("s")).groupBy("source").agg(F.max("s").alias("largest"), F.sum("s").alias("total"))


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def distinct_on(t: Tables) -> DataFrame:
    return D.latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("folder_counts", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation")
def folder_counts(t: Tables) -> DataFrame:
    count = lambda df, key, name: df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name))
    joined = t.nation.join(count(t.customer, "c_nationkey", "n_customers"), "n_nationkey", "left").join(count(t.supplier, "s_nationkey", "n_suppliers"), "n_nationkey", "left")
    return joined.select("n_nationkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_customers", "n_suppliers")])


@query("byte_budget", "SELECT source, sum(strlen(text)) AS bytes, sum(strlen(text)) <= 67108864 AS fits FROM documents GROUP BY 1")
def byte_budget(t: Tables) -> DataFrame:
    total = F.sum(F.octet_length("text"))
    return t.documents.groupBy("source").agg(total.alias("bytes"), (total <= 67108864).alias("fits"))


@query("retention_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders")
def retention_rank(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).alias("rank"))


# order and paging

_SORT = [("quality", "desc"), ("lang", "asc")]


@query("typed_sort", "SELECT doc_id, row_number() OVER (ORDER BY quality DESC NULLS LAST, lang ASC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id) ORDER BY place LIMIT 200")
def typed_sort(t: Tables) -> DataFrame:
    top = t.documents.join(t.labels, "doc_id", "left").orderBy(*M.typed_sort(_SORT, "doc_id")).limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*M.typed_sort(_SORT, "doc_id")))).select("doc_id", "place")


@query("keyset_page", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality < 1 OR quality IS NULL) OR (quality = 1 AND (lang > 'en' OR lang IS NULL)) OR (quality = 1 AND lang = 'en' AND doc_id > 100) ORDER BY quality DESC NULLS LAST, lang ASC NULLS LAST, doc_id LIMIT 51")
def keyset_page(t: Tables) -> DataFrame:
    return M.page(t.documents.join(t.labels, "doc_id", "left"), _SORT, "doc_id", 50, ([1, "en"], 100)).select("doc_id")


@query("keyset_composite", f"WITH {CHUNKS_SQL} SELECT document_id, chunk_index FROM chunks WHERE document_id > 20 OR (document_id = 20 AND chunk_index > 2) ORDER BY 1, 2 LIMIT 100")
def keyset_composite(t: Tables) -> DataFrame:
    behind = M.after_key([("document_id", "asc")], [20], "chunk_index", 2)
    return chunks(t).where(behind).orderBy("document_id", "chunk_index").select("document_id", "chunk_index").limit(100)


@query("has_more_probe", "SELECT count(*) > 100 AS has_more FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'P' LIMIT 101)")
def has_more_probe(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").limit(101).agg((F.count("*") > 100).alias("has_more"))


@query("dynamic_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def dynamic_sort(t: Tables) -> DataFrame:
    allowed = {"name": F.col("c_name"), "balance": F.col("c_acctbal")}
    return t.customer.orderBy(allowed["balance"].desc(), "c_custkey").limit(25).select("c_custkey", "c_name")


@query("offset_page", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def offset_page(t: Tables) -> DataFrame:
    return t.customer.orderBy("c_custkey").offset(40).limit(20).select("c_custkey")


@query("status_order", f"SELECT l_orderkey, l_linenumber, {_STATUS} AS status FROM lineitem ORDER BY CASE {_STATUS} WHEN 'failed' THEN 0 WHEN 'running' THEN 1 ELSE 5 END, l_orderkey, l_linenumber, l_partkey LIMIT 50")
def status_order(t: Tables) -> DataFrame:
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "running", 1).otherwise(5)
    return _items(t).orderBy(rank, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "status").limit(50)


# sets

@query("union_locales", "SELECT doc_id, 'original' AS locale FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def union_locales(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.lit("original").alias("locale")).unionByName(t.documents.where("lang <> 'en'").select("doc_id", F.col("lang").alias("locale")))


@query("id_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def id_except(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").subtract(t.orders.select("o_custkey"))


@query("resource_listing", "SELECT 'folder' AS kind, n_nationkey::BIGINT AS id, n_name AS name, NULL::DOUBLE AS size FROM nation UNION ALL SELECT 'file', s_suppkey, s_name, s_acctbal FROM supplier")
def resource_listing(t: Tables) -> DataFrame:
    folders = t.nation.select(F.lit("folder").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("double").alias("size"))
    return folders.unionByName(t.supplier.select(F.lit("file").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("size")))


@query("batch_lookup_ordered", "SELECT k.ordinal, k.key, d.n_chars FROM (VALUES (0, 5), (1, 999999), (2, 1)) k(ordinal, key) LEFT JOIN documents d ON d.doc_id = k.key")
def batch_lookup_ordered(t: Tables) -> DataFrame:
    keys = t.spark.createDataFrame([(0, 5), (1, 999999), (2, 1)], "ordinal int, key long")  # 200 keys at most
    docs = t.documents.where(F.col("doc_id").isin(5, 999999, 1)).select(F.col("doc_id").alias("key"), "n_chars")
    return F.broadcast(keys).join(docs, "key", "left").orderBy("ordinal").select("ordinal", "key", "n_chars")


@query("arrays_zip_rows", "SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y', 'z']) AS b")
def arrays_zip_rows(t: Tables) -> DataFrame:
    zipped = F.arrays_zip(F.array(*map(F.lit, (1, 2, 3))).alias("a"), F.array(*map(F.lit, "xyz")).alias("b"))
    return t.spark.range(1).select(F.explode(zipped).alias("z")).select("z.a", "z.b")


# trees

_EDGES_SQL = """edges AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""
_UP_SQL = f"WITH RECURSIVE {_EDGES_SQL}, up AS (SELECT node, node AS ancestor, 0 AS depth FROM edges UNION ALL SELECT up.node, e.parent, depth + 1 FROM up JOIN edges e ON e.node = ancestor WHERE e.parent IS NOT NULL)"


def _edges(t: Tables) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region = t.region.select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = t.nation.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return region.unionByName(nation).unionByName(t.customer.select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))


@query("tree_ancestors", _UP_SQL + " SELECT node, ancestor, depth FROM up")
def tree_ancestors(t: Tables) -> DataFrame:
    return G.closure(_edges(t))


@query("tree_descendants", _UP_SQL + " SELECT node FROM up WHERE ancestor = 'r1' AND node <> 'r1'")
def tree_descendants(t: Tables) -> DataFrame:
    return G.descendants(_edges(t), t.spark.createDataFrame([("r1",)], "node string")).where("node <> 'r1'")


@query("tree_path_up", _UP_SQL + " SELECT node, ancestor, depth FROM up WHERE node IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 5000)")
def tree_path_up(t: Tables) -> DataFrame:
    """The ancestors of some nodes alone."""
    rich = t.customer.where("c_acctbal > 5000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return G.ancestors(_edges(t), rich)


@query("tree_paths", f"WITH RECURSIVE {_EDGES_SQL}, down AS (SELECT node, name AS full_path FROM edges WHERE parent IS NULL UNION ALL SELECT e.node, full_path || '/' || e.name FROM down JOIN edges e ON e.parent = down.node) SELECT node, full_path FROM down")
def tree_paths(t: Tables) -> DataFrame:
    return G.paths(_edges(t))


_ROLE_SQL = "SELECT 'n' || n_nationkey AS node, n_nationkey % 3 + 1 AS role FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r1', 3"


def _roles(t: Tables) -> DataFrame:
    own = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), (F.col("n_nationkey") % 3 + 1).alias("role"))
    return own.unionByName(t.spark.createDataFrame([("r1", 3)], "node string, role int"))


@query("tree_roles", _UP_SQL + f" SELECT up.node, max(role) AS role FROM up JOIN ({_ROLE_SQL}) m ON m.node = up.ancestor GROUP BY 1")
def tree_roles(t: Tables) -> DataFrame:
    return G.inherited_maximum(_edges(t), _roles(t), "role")


@query("effective_role", _UP_SQL + f" SELECT role, count(*) AS n FROM (SELECT up.node, max(role) AS role FROM up JOIN ({_ROLE_SQL}) m ON m.node = up.ancestor GROUP BY 1) GROUP BY 1")
def effective_role(t: Tables) -> DataFrame:
    return tree_roles(t).groupBy("role").agg(F.count("*").alias("n"))


@query("eligible_by_role", _UP_SQL + f" SELECT up.node FROM up JOIN ({_ROLE_SQL}) m ON m.node = up.ancestor GROUP BY 1 HAVING max(role) >= 2")
def eligible_by_role(t: Tables) -> DataFrame:
    return tree_roles(t).where("role >= 2").select("node")


@query("accessible_groups", _UP_SQL + f" SELECT DISTINCT e.node, e.name FROM edges e JOIN up ON up.node = e.node JOIN ({_ROLE_SQL}) m ON m.node = up.ancestor WHERE e.name ILIKE '%nation%'")
def accessible_groups(t: Tables) -> DataFrame:
    return _edges(t).where(F.col("name").ilike("%nation%")).join(tree_roles(t), "node", "left_semi").select("node", "name")


# snapshots and writes

@query("snapshot_diff", f"WITH {SNAPSHOT_SQL} SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM base b FULL JOIN target t USING (path) WHERE b.sha IS DISTINCT FROM t.sha")
def snapshot_diff(t: Tables) -> DataFrame:
    return D.compare(baseline(t), target(t)).where("status <> 'unchanged'").select("path", "status")


_PAIRS_SQL = """g AS (SELECT * FROM (VALUES (1, 'ready'), (2, 'superseded'), (3, 'failed')) v(generation, status)),
files AS (SELECT 1 AS generation, path, sha FROM base UNION ALL SELECT 2, path, sha FROM target UNION ALL SELECT 3, path, sha FROM target),
pairs AS (SELECT a.generation AS b, c.generation AS t FROM g a JOIN g c ON a.generation <> c.generation AND a.status IN ('ready', 'superseded') AND c.status IN ('ready', 'superseded')),
keys AS (SELECT DISTINCT b, t, path FROM pairs JOIN files ON generation IN (b, t))"""


@query("snapshot_pairs", f"""WITH {SNAPSHOT_SQL}, {_PAIRS_SQL} SELECT k.b AS base, k.t AS target, k.path, CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
FROM keys k LEFT JOIN files x ON x.generation = k.b AND x.path = k.path LEFT JOIN files y ON y.generation = k.t AND y.path = k.path WHERE x.sha IS DISTINCT FROM y.sha""")
def snapshot_pairs(t: Tables) -> DataFrame:
    """The changes between every two of three generations, one of which failed."""
    of = lambda df, k: df.select(F.lit(k).alias("generation"), "path", "sha")
    files = of(baseline(t), 1).unionByName(of(target(t), 2)).unionByName(of(target(t), 3))
    generations = t.spark.createDataFrame([(1, "ready"), (2, "superseded"), (3, "failed")], "generation int, status string")
    pairs = t.spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b], "base int, target int")
    return D.diffs(files, generations, pairs)


@query("incremental_plan", f"WITH {SNAPSHOT_SQL} SELECT path, CASE WHEN t.path IS NULL THEN 'delete' WHEN b.sha IS NOT DISTINCT FROM t.sha THEN 'seed' ELSE 'fetch' END AS action FROM base b FULL JOIN target t USING (path)")
def incremental_plan(t: Tables) -> DataFrame:
    return D.incremental_plan(baseline(t), target(t))


@query("snapshot_seed", f"WITH {SNAPSHOT_SQL} SELECT path, sha FROM base JOIN target USING (path, sha)")
def snapshot_seed(t: Tables) -> DataFrame:
    return baseline(t).join(target(t).select("path", "sha"), ["path", "sha"], "left_semi").select("path", "sha")


@query("chunk_reuse_map", f"WITH {SNAPSHOT_SQL}, {CHUNKS_SQL} SELECT path, sha, chunk_index FROM base JOIN target USING (path, sha) JOIN chunks c ON path = concat(c.source, '/', c.document_id, '.', c.lang)")
def chunk_reuse_map(t: Tables) -> DataFrame:
    c = chunks(t).select(F.concat("source", F.lit("/"), F.col("document_id").cast("string"), F.lit("."), "lang").alias("path"), "chunk_index")
    return baseline(t).join(target(t).select("path", "sha"), ["path", "sha"]).join(c, "path").select("path", "sha", "chunk_index")


@query("needs_embedding", f"WITH {SNAPSHOT_SQL} SELECT path FROM target t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.path = t.path AND b.sha = t.sha)")
def needs_embedding(t: Tables) -> DataFrame:
    return target(t).join(baseline(t), ["path", "sha"], "left_anti").select("path")


@query("upsert_change_detect", f"WITH {SNAPSHOT_SQL} SELECT path, b.sha IS DISTINCT FROM t.sha AS changed FROM target t LEFT JOIN base b USING (path)")
def upsert_change_detect(t: Tables) -> DataFrame:
    return D.upsert(baseline(t), target(t), ["path"], "sha")[1].select("path", "changed")


@query("version_history", f"WITH {SNAPSHOT_SQL} SELECT path, sha FROM base UNION SELECT path, sha FROM target")
def version_history(t: Tables) -> DataFrame:
    new = target(t).join(baseline(t), ["path", "sha"], "left_anti").select("path", "sha")
    return baseline(t).select("path", "sha").unionByName(new)


@query("idempotent_append", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = d.doc_id % 2 THEN 'replayed' ELSE 'conflict' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def idempotent_append(t: Tables) -> DataFrame:
    incoming = t.documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return D.append_idempotent(t.labels, incoming, ["doc_id"], "quality").select("doc_id", "status")


@query("content_dedup", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text), n_chars) AS stored_id FROM documents")
def content_dedup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), "n_chars")
    return D.deduplicate_content(rows, ["sha", "n_chars"], "doc_id").select("doc_id", "stored_id")


@query("manifest_dup_check", "SELECT md5(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def manifest_dup_check(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("sha")).agg(F.count("*").alias("n")).where("n > 1")


@query("src_incremental_keyset", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 5) ORDER BY ts, event_id LIMIT 500")
def src_incremental_keyset(t: Tables) -> DataFrame:
    from quillspark.sources.keyset import incremental_batch

    return incremental_batch(t.events, "ts", "event_id", ("2024-01-10", 5), 500).select("event_id")


@query("src_batch", "SELECT doc_id::VARCHAR AS external_id, source AS source_key, text AS body_text, lang AS content_locale FROM documents ORDER BY doc_id LIMIT 300")
def src_batch(t: Tables) -> DataFrame:
    rows = t.documents.orderBy("doc_id").limit(300)
    return rows.select(F.col("doc_id").cast("string").alias("external_id"), F.col("source").alias("source_key"), F.col("text").alias("body_text"), F.col("lang").alias("content_locale"))


@query("sync_checkpoint", "SELECT event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def sync_checkpoint(t: Tables) -> DataFrame:
    from quillspark.sources.keyset import checkpoint

    return checkpoint(t.events, "event_type", "ts", "event_id")


@query("checkpoint_upsert", """WITH c AS (SELECT event_type, event_id % 2 AS half, max((ts, event_id)) AS last FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0) GROUP BY 1, 2)
SELECT event_type, max(last)[1] AS ts, max(last)[2] AS event_id FROM c GROUP BY 1""")
def checkpoint_upsert(t: Tables) -> DataFrame:
    from quillspark.sources.keyset import checkpoint, upsert_checkpoints

    half = lambda k: checkpoint(t.events.where(F.col("event_id") % 2 == k).where(f"not (event_type = 'error' and {k} = 0)"), "event_type", "ts", "event_id")
    return upsert_checkpoints(half(0), half(1), "event_type", "ts", "event_id")


@query("orphans_multi_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier) ORDER BY p_partkey LIMIT 100")
def orphans_multi_anti(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    left = t.part.join(used, "p_partkey", "left_anti").join(t.supplier.select(F.col("s_suppkey").alias("p_partkey")), "p_partkey", "left_anti")
    return left.orderBy("p_partkey").limit(100).select("p_partkey")


@query("reference_count", "SELECT id, count(*) AS n FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT p_partkey FROM part UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1")
def reference_count(t: Tables) -> DataFrame:
    ids = t.lineitem.select(F.col("l_partkey").alias("id")).unionAll(t.part.select("p_partkey")).unionAll(t.supplier.select("s_suppkey"))
    return ids.groupBy("id").agg(F.count("*").alias("n"))


@query("batch_verify", f"WITH {SNAPSHOT_SQL} SELECT count(*) FILTER (WHERE t.path IS NULL) AS missing, count(*) FILTER (WHERE t.path IS NOT NULL AND t.sha <> b.sha) AS differing FROM base b LEFT JOIN target t USING (path)")
def batch_verify(t: Tables) -> DataFrame:
    s = D.compare(baseline(t), target(t))
    return s.agg(F.count_if(F.col("status") == "deleted").alias("missing"), F.count_if(F.col("status") == "modified").alias("differing"))


@query("dedup_deliveries", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_deliveries(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("safe_filename", r"""SELECT page_id, concat(trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '[\x00-\x1f\x7f]', ' ', 'g')), '.html') AS name FROM pages WHERE url NOT LIKE '%.html'""")
def safe_filename(t: Tables) -> DataFrame:
    from quillspark.functions.text import safe_filename as name

    return t.pages.where("url not like '%.html'").select("page_id", name(F.col("url"), "html").alias("name"))


@query("image_parent_hydrate", "SELECT l_partkey, l_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE rn <= 2")
def image_parent_hydrate(t: Tables) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))
    top = t.lineitem.withColumn("rn", rn).where("rn <= 2")
    return top.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_partkey", "l_orderkey", "o_orderdate")


@query("order_by_group_min", "SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 ORDER BY first, o_custkey LIMIT 20")
def order_by_group_min(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first")).orderBy("first", "o_custkey").limit(20)


@query("doc_point_ids", "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS points FROM lineitem GROUP BY 1")
def doc_point_ids(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("points"))


@query("file_counts_window", """WITH f AS (SELECT l_orderkey, min(l_partkey) AS file_id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT file_id, count(*) AS n FROM lineitem LEFT JOIN f USING (l_orderkey)
WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 2)) AND (l_orderkey < 3000 OR (l_orderkey = 3000 AND l_linenumber <= 3)) GROUP BY 1""")
def file_counts_window(t: Tables) -> DataFrame:
    after = F.expr("l_orderkey > 100 or (l_orderkey = 100 and l_linenumber > 2)")
    upto = F.expr("l_orderkey < 3000 or (l_orderkey = 3000 and l_linenumber <= 3)")
    page = t.lineitem.where(F.col("l_orderkey").between(100, 3000) & after & upto).select("l_orderkey")
    files = t.lineitem.where("l_orderkey between 100 and 3000 and l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_partkey").alias("file_id"))
    return page.join(files, "l_orderkey", "left").groupBy("file_id").agg(F.count("*").alias("n"))


_RECORDS_SQL = "SELECT doc_id::VARCHAR AS external_id, source || '/' || doc_id AS title, n_chars, TIMESTAMP '2024-01-01' + to_minutes((doc_id // 3)::INT) AS updated_at FROM documents"


@query("connector_records", f"SELECT external_id, title, length(title) AS n_title, updated_at FROM ({_RECORDS_SQL}) WHERE updated_at > TIMESTAMP '2024-01-01 00:20:00' OR (updated_at = TIMESTAMP '2024-01-01 00:20:00' AND external_id > '61')")
def connector_records(t: Tables) -> DataFrame:
    """All records behind a checkpoint, by the connector data source over a relation of files."""
    from quillspark.session import materialize
    from quillspark.sources.connector import RecordSource

    updated = F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, cast(doc_id div 3 as int))")
    title = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    rows = t.documents.select(F.col("doc_id").cast("string").alias("external_id"), title.alias("title"), F.col("text").alias("body_text"), F.concat(F.lit("doc://"), title).alias("source_uri"), updated.alias("updated_at"))
    folder = materialize(rows, "records").inputFiles()[0].rpartition("/")[0]
    t.spark.dataSource.register(RecordSource)
    found = t.spark.read.format("records").options(path=folder, updated_at="2024-01-01T00:20:00", external_id="61").load()
    return found.select("external_id", "title", F.length("title").alias("n_title"), "updated_at")
