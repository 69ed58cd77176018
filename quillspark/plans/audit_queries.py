"""Rebuild audits, caches, images and the smaller data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.text import error_class as class_of, fingerprint, instant, one_line
from quillspark.operators import documents as X, metadata as M, search as S, snapshots as D
from quillspark.plans.corpus import SNAPSHOT_SQL, baseline, target
from quillspark.plans.registry import Tables, query
from quillspark.plans.search_queries import _COSINE_SQL, _target


@query("error_class", "SELECT CASE WHEN regexp_matches(lower(text), 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(text), 'token|password') THEN 'credentials' WHEN regexp_matches(lower(text), 'license') THEN 'license' ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1")
def error_class(t: Tables) -> DataFrame:
    rules = {"timeout": "timeout|timed out", "credentials": "token|password", "license": "license"}
    return t.documents.groupBy(class_of(F.col("text"), rules).alias("class")).agg(F.count("*").alias("n"))


@query("one_line_text", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x00-\x1f\x7f]+', ' ', 'g'))[1:512] AS line FROM documents")
def one_line_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", one_line(F.col("text")).alias("line"))


@query("framed_fingerprint", "SELECT doc_id, sha256(concat(coalesce(strlen(source) || ':' || source, '-:'), coalesce(strlen(CASE WHEN doc_id % 3 <> 0 THEN lang END) || ':' || lang, '-:'), strlen(text) || ':' || text)) AS fingerprint FROM documents")
def framed_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fingerprint(F.col("source"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.col("text")).alias("fingerprint"))


@query("instant_of_text", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN TIMESTAMP '1970-01-01' WHEN 1 THEN TIMESTAMP '3000-01-01' WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events""")
def instant_of_text(t: Tables) -> DataFrame:
    shifted = F.concat(F.date_format(F.col("ts") + F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
    said = F.when(F.col("event_id") % 5 == 0, "1850-02-03T04:05:06Z").when(F.col("event_id") % 5 == 1, "4000-01-01T00:00:00+02:00").when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy-MM-dd"))
    return t.events.select("event_id", instant(said.when(F.col("event_id") % 5 == 3, shifted).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("at"))


@query("json_type_tests", "SELECT event_id, json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AS is_number, json_exists(props, '$.k') AS has_k, json_exists(props, '$.other') AS has_other FROM events")
def json_type_tests(t: Tables) -> DataFrame:
    return t.events.select("event_id", (M.json_type("props", "k") == "number").alias("is_number"), M.json_has("props", "k").alias("has_k"), M.json_has("props", "other").alias("has_other"))


@query("reorder_by_index", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts, count(DISTINCT l_linenumber) = count(*) AS unique_index FROM lineitem GROUP BY 1")
def reorder_by_index(t: Tables) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(ordered, ",").alias("parts"), (F.count_distinct("l_linenumber") == F.count("*")).alias("unique_index"))


@query("latest_status", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linestatus FROM lineitem ORDER BY l_orderkey, l_shipdate DESC, l_linenumber DESC, l_partkey DESC")
def latest_status(t: Tables) -> DataFrame:
    return D.latest(t.lineitem, ["l_orderkey"], F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey")).select("l_orderkey", "l_linestatus")


@query("folder_processing", "SELECT c_nationkey, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1")
def folder_processing(t: Tables) -> DataFrame:
    busy = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(busy, "c_custkey", "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("replacement_points", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def replacement_points(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).union(t.part.where("p_size > 40").select("p_partkey")).distinct()


@query("active_images", f"WITH {SNAPSHOT_SQL} SELECT path FROM base JOIN target USING (path, sha, bytes)")
def active_images(t: Tables) -> DataFrame:
    return baseline(t).join(target(t), ["path", "sha", "bytes"], "left_semi").select("path")


@query("vector_reuse", "SELECT d.doc_id, e.vec_id IS NOT NULL AS reused, coalesce(len(e.embedding), 0) AS dims FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND d.doc_id % 3 <> 0")
def vector_reuse(t: Tables) -> DataFrame:
    old = t.embeddings.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = t.documents.join(old, "doc_id", "left")
    return rows.select("doc_id", F.col("embedding").isNotNull().alias("reused"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"))


@query("image_search", f"""WITH c AS (SELECT vec_id // 2 AS point_id, {_COSINE_SQL} FROM embeddings WHERE label IN (1, 2, 3, 4, 5, 6) ORDER BY vector_score DESC, vec_id LIMIT 60),
b AS (SELECT point_id, max(vector_score) AS vector_score FROM c WHERE point_id IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
l AS (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_linenumber, l_orderkey, l_suppkey) AS rn FROM lineitem)
SELECT point_id, vector_score, l_orderkey AS document_id FROM b LEFT JOIN l ON l_partkey = point_id AND rn <= 2""")
def image_search(t: Tables) -> DataFrame:
    vectors = t.embeddings.withColumn("point_id", F.floor(F.col("vec_id") / 2))
    active = t.part.where("p_size > 10").select(F.col("p_partkey").alias("point_id"))
    links = t.lineitem.withColumnsRenamed({"l_partkey": "point_id", "l_orderkey": "document_id"})
    order = [F.col(c) for c in ("l_returnflag", "l_linenumber", "document_id", "l_suppkey")]
    return S.search_images(vectors, active, links, _target(t), 20, 2, F.col("label").isin(1, 2, 3, 4, 5, 6), *order)


@query("hash_embed_size", r"SELECT item_id, 32 AS dimension, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))::DOUBLE AS total FROM benchmark")
def hash_embed_size(t: Tables) -> DataFrame:
    v = X.hashed_embedding(F.col("text"))
    return t.benchmark.select("item_id", F.size(v).alias("dimension"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("hash_embed")
def hash_embed(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.hashed_embedding(F.col("text")).alias("embedding"))
