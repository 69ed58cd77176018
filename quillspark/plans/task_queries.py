"""Tasks, generations, rebuilds and file names, over orders, lineitem, part and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators import generations as G, tasks as T
from quillspark.plans.corpus import CHUNKS_SQL, chunks
from quillspark.plans.registry import Tables, query

#: Items and tasks as views: column -> SQL that both engines read alike.
_ITEM = {
    "task_id": "l_orderkey",
    "ordinal": "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey",
    "status": """CASE WHEN l_orderkey % 5 = 0 THEN CASE WHEN l_orderkey % 25 = 0 THEN 'cancelled' WHEN l_orderkey % 3 = 0 AND l_partkey % 3 = 1 THEN 'failed' ELSE 'succeeded' END
      WHEN l_linenumber <= l_orderkey % 3 THEN 'succeeded' WHEN (l_orderkey + l_partkey) % 6 = 0 THEN 'running' WHEN (l_orderkey + l_partkey) % 4 = 1 THEN 'waiting' ELSE 'queued' END""",
    "attempts": "l_partkey % 8",
    "paused_attempts": "l_suppkey % 2",
    "released_attempts": "l_suppkey % 3",
    "waiting_reason": "CASE WHEN l_partkey % 5 = 0 THEN 'docling' WHEN l_partkey % 5 = 1 THEN 'dependency' END",
    "dependency_key": "CASE WHEN l_suppkey % 2 = 0 THEN 'vector_rebuild_paused' WHEN l_suppkey % 3 = 0 THEN 'other' END",
    "next_attempt_at": "CASE WHEN l_partkey % 9 <> 0 THEN l_shipdate END",
    "is_live": "l_partkey % 3 = 0",
    "failure_stage": "CASE WHEN l_quantity > 10 THEN l_returnflag END",
    "stage": "CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END",
    "error_message": "CASE WHEN l_quantity > 20 THEN concat('part ', l_partkey) END",
}
_TASK = {
    "task_id": "o_orderkey",
    "queue": "o_orderkey % 400",
    "kind": "CASE WHEN o_custkey % 40 = 0 THEN 'vector_rebuild' ELSE 'import' END",
    "status": "CASE WHEN o_orderkey % 50 = 0 THEN 'cancelled' WHEN o_orderkey % 7 = 0 THEN 'succeeded' ELSE 'running' END",
    "pause_state": "CASE WHEN o_orderkey % 11 = 0 THEN 'paused' ELSE 'unpaused' END",
    "created_at": "o_orderdate",
    "next_attempt_at": "CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END",
    "is_deleted": "o_orderkey % 61 = 0",
    "total_count": "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)",
}
_NOW = "TIMESTAMP '2000-01-01'"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in T.STATUSES)
_VIEWS = f"""items AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _ITEM.items())} FROM lineitem),
tasks AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _TASK.items())} FROM orders),
counts AS (SELECT task_id, count(*) AS n_items, {_COUNTS} FROM items GROUP BY 1),
current AS (SELECT DISTINCT ON (task_id) * FROM items WHERE status IN ('queued', 'running', 'waiting') ORDER BY task_id, ordinal)"""


def _items(t: Tables) -> DataFrame:
    return t.lineitem.select(*[F.expr(v).alias(k) for k, v in _ITEM.items()])


def _tasks(t: Tables) -> DataFrame:
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total"))
    rows = t.orders.join(totals, "o_orderkey", "left")
    return rows.select(*[F.expr(v).alias(k) for k, v in _TASK.items() if k != "total_count"], F.coalesce("total", F.lit(0)).alias("total_count"))


@query("task_status_projection", f"""WITH {_VIEWS}, r AS (
  SELECT t.task_id, t.status AS before, t.pause_state AS paused, total_count AS total, {', '.join(f'n_{s}' for s in T.STATUSES)}, u.ordinal AS current, u.stage, u.waiting_reason, u.dependency_key, u.next_attempt_at AS due, u.status AS now,
    n_queued + n_running + n_waiting = 0 AS none_open, n_succeeded + n_failed + n_cancelled = total_count AS done FROM tasks t JOIN counts USING (task_id) LEFT JOIN current u USING (task_id))
SELECT task_id, {', '.join(f'n_{s}' for s in T.STATUSES)}, current, stage, waiting_reason, dependency_key, due AS next_attempt_at,
  (SELECT arg_min(failure_stage, ordinal) FROM items i WHERE i.task_id = r.task_id AND i.status = 'failed' AND failure_stage IS NOT NULL) AS failure_stage,
  (SELECT arg_min(error_message, ordinal) FROM items i WHERE i.task_id = r.task_id AND i.status = 'failed' AND error_message IS NOT NULL) AS error_summary,
  CASE WHEN before = 'cancelled' AND none_open OR n_cancelled = total THEN 'cancelled' WHEN done AND n_failed = 0 THEN 'succeeded' WHEN done THEN 'failed' ELSE coalesce(now, 'queued') END AS status,
  CASE WHEN before = 'cancelled' AND none_open OR done THEN 'unpaused' ELSE paused END AS pause_state FROM r""")
def task_status_projection(t: Tables) -> DataFrame:
    return T.project(_tasks(t), _items(t))


@query("claimable_items", f"""WITH {_VIEWS},
usable AS (SELECT c.task_id, c.ordinal, queue, kind, t.status AS task_status, is_deleted, t.next_attempt_at AS task_next, created_at FROM current c JOIN tasks t USING (task_id)
  WHERE c.status <> 'running' AND attempts - paused_attempts - released_attempts < 5 AND coalesce(c.next_attempt_at <= {_NOW}, true) AND pause_state = 'unpaused'
    AND NOT (c.status = 'waiting' AND (coalesce(waiting_reason, '') = 'docling' OR (coalesce(waiting_reason, '') = 'dependency' AND coalesce(dependency_key, '') = 'vector_rebuild_paused')))),
fit AS (SELECT * FROM usable WHERE task_status IN ('queued', 'running', 'waiting') AND NOT is_deleted AND coalesce(task_next <= {_NOW}, true)),
live AS (SELECT queue, kind, task_id FROM items JOIN tasks USING (task_id) WHERE items.status = 'running' AND is_live),
gate AS (SELECT q.queue, (SELECT min(task_id) FROM live l WHERE l.queue = q.queue AND kind = 'vector_rebuild') AS rebuilding,
  (SELECT count(*) FROM live l WHERE l.queue = q.queue AND kind <> 'vector_rebuild') AS n_ordinary,
  (SELECT arg_min(task_id, (created_at, task_id)) FROM fit f WHERE f.queue = q.queue AND kind = 'vector_rebuild') AS waiting FROM (SELECT DISTINCT queue FROM tasks) q),
modes AS (SELECT queue, coalesce(rebuilding, waiting) AS rebuild, CASE WHEN rebuilding IS NOT NULL THEN 'rebuild' WHEN waiting IS NULL THEN 'normal' WHEN n_ordinary > 0 THEN 'drain' ELSE 'rebuild' END AS mode FROM gate)
SELECT task_id, ordinal, queue, mode FROM fit JOIN modes USING (queue) WHERE mode = 'normal' OR (mode = 'rebuild' AND task_id = rebuild)""")
def claimable_items(t: Tables) -> DataFrame:
    return T.claimable(_tasks(t), _items(t), F.expr(_NOW))


_FIELDS = ["n_items", *[f"n_{s}" for s in T.STATUSES]]


@query("consistency_check", f"""WITH {_VIEWS},
stored AS (SELECT task_id, count(*) AS n_items, {_COUNTS} FROM items WHERE ordinal % 40 <> 0 GROUP BY 1),
both_ AS (SELECT t.task_id, {', '.join(f's.{f} AS {f}_stored, coalesce(c.{f}, 0) AS {f}_now' for f in _FIELDS)} FROM tasks t LEFT JOIN stored s USING (task_id) LEFT JOIN counts c USING (task_id) WHERE NOT is_deleted)
{' UNION ALL '.join(f"SELECT task_id, '{f}' AS field, {f}_stored AS stored, {f}_now AS actual FROM both_ WHERE {f}_stored IS DISTINCT FROM {f}_now" for f in _FIELDS)}""")
def consistency_check(t: Tables) -> DataFrame:
    items = _items(t)
    return T.consistency(_tasks(t), T.rollup(items.where("ordinal % 40 <> 0")), items)


#: What the report looks at besides, both engines alike. A third of the tasks store what contradicts their items.
_MORE_ITEM = {"lease_until": "CASE WHEN l_partkey % 4 <> 0 THEN l_shipdate END"}
_MORE_TASK = {"lease_until": "CASE WHEN o_orderkey % 4 <> 1 THEN o_orderdate END", "started_at": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END"}
_REPORT_NOW = "TIMESTAMP '1996-01-01'"
_STATUS_SQL = """CASE WHEN status = 'cancelled' AND n_queued + n_running + n_waiting = 0 OR n_cancelled = total_count THEN 'cancelled' WHEN n_succeeded + n_failed + n_cancelled = total_count
  THEN CASE WHEN n_failed = 0 THEN 'succeeded' ELSE 'failed' END ELSE coalesce(now_status, 'queued') END"""
_REPORT_SQL = f"""i AS (SELECT {', '.join(f'{v} AS {k}' for k, v in (_ITEM | _MORE_ITEM).items())} FROM lineitem),
c AS (SELECT task_id, count(*) AS n_items, {_COUNTS}, count(*) FILTER (WHERE status = 'running' AND (lease_until IS NULL OR lease_until > {_REPORT_NOW})) AS n_live,
  count(*) FILTER (WHERE status = 'running' AND (lease_until IS NULL OR lease_until <= {_REPORT_NOW})) AS n_lapsed,
  count(*) FILTER (WHERE status IN ('queued', 'running', 'waiting') AND attempts - paused_attempts - released_attempts >= 4) AS n_near,
  count(*) FILTER (WHERE status IN ('queued', 'running', 'waiting') AND attempts - paused_attempts - released_attempts < 5) AS n_unspent FROM i GROUP BY 1),
u AS (SELECT DISTINCT ON (task_id) task_id, status AS now_status, stage AS now_stage, waiting_reason AS now_reason, dependency_key AS now_key FROM i WHERE status IN ('queued', 'running', 'waiting') ORDER BY task_id, ordinal),
f AS (SELECT t.*, {', '.join(f'{v} AS {k}' for k, v in _MORE_TASK.items())}, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ['n_items', *[f'n_{s}' for s in T.STATUSES], 'n_live', 'n_lapsed', 'n_near', 'n_unspent'])}, now_status, now_stage, now_reason, now_key
  FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _TASK.items())}, orders.* FROM orders) t LEFT JOIN c USING (task_id) LEFT JOIN u USING (task_id) WHERE NOT is_deleted),
d AS (SELECT *, {_STATUS_SQL} AS derived FROM f),
s AS (SELECT *, CASE WHEN task_id % 3 = 0 THEN status ELSE derived END AS stored_status, total_count + CASE WHEN task_id % 17 = 0 THEN 1 ELSE 0 END AS stored_total,
  CASE WHEN task_id % 6 = 1 THEN 'parse' ELSE now_stage END AS stored_stage, CASE WHEN task_id % 8 = 3 THEN '' ELSE now_reason END AS stored_reason, CASE WHEN task_id % 10 = 7 THEN 'other' ELSE now_key END AS stored_key,
  {', '.join(f"n_{s} + CASE WHEN task_id % {19 + k} = 0 THEN 1 ELSE 0 END AS stored_{s}" for k, s in enumerate(T.STATUSES))} FROM d),
w AS (SELECT * REPLACE (stored_status AS status, stored_total AS total_count) FROM s),
v AS (SELECT *, {_STATUS_SQL} AS implied FROM w),
m AS (SELECT *, concat_ws(',', CASE WHEN status <> implied THEN 'status' END, CASE WHEN n_items <> total_count THEN 'total_count' END, {', '.join(f"CASE WHEN n_{s} <> stored_{s} THEN '{s}_count' END" for s in T.STATUSES)},
  CASE WHEN status <> 'queued' AND coalesce(stored_stage, '') <> coalesce(now_stage, '') THEN 'stage' END, CASE WHEN coalesce(stored_reason, '') <> coalesce(now_reason, '') THEN 'waiting_reason' END,
  CASE WHEN coalesce(stored_key, '') <> coalesce(now_key, '') THEN 'dependency_key' END) AS fields FROM v)"""


def _report(t: Tables) -> DataFrame:
    """Facts of tasks that store what their items say, but for some."""
    items = t.lineitem.select(*[F.expr(v).alias(k) for k, v in (_ITEM | _MORE_ITEM).items()])
    times = t.orders.select(F.col("o_orderkey").alias("task_id"), *[F.expr(v).alias(k) for k, v in _MORE_TASK.items()])
    bare = _tasks(t).join(times, "task_id").withColumns({c: F.lit(None).cast("string") for c in ("stage", "waiting_reason", "dependency_key")})
    said = T.facts(bare, items, F.expr(_REPORT_NOW))
    stored = said.select(
        *[c for c in _TASK if c not in ("status", "total_count")], *_MORE_TASK, F.when(F.col("task_id") % 3 == 0, F.col("status")).otherwise(F.col("derived_status")).alias("status"),
        (F.col("total_count") + (F.col("task_id") % 17 == 0).cast("int")).alias("total_count"), F.when(F.col("task_id") % 6 == 1, "parse").otherwise(F.col("current.stage")).alias("stage"),
        F.when(F.col("task_id") % 8 == 3, "").otherwise(F.col("current.waiting_reason")).alias("waiting_reason"), F.when(F.col("task_id") % 10 == 7, "other").otherwise(F.col("current.dependency_key")).alias("dependency_key"),
        *[(F.col(f"n_{s}") + (F.col("task_id") % (19 + k) == 0).cast("int")).alias(f"{s}_count") for k, s in enumerate(T.STATUSES)],
    )
    return T.facts(stored, items, F.expr(_REPORT_NOW))


@query("consistency_verdicts", f"WITH {_REPORT_SQL} SELECT task_id, fields FROM m WHERE fields <> ''")
def consistency_verdicts(t: Tables) -> DataFrame:
    """Every task whose status, counters, stage or reasons contradict its items, and the fields that do."""
    return T.verdicts(_report(t)).where(F.size("mismatch_fields") > 0).select("task_id", F.array_join("mismatch_fields", ",").alias("fields"))


@query("consistency_gauges", f"""WITH {_REPORT_SQL} SELECT count(*) AS tasks, count(*) FILTER (WHERE status IN ('queued', 'running', 'waiting')) AS active, count(*) FILTER (WHERE now_reason = 'dependency') AS waiting_for_dependency,
  count(*) FILTER (WHERE status = 'running' AND n_running = 0) AS running_without_item, sum(n_live)::BIGINT AS live_items,
  count(*) FILTER (WHERE status IN ('queued', 'running', 'waiting') AND lease_until > {_REPORT_NOW} AND n_live = 0 AND (n_lapsed > 0 OR NOT (n_unspent > 0 AND pause_state = 'unpaused'))) AS orphaned_slots,
  sum(n_near)::BIGINT AS nearly_exhausted, min(started_at) FILTER (WHERE status IN ('queued', 'running', 'waiting') AND lease_until > {_REPORT_NOW}) AS oldest_admitted, count(*) FILTER (WHERE fields <> '') AS mismatched FROM m""")
def consistency_gauges(t: Tables) -> DataFrame:
    return T.gauges(_report(t), F.expr(_REPORT_NOW))


# generations

_GENERATION = {
    "repository": "o_custkey", "generation": "o_orderkey", "number": "o_orderkey",
    "status": "CASE o_orderkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'superseded' WHEN 2 THEN 'failed' WHEN 3 THEN 'building' ELSE 'superseded' END",
    "cleanup_pending": "o_orderkey % 4 = 0", "next_retry_at": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END", "started_at": "o_orderdate",
}
_GENERATIONS_SQL = f"""g AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _GENERATION.items())} FROM orders),
active AS (SELECT repository, max(generation) AS generation FROM g WHERE status = 'ready' GROUP BY 1)"""


def _generations(t: Tables) -> tuple[DataFrame, DataFrame]:
    g = t.orders.select(*[F.expr(v).alias(k) for k, v in _GENERATION.items()])
    return g, g.where("status = 'ready'").groupBy("repository").agg(F.max("generation").alias("generation"))


@query("cleanup_candidates", f"""WITH {_GENERATIONS_SQL},
due AS (SELECT *, NOT cleanup_pending OR next_retry_at IS NULL OR next_retry_at <= {_NOW} AS may FROM g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY number DESC) AS rank FROM due WHERE status IN ('ready', 'superseded')),
found AS (SELECT repository, generation FROM ranked WHERE (rank > 2 OR cleanup_pending) AND may
  UNION SELECT repository, generation FROM due WHERE status = 'failed' AND may
  UNION SELECT repository, generation FROM due WHERE status = 'building' AND may AND started_at < {_NOW} - INTERVAL 1 HOUR)
SELECT * FROM found EXCEPT SELECT * FROM active""")
def cleanup_candidates(t: Tables) -> DataFrame:
    return G.removable(*_generations(t), 2, F.expr(_NOW))


_SOURCE_SQL = "SELECT c_custkey AS repository, c_custkey % 4 AS revision, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS target, c_custkey % 7 <> 0 AS is_enabled, c_custkey % 13 = 0 AS is_deleting FROM customer"
_BUILT_SQL = "SELECT o_custkey AS repository, o_orderkey AS generation, o_custkey % 4 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS revision, CASE WHEN o_custkey % 5 <> 0 AND o_orderkey % 8 <> 0 THEN c_name END AS target FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


@query("publish_next_state", f"""WITH {_GENERATIONS_SQL}, source AS ({_SOURCE_SQL}), built AS ({_BUILT_SQL}),
fine AS (SELECT b.repository, max(b.generation) AS published FROM built b JOIN source s USING (repository, revision) JOIN g USING (repository, generation)
  WHERE b.target IS NOT DISTINCT FROM s.target AND is_enabled AND NOT is_deleting AND g.status = 'building' GROUP BY 1)
SELECT g.repository, g.generation, CASE WHEN g.generation = published THEN 'ready' WHEN published IS NOT NULL AND g.generation = a.generation THEN 'superseded' ELSE g.status END AS status,
  coalesce(g.generation = coalesce(published, a.generation), false) AS is_active FROM g LEFT JOIN active a USING (repository) LEFT JOIN fine USING (repository)""")
def publish_next_state(t: Tables) -> DataFrame:
    sources = t.customer.selectExpr(
        "c_custkey AS repository", "c_custkey % 4 AS revision", "CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS target", "c_custkey % 7 <> 0 AS is_enabled", "c_custkey % 13 = 0 AS is_deleting"
    )
    built = t.orders.join(t.customer, F.expr("c_custkey = o_custkey"), "left").selectExpr(
        "o_custkey AS repository", "o_orderkey AS generation", "o_custkey % 4 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS revision",
        "CASE WHEN o_custkey % 5 <> 0 AND o_orderkey % 8 <> 0 THEN c_name END AS target",
    )
    g, active = _generations(t)
    return G.publish(g, sources, active, built)


@query("manifest_replace", """WITH fresh AS (SELECT l_orderkey AS owner, l_partkey AS path, l_quantity AS size FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber < 4),
old AS (SELECT l_orderkey AS owner, l_partkey AS path, l_quantity AS size FROM lineitem WHERE l_linenumber > 2),
wrong AS (SELECT DISTINCT owner FROM (SELECT owner, path FROM fresh GROUP BY ALL HAVING count(*) > 1)),
fine AS (SELECT * FROM fresh WHERE owner NOT IN (SELECT owner FROM wrong))
SELECT * FROM old WHERE owner NOT IN (SELECT owner FROM fine) UNION ALL SELECT * FROM fine""")
def manifest_replace(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("path"), F.col("l_quantity").alias("size"), "l_linenumber")
    return G.manifest(rows.where("l_linenumber > 2").drop("l_linenumber"), rows.where("owner % 3 = 0 and l_linenumber < 4").drop("l_linenumber"), ["path"], "owner")


# rebuilds: what is staged differs from what is live by the documents' ids

_REBUILD_SQL = f"""{CHUNKS_SQL},
staged AS (SELECT document_id, CASE WHEN document_id % 7 = 0 THEN 'old' ELSE 'hash' END AS record_hash, count(*) + CASE WHEN document_id % 13 = 0 THEN 1 ELSE 0 END AS chunk_count FROM chunks WHERE document_id % 10 <> 1 GROUP BY 1),
staged_chunks AS (SELECT document_id, chunk_index, CASE WHEN document_id % 5 = 0 AND chunk_index = 1 THEN concat(chunk_text, ' x') ELSE chunk_text END AS chunk_text,
  CASE WHEN document_id % 11 = 0 OR document_id % 7 = 0 THEN 'old' ELSE 'hash' END AS record_hash FROM chunks WHERE document_id % 10 <> 1),
live AS (SELECT doc_id AS document_id, 'hash' AS record_hash FROM documents WHERE doc_id % 29 <> 0),
live_chunks AS (SELECT document_id, chunk_index, chunk_text, 'hash' AS record_hash FROM chunks WHERE (document_id + chunk_index) % 17 <> 3)"""


def _rebuild(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = chunks(t).select("document_id", "chunk_index", "chunk_text")
    mine = rows.where("document_id % 10 <> 1")
    staged = mine.groupBy("document_id").agg(F.count("*").alias("n")).select(
        "document_id", F.expr("CASE WHEN document_id % 7 = 0 THEN 'old' ELSE 'hash' END").alias("record_hash"), F.expr("n + CASE WHEN document_id % 13 = 0 THEN 1 ELSE 0 END").alias("chunk_count")
    )
    text = F.expr("CASE WHEN document_id % 5 = 0 AND chunk_index = 1 THEN concat(chunk_text, ' x') ELSE chunk_text END")
    staged_chunks = mine.select("document_id", "chunk_index", text.alias("chunk_text"), F.expr("CASE WHEN document_id % 11 = 0 OR document_id % 7 = 0 THEN 'old' ELSE 'hash' END").alias("record_hash"))
    live = t.documents.where("doc_id % 29 <> 0").select(F.col("doc_id").alias("document_id"), F.lit("hash").alias("record_hash"))
    return live, staged, staged_chunks, rows.where("(document_id + chunk_index) % 17 <> 3").withColumn("record_hash", F.lit("hash"))


@query("rebuild_verify", f"""WITH {_REBUILD_SQL} SELECT
(SELECT count(*) FROM staged s LEFT JOIN live d USING (document_id) WHERE d.record_hash IS NULL OR d.record_hash <> s.record_hash) AS document_hash_mismatch,
(SELECT count(*) FROM staged s WHERE chunk_count <> (SELECT count(*) FROM staged_chunks c WHERE c.document_id = s.document_id)) AS chunk_count_mismatch,
(SELECT count(*) FROM staged_chunks c JOIN staged s USING (document_id) WHERE c.record_hash <> s.record_hash)
  + (SELECT count(*) FROM documents t JOIN live d ON d.document_id = t.doc_id WHERE t.lang <> 'en' AND CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'hash' END <> d.record_hash) AS chunk_hash_mismatch,
(SELECT count(*) FROM staged) AS staged_documents, (SELECT count(*) FROM live WHERE document_id NOT IN (SELECT document_id FROM staged)) AS document_membership_mismatch""")
def rebuild_verify(t: Tables) -> DataFrame:
    live, staged, staged_chunks, _ = _rebuild(t)
    translated = t.documents.where("lang <> 'en'").select(F.col("doc_id").alias("document_id"), F.expr("CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'hash' END").alias("record_hash"))
    return G.verify_rebuild(live, staged, staged_chunks, translated)


@query("page_proof", f"""WITH {_REBUILD_SQL} SELECT s.document_id // 50 AS page, count(*) AS n, count(*) FILTER (WHERE l.chunk_text IS DISTINCT FROM s.chunk_text OR l.record_hash IS DISTINCT FROM s.record_hash) AS mismatch
FROM staged_chunks s LEFT JOIN live_chunks l USING (document_id, chunk_index) GROUP BY 1""")
def page_proof(t: Tables) -> DataFrame:
    _, _, staged, live = _rebuild(t)
    found = G.page_mismatches(staged, live, ["chunk_text", "record_hash"])
    return found.groupBy(F.floor(F.col("document_id") / 50).alias("page")).agg(F.count("*").alias("n"), F.count_if("differs").alias("mismatch"))


@query("page_proof_range", f"""WITH {_REBUILD_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE l.chunk_text IS DISTINCT FROM s.chunk_text OR l.record_hash IS DISTINCT FROM s.record_hash) AS mismatch
FROM staged_chunks s LEFT JOIN live_chunks l USING (document_id, chunk_index) WHERE (s.document_id > 10 OR (s.document_id = 10 AND s.chunk_index > 1)) AND (s.document_id < 60 OR (s.document_id = 60 AND s.chunk_index <= 2))""")
def page_proof_range(t: Tables) -> DataFrame:
    _, _, staged, live = _rebuild(t)
    return G.page_mismatches(staged, live, ["chunk_text", "record_hash"], (10, 1), (60, 2)).agg(F.count("*").alias("n"), F.count_if("differs").alias("mismatch"))


# names

_NEW_SQL = "SELECT p_partkey AS id, CAST(p_size % 5 AS INT) AS folder, concat(p_name, '.txt') AS name FROM part WHERE p_partkey % 2 = 0"
_TAKEN_SQL = "SELECT CAST(p_size % 5 AS INT) AS folder, CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, '.txt') ELSE concat(p_name, ' (', p_size % 4 + 2, ').txt') END AS name FROM part WHERE p_partkey % 2 = 1"


@query("next_free_name", f"""WITH fresh AS ({_NEW_SQL}), taken AS (SELECT DISTINCT * FROM ({_TAKEN_SQL})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY id) AS place FROM fresh),
tries AS (SELECT folder, name, unnest(range(1, count(*) + 10)) AS k FROM fresh GROUP BY 1, 2),
named AS (SELECT folder, name, k, CASE WHEN k = 1 THEN name ELSE concat(replace(name, '.txt', ''), ' (', k, ').txt') END AS free_name FROM tries),
open_ AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY k) AS place FROM named n WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.folder = n.folder AND t.name = n.free_name))
SELECT id, folder, name, free_name FROM ranked JOIN open_ USING (folder, name, place)""")
def next_free_name(t: Tables) -> DataFrame:
    folder = F.expr("CAST(p_size % 5 AS INT)").alias("folder")
    new = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), folder, F.expr("concat(p_name, '.txt')").alias("name"))
    name = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, '.txt') ELSE concat(p_name, ' (', p_size % 4 + 2, ').txt') END")
    return G.free_names(new, t.part.where("p_partkey % 2 = 1").select(folder, name.alias("name"))).select("id", "folder", "name", "free_name")
