"""Queries over chunkers, packers, segmenters and file rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.locale import COMMON_WORDS, LEAST_CONFIDENCE, detect_locale as locale_of
from quillspark.functions.paths import file_kind as kind_of, language_of, selection
from quillspark.functions.text import normalize_body
from quillspark.operators import chunking as C
from quillspark.plans.corpus import CHUNKS_SQL, chunks
from quillspark.plans.registry import Tables, query


@query("chunk_chars")
def chunk_chars(t: Tables) -> DataFrame:
    return C.chunk_text(t.documents.withColumn("body", normalize_body(F.col("text"))), "doc_id", "body")


@query("chunk_tokens")
def chunk_tokens(t: Tables) -> DataFrame:
    return C.chunk_text(t.documents, "doc_id", "text", C.ChunkBudget(1024, 128, "tokens"))


@query("chunk_lines")
def chunk_lines(t: Tables) -> DataFrame:
    return C.chunk_code(t.documents, "doc_id", "text")


@query("chunk_tokens_v2")
def chunk_tokens_v2(t: Tables) -> DataFrame:
    return C.chunk_text(t.documents, "doc_id", "text", C.ChunkBudget.parse("tokens_v2:words:1024:128"))


@query("chunk_structural", """WITH i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT l_orderkey, (k - 1)::INT AS chunk_index, (k * 5 - 4)::INT AS start_line, (k * 5)::INT AS end_line, concat('/// ', k, chr(10), '#[inline]', chr(10), 'pub fn n', l_partkey, '() -> i32 {', chr(10), '    ', l_partkey, chr(10), '}', chr(10)) AS chunk_text FROM i""")
def chunk_structural(t: Tables) -> DataFrame:
    """A source of each order, with a function for each of its lines."""
    key = lambda x: x["l_partkey"].cast("string")
    item = lambda x, k: F.concat(F.lit("/// "), (k + 1).cast("string"), F.lit("\n#[inline]\npub fn n"), key(x), F.lit("() -> i32 {\n    "), key(x), F.lit("\n}\n"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    return C.chunk_structure(lines.select("l_orderkey", F.array_join(F.transform("lines", item), "").alias("source")), "l_orderkey", "source", "rust")


_SEGMENTS_SQL = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS last FROM documents WHERE text <> ''),
m AS (SELECT doc_id, n, CASE WHEN n < last THEN line || chr(10) ELSE line END AS line, regexp_matches(line, '[^\\s]') AS filled, starts_with(ltrim(line), '```') AS fence FROM l WHERE NOT (n = last AND line = '')),
o AS (SELECT *, sum(fence::INT) OVER w - fence::INT AS fences FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
q AS (SELECT *, filled AND NOT fence AND fences % 2 = 0 AS good FROM o),
e AS (SELECT *, NOT good OR NOT coalesce(lag(good) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM q),
g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM e),
blocks AS (SELECT doc_id, block, string_agg(line, '' ORDER BY n) AS text, bool_and(good) AS good FROM g GROUP BY 1, 2),
cores AS (SELECT doc_id, block, good, CASE WHEN good THEN rtrim(text, chr(10)) ELSE text END AS core, text FROM blocks),
parts AS (SELECT *, unnest(range(0, greatest(1, (length(core) + {C.MOST_SEGMENT_CHARS - 1}) // {C.MOST_SEGMENT_CHARS}))) AS k FROM cores)"""


@query("segment_body", f"""WITH {_SEGMENTS_SQL}, s AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, k) - 1)::INT AS chunk_index, core[k * {C.MOST_SEGMENT_CHARS} + 1:(k + 1) * {C.MOST_SEGMENT_CHARS}] AS segment_text,
  CASE WHEN (k + 1) * {C.MOST_SEGMENT_CHARS} >= length(core) THEN text[length(core) + 1:] ELSE '' END AS suffix, good AS translatable FROM parts)
SELECT doc_id, chunk_index, printf('body:%06d', chunk_index) AS segment_id, segment_text, suffix, translatable FROM s""")
def segment_body(t: Tables) -> DataFrame:
    return C.segment(t.documents, "doc_id", "text")


def _packed_sql(rows: str, most_items: int, most_size: int) -> str:
    """Batches by recursion over (key, i, size), i from 1."""
    new = f"items = {most_items} OR total + r.size > {most_size}"
    return f"""RECURSIVE {rows}, b AS (SELECT key, i, 0::BIGINT AS batch_id, 1 AS items, size::BIGINT AS total FROM r WHERE i = 1
  UNION ALL SELECT b.key, r.i, batch_id + CASE WHEN {new} THEN 1 ELSE 0 END, CASE WHEN {new} THEN 1 ELSE items + 1 END, CASE WHEN {new} THEN r.size ELSE total + r.size END FROM b JOIN r ON r.key = b.key AND r.i = b.i + 1)"""


@query("batch_pack", f"""WITH {_packed_sql(CHUNKS_SQL + ", r AS (SELECT source AS key, row_number() OVER (PARTITION BY source ORDER BY document_id, chunk_index) AS i, length(chunk_text) AS size, document_id, chunk_index FROM chunks)", C.BATCH_ITEMS, C.BATCH_CHARS)}
SELECT key AS source, document_id, chunk_index, batch_id FROM b JOIN r USING (key, i)""")
def batch_pack(t: Tables) -> DataFrame:
    return C.plan_batches(chunks(t), ["source"], ["document_id", "chunk_index"], "chunk_text").drop("error")


@query("embed_batch_plan", f"""WITH {_packed_sql("r AS (SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, strlen(to_json(text)) AS size, turn FROM conversations)", C.REQUEST_ITEMS, C.REQUEST_BYTES)}
SELECT key AS conv_id, turn, batch_id FROM b JOIN r USING (key, i)""")
def embed_batch_plan(t: Tables) -> DataFrame:
    return C.plan_batches(t.conversations, ["conv_id"], ["turn"], "text", requests=True).drop("error")


_PATH_SQL = "SELECT doc_id, concat(source, '/', CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE '' END, doc_id, CASE doc_id % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.min.js' WHEN 2 THEN '.png' WHEN 3 THEN '.md' ELSE '.yml' END) AS path, n_chars AS size FROM documents"


def _paths(t: Tables) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".rs", ".min.js", ".png", ".md", ".yml"))), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 11 == 0, "node_modules/").otherwise("")
    return t.documents.select("doc_id", F.concat("source", F.lit("/"), folder, F.col("doc_id").cast("string"), suffix).alias("path"), F.col("n_chars").alias("size"))


_DECISION_SQL = f"""p AS ({_PATH_SQL}), s AS (SELECT doc_id, CASE WHEN path LIKE '%/node_modules/%' THEN 'excluded_directory' WHEN path LIKE '%.min.%' THEN 'minified'
  WHEN path LIKE '%.png' THEN 'binary' WHEN size > 5000 THEN 'too_large' WHEN starts_with(path, 'src3/') THEN 'excluded_by_user' WHEN path LIKE '%.rs' OR path LIKE '%.md' THEN 'eligible' ELSE 'not_included' END AS decision FROM p)"""


@query("file_selection", f"WITH {_DECISION_SQL} SELECT doc_id, decision FROM s")
def file_selection(t: Tables) -> DataFrame:
    return _paths(t).select("doc_id", selection(F.col("path"), F.col("size"), excludes=("src3/**",), most_bytes=5000).alias("decision"))


@query("skip_summary", f"WITH {_DECISION_SQL} SELECT decision, count(*) AS n FROM s WHERE decision <> 'eligible' GROUP BY 1")
def skip_summary(t: Tables) -> DataFrame:
    return file_selection(t).where("decision <> 'eligible'").groupBy("decision").agg(F.count("*").alias("n"))


@query("file_kind", f"WITH p AS ({_PATH_SQL}) SELECT doc_id, CASE WHEN path LIKE '%.md' THEN 'text' WHEN path LIKE '%.png' THEN 'image' ELSE 'invalid' END AS kind FROM p")
def file_kind(t: Tables) -> DataFrame:
    return _paths(t).select("doc_id", kind_of(F.col("path")).alias("kind"))


@query("lang_from_path", f"WITH p AS ({_PATH_SQL}) SELECT doc_id, CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.yml' THEN 'yaml' ELSE 'unknown' END AS language FROM p")
def lang_from_path(t: Tables) -> DataFrame:
    return _paths(t).select("doc_id", language_of(F.col("path")).alias("language"))


@query("code_text_valid", "SELECT doc_id, strlen(text) <= 8388608 AS valid FROM documents")
def code_text_valid(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.is_valid_utf8("text") & ~F.col("text").contains("\x00") & (F.octet_length("text") <= 8 << 20)).alias("valid"))


@query("code_window", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS body FROM l WHERE n BETWEEN 2 AND 4 GROUP BY 1")
def code_window(t: Tables) -> DataFrame:
    lines = F.slice(F.split("text", "\n"), 2, 3)
    return t.documents.where(F.size(lines) > 0).select("doc_id", F.array_join(lines, "\n").alias("body"))


_FOUND_SQL = ", ".join(f"len(list_filter(w, lambda x: list_contains({own!r}, x))) AS {code}" for code, own in COMMON_WORDS.items())
_TOTAL_SQL = " + ".join([*COMMON_WORDS, "zh"])
_LOCALE_SQL = " ".join(f"WHEN {c} >= {LEAST_CONFIDENCE}::DOUBLE * ({_TOTAL_SQL}) THEN '{c}'" for c in [*COMMON_WORDS, "zh"])


@query("detect_locale", rf"""WITH t AS (SELECT doc_id, text, string_split_regex(lower(text), '[^\p{{L}}]+') AS w FROM documents),
n AS (SELECT doc_id, {_FOUND_SQL}, length(regexp_replace(text, '[^\p{{Han}}]', '', 'g')) AS zh FROM t) SELECT doc_id, CASE WHEN {_TOTAL_SQL} = 0 THEN NULL {_LOCALE_SQL} END AS locale FROM n""")
def detect_locale(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", locale_of(F.col("text")).alias("locale"))


_TRIGRAMS_SQL = r"""spaced AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS s FROM documents),
letters AS (SELECT doc_id, lang, string_split(s, '') AS l FROM spaced),
grams AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2])) AS t FROM letters)"""


@query("language_identify", f"""WITH {_TRIGRAMS_SQL},
counted AS (SELECT lang, t, count(*) AS n FROM grams WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY 1, 2),
profile AS (SELECT lang, t, 301 - row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) AS w FROM counted QUALIFY w > 0),
scored AS (SELECT g.doc_id, p.lang, sum(w) AS s FROM (SELECT DISTINCT doc_id, t FROM grams) g JOIN profile p USING (t) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r, lead(s, 1, 0) OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS next FROM scored)
SELECT d.doc_id, d.doc_id % 3 = 1 AS held_out, CASE WHEN round(r.s / greatest(r.s + r.next, 1)::DOUBLE, 6) >= 0.65 THEN r.lang END AS lang_found, coalesce(round(r.s / greatest(r.s + r.next, 1)::DOUBLE, 6), 0) AS lang_confidence
FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.r = 1""")
def language_identify(t: Tables) -> DataFrame:
    """Languages by trigrams learnt from two thirds of the documents."""
    from quillspark.functions.language import learn_profiles

    profiles = learn_profiles(t.documents.where("doc_id % 3 <> 1"), "text", "lang")
    return profiles.identify(t.documents, "doc_id", "text").select("doc_id", (F.col("doc_id") % 3 == 1).alias("held_out"), "lang_found", "lang_confidence")
