"""The registered queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from quillspark.llm.decontaminate import contaminations
from quillspark.llm.files import tokenizer_file
from quillspark.llm.hard_negatives import hard_negatives
from quillspark.llm.jaccard_join import jaccard_classes
from quillspark.llm.language import fit_languages, identify_language
from quillspark.llm.metric_tree import metric_topk
from quillspark.llm.pieces import MARK, decode_pieces, encode_pieces
from quillspark.llm.pii import fit_pii, pii_digest, pii_spans
from quillspark.llm.quality import LINE_LIMIT, MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW, WINDOW_LIMITS, quality_rules
from quillspark.llm.secrets import secret_digest, secret_spans
from quillspark.llm.shuffle_shards import read_shards, shard_digest, write_shards
from quillspark.llm.tandem_runs import LEAST_PERIODS, LEAST_WORDS, looped_words, runs_digest, tandem_runs
from quillspark.llm.token_store import read_store, write_store
from quillspark.llm.toxicity import fit_toxicity, score_toxicity
from quillspark.session import new_table_path

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_languages(docs, learn=_remainder("id", 3) != 1)
    found = identify_language(docs, model)
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "shards")
    write_shards(_documents(spark, sf_dir), path)
    return shard_digest(read_shards(spark, path))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_spans(_documents(spark, sf_dir)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return pii_digest(pii_spans(docs, fit_pii(docs)))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, tokenizer = new_table_path(spark, "token_store"), tokenizer_file("word_bpe_49k.json")
    write_store(_documents(spark, sf_dir), path, tokenizer)
    return read_store(spark, path, tokenizer).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=_remainder("id", 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, decoded again; round_trip says that the decoded text is the text, markers as spaces."""
    docs, model = _documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(docs, model, keep=F.md5(F.translate("text", MARK, " ")).alias("said")), model, keep="said")
    return decoded.select("doc_id", "n_pieces", "ids_crc32", (F.md5("text") == F.col("said")).alias("round_trip"))


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(tandem_runs(looped_words(_documents(spark, sf_dir))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label=label)


def op13_metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metric_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_external_shuffle": op4_external_shuffle,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_pii": op7_pii,
    "op8_token_store": op8_token_store,
    "op9_toxicity": op9_toxicity,
    "op10_pieces": op10_pieces,
    "op11_tandem_runs": op11_tandem_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_metric_topk": op13_metric_topk,
    "pipeline": corpus_pipeline.run,
}
#: Words as the operator takes them: texts without one have no shingle, shorter ones than five words have one.
_JACCARD_SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE c::DOUBLE / (p.n + q.n - c) >= 0.8),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, d.class_id, coalesce(n.n_links, 0) AS n_links
FROM (SELECT id AS doc_id, min(other) AS class_id FROM reach GROUP BY 1) d
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY 1) n USING (doc_id)
"""

_SHARES = ", ".join(f"coalesce(max(covered) FILTER (WHERE n = {n}), 0) / greatest(any_value(chars), 1)::DOUBLE AS dup_{n}gram_share" for n in WINDOW_LIMITS)
_FINE = " AND ".join(f"dup_{n}gram_share <= {limit}::DOUBLE" for n, limit in WINDOW_LIMITS.items())
_QUALITY_SQL = rf"""
WITH words AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places, (SELECT unnest([{', '.join(map(str, WINDOW_LIMITS))}]) AS n) WHERE i + n - 1 <= len(w)),
twice AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM windows) WHERE c > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM twice),
cover AS (SELECT doc_id, n, count(*) AS positions, sum(length(w[i])) AS covered FROM inside JOIN words USING (doc_id) GROUP BY 1, 2),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
filled AS (SELECT doc_id, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
repeats AS (SELECT doc_id, sum(c - 1) AS n_dup_lines, sum((c - 1) * length(line)) AS dup_chars, sum(c * length(line)) AS line_chars FROM filled GROUP BY 1),
base AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM words),
all_rows AS (
  SELECT doc_id, any_value(n_words) AS n_words, any_value(chars) AS word_chars, any_value(n_symbols) AS n_symbols, coalesce(any_value(n_dup_lines), 0)::BIGINT AS n_dup_lines,
    coalesce(max(positions) FILTER (WHERE n = {REPEAT_WINDOW}), 0) AS n_repeat_words, {_SHARES},
    coalesce(any_value(dup_chars), 0) / greatest(coalesce(any_value(line_chars), 1), 1)::DOUBLE AS dup_line_share
  FROM base LEFT JOIN cover USING (doc_id) LEFT JOIN repeats USING (doc_id) GROUP BY doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND dup_line_share <= {LINE_LIMIT}::DOUBLE AND {_FINE} AS kept
FROM all_rows
"""

#: CRC-32 of the decimal id by its table of 256 entries; runs from the pairs of equal words at each distance.
_RUNS_SQL = rf"""
WITH crc AS (
  SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i))),
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
law AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM hashed),
words AS (
  SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END + 1]) ELSE w END AS w FROM law),
places AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM words),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // {LEAST_PERIODS}),
islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM islands WHERE l >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q) GROUP BY 1, 2, 3),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS said FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
  sha256(coalesce(t.said, '')) AS runs_sha256, sha256(coalesce(r.said, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told t USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN rest r USING (doc_id)
"""


def _vectors_sql(scale: int, more: str = "") -> str:
    return (
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e{more} FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
    )


_NEGATIVES_SQL = f"""
WITH {_vectors_sql(256, ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")},
near AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND b.label IS NOT NULL),
positives AS (SELECT * FROM near WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN near n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

_TOPK_SQL = f"""
WITH {_vectors_sql(1024)}
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) AS rank, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": _JACCARD_SQL, "op5_quality_rules": _QUALITY_SQL, "op11_tandem_runs": _RUNS_SQL, "op12_hard_negatives": _NEGATIVES_SQL, "op13_metric_topk": _TOPK_SQL,
}
