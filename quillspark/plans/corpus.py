"""The driver's tables as corpus views: records, chunks, groups, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.text import MEANINGFUL, normalized_lines
from quillspark.operators.metadata import MetadataDef
from quillspark.operators.requests import Corpus
from quillspark.operators.search import may_match, searchable
from quillspark.plans.registry import Tables

#: SQL of the same views.
LINES_SQL = r"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))"
CHUNKS_SQL = f"""
norm AS (SELECT doc_id AS document_id, lang, source, {LINES_SQL} AS lines FROM documents),
chunks AS (
  SELECT document_id, lang, source, lines[1] AS title, generate_subscripts(lines, 1) - 1 AS chunk_index, unnest(lines) AS chunk_text FROM norm)
"""
SNAPSHOT_SQL = """
base AS (SELECT concat(source, '/', doc_id, '.', lang) AS path, md5(text) AS sha, n_chars AS bytes FROM documents WHERE doc_id % 10 <> 0),
target AS (SELECT concat(source, '/', doc_id, '.', lang) AS path,
  CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, '+')) ELSE md5(text) END AS sha, n_chars AS bytes FROM documents WHERE doc_id % 10 <> 1)
"""


def chunks_of(docs: DataFrame) -> DataFrame:
    """The meaningful lines of documents, with the first one as title and a hash of the record."""
    lines = docs.select(F.col("doc_id").alias("document_id"), "lang", "source", F.md5("text").alias("record_hash"), normalized_lines(F.col("text")).alias("lines"))
    return lines.select("document_id", "lang", "source", "record_hash", F.element_at("lines", 1).alias("title"), F.posexplode("lines").alias("chunk_index", "chunk_text"))


def chunks(t: Tables) -> DataFrame:
    return chunks_of(t.documents).drop("record_hash")


#: Chunks for readers of English: all originals and the translations of other languages, every third of which is out of date.
SEARCHABLE_SQL = """
searchable AS (
  SELECT document_id, chunk_index, title, chunk_text, 'original' AS content_locale, true AS is_fallback FROM chunks
  UNION ALL SELECT document_id, chunk_index, concat('In English: ', title), concat(chunk_text, ' (translated)'), 'en', false FROM chunks WHERE lang <> 'en' AND document_id % 3 <> 0)
"""


def documents(t: Tables, phrase: str | None = None) -> DataFrame:
    """Documents with their lines. With a phrase, those whose text and translation can't match it are left out before their lines are looked at."""
    docs = t.documents
    if phrase is not None:
        docs = docs.where(may_match(F.concat(F.lit("In English: "), "text", F.lit(" (translated)")), phrase))
    rows = docs.select(F.col("doc_id").alias("document_id"), "lang", "source", F.md5("text").alias("record_hash"), normalized_lines(F.col("text")).alias("lines"), "n_chars")
    return rows.withColumn("title", F.try_element_at("lines", F.lit(1)))


def translations(docs: DataFrame) -> DataFrame:
    source = F.when(F.col("document_id") % 3 == 0, F.md5("record_hash")).otherwise(F.col("record_hash"))
    return docs.where("lang <> 'en'").select(
        "document_id", F.concat(F.lit("In English: "), "title").alias("title"), F.transform("lines", lambda x: F.concat(x, F.lit(" (translated)"))).alias("lines"),
        F.lit("en").alias("target_locale"), source.alias("source_record_hash"),
    )


def searchable_chunks(t: Tables, phrase: str) -> DataFrame:
    """What may match the phrase."""
    docs = documents(t, phrase)
    return searchable(docs, translations(docs), "en", phrase)


def corpus(t: Tables, generation: int = 1) -> Corpus:
    """The documents as a corpus: published on a day of 2024 by their id, with their language and length as metadata; vectors of first chunks."""
    metadata = F.to_json(F.struct(F.col("lang"), F.col("n_chars").alias("size")))

    def records(phrase: str | None = None) -> tuple[DataFrame, DataFrame]:
        docs = documents(t, phrase).withColumn("published_at", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(document_id % 366 as int))")).withColumn("metadata_json", metadata)
        return docs, translations(docs)

    eligible = t.documents.where(F.col("text").rlike(MEANINGFUL)).select(F.col("doc_id").alias("vec_id"))
    vectors = t.embeddings.join(eligible, "vec_id", "left_semi").select("vec_id", F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    return Corpus(*records(), vectors, "tables", (MetadataDef("lang", "keyword"), MetadataDef("size", "integer")), generation, records)


def _files(docs: DataFrame, sha) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return docs.select(path.alias("path"), sha.alias("sha"), F.col("n_chars").alias("bytes"))


def baseline(t: Tables) -> DataFrame:
    return _files(t.documents.where("doc_id % 10 <> 0"), F.md5("text"))


def target(t: Tables) -> DataFrame:
    sha = F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("+")))).otherwise(F.md5("text"))
    return _files(t.documents.where("doc_id % 10 <> 1"), sha)
