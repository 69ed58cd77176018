"""A corpus pipeline of the llm operators: toxic documents go, one document of each near-duplicate class stays, documents
with benchmark passages go, personal data is redacted, and what is left is encoded as pieces.

Each stage takes (spark, docs, sf_dir), docs having at least doc_id, text and n_chars, and returns a DataFrame: all but the last
with the columns of docs. The defined results of the operators hold (nulls, empty and repeated rows, empty tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.decontaminate import keep_uncontaminated
from quillspark.llm.files import tokenizer_file
from quillspark.llm.jaccard_join import keep_one_of_each
from quillspark.llm.pieces import encode_pieces
from quillspark.llm.pii import fit_pii, redact
from quillspark.llm.toxicity import fit_toxicity, keep_clean
from quillspark.session import materialize, ship_package


#: Rows of the batches that stages read, so that many stages, one after another, leave little in the workers' memory.
BATCH_ROWS = "2000"


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_clean(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return redact(docs, fit_pii(docs), length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode_pieces(docs, tokenizer_file("piece_bpe_32k.model")).withColumn("n_pieces", F.size("pieces").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("pieces", encode),
]

#: No stage but the second can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
