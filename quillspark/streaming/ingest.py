"""Incremental ingest as Structured Streaming: normalise, detect changes against the table, append versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import normalize_body, normalized_lines, record_hash
from quillspark.session import has_files


def normalize(df: DataFrame) -> DataFrame:
    """Documents with title, body and record_hash."""
    lines = normalized_lines(F.col("text"))
    rows = df.withColumn("title", F.element_at(lines, 1)).withColumn("body", normalize_body(F.col("text")))
    uri = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    return rows.withColumn("record_hash", record_hash(F.col("title"), F.lit(None).cast("string"), F.col("body"), uri, F.lit("{}")))


def _write_batch(versions: str) -> Callable[[DataFrame, int], None]:
    """Append each document's changed version. A batch that comes again writes its own folder again, so replays change nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = normalize(batch).withColumn("epoch", F.lit(epoch))
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("record_hash")))).where("_rn = 1").drop("_rn")
        if has_files(spark, versions):
            # Only the batch's own documents are looked up; of the versions, two columns are read.
            known = spark.read.schema(rows.schema).parquet(versions).where(F.col("epoch") < epoch).select("doc_id", "record_hash", "epoch")
            known = known.join(rows.select("doc_id"), "doc_id", "left_semi")
        else:
            known = spark.createDataFrame([], rows.select("doc_id", "record_hash", "epoch").schema)
        latest = known.groupBy("doc_id").agg(F.max_by("record_hash", "epoch").alias("record_hash"))
        changed = rows.join(latest, ["doc_id", "record_hash"], "left_anti")
        changed.drop("epoch").write.mode("overwrite").parquet(f"{versions}/epoch={epoch}")

    return write


def ingest(spark: SparkSession, source: str, schema: str, versions: str, checkpoint: str) -> StreamingQuery:
    """Run what is new in the source folder through the pipeline; the checkpoint is the cursor."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(_write_batch(versions)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, versions: str) -> DataFrame:
    """The latest version of every document."""
    rows = spark.read.parquet(versions)
    w = Window.partitionBy("doc_id").orderBy(F.desc("epoch"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
