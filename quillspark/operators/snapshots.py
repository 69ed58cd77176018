"""Snapshots of files: plan, diff, reuse, retention; and change-detecting writes over plain tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def compare(base: DataFrame, target: DataFrame) -> DataFrame:
    """path and status (added, deleted, modified, unchanged) of a full outer join on path."""
    both = base.select("path", F.col("sha").alias("old"), F.lit(True).alias("was")).join(target.select("path", F.col("sha").alias("new"), F.lit(True).alias("is")), "path", "full")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return both.select("path", "old", "new", status.alias("status"))


def diffs(files: DataFrame, generations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base, target, path, status) of every pair's changed paths. files has generation, path, sha; generations generation, status. A pair counts only if both its
    generations are ready or superseded; unchanged paths are left out."""
    usable = generations.where(F.col("status").isin("ready", "superseded")).select("generation")
    both = pairs.join(usable.withColumnRenamed("generation", "base"), "base", "left_semi").join(usable.withColumnRenamed("generation", "target"), "target", "left_semi")
    side = lambda c, sha: both.join(files.select(F.col("generation").alias(c), "path", F.col("sha").alias(sha)), c).select("base", "target", "path", sha, F.lit(True).alias(f"_{sha}"))
    rows = side("base", "old").join(side("target", "new"), ["base", "target", "path"], "full")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return rows.select("base", "target", "path", status.alias("status")).where("status is not null")


def incremental_plan(base: DataFrame, target: DataFrame) -> DataFrame:
    action = F.when(F.col("status") == "unchanged", "seed").when(F.col("status") == "deleted", "delete").otherwise("fetch")
    return compare(base, target).select("path", action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], hash_col: str) -> tuple[DataFrame, DataFrame]:
    """The next table (a full rewrite) and, for each incoming row, whether it changed anything."""
    old = current.select(*key, F.col(hash_col).alias("_old"), F.lit(True).alias("_known"))
    changes = incoming.join(old, key, "left").withColumn("changed", F.col("_known").isNull() | ~F.col("_old").eqNullSafe(F.col(hash_col)))
    kept = current.join(incoming.select(*key), key, "left_anti")
    return kept.unionByName(incoming), changes.drop("_old", "_known")


def append_idempotent(existing: DataFrame, incoming: DataFrame, key: list[str], body: str) -> DataFrame:
    """Incoming rows with status: new, replayed (same key and body) or conflict (same key, other body)."""
    old = existing.select(*key, F.col(body).alias("_body"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_body").eqNullSafe(F.col(body)), "replayed").otherwise("conflict")
    return incoming.join(old, key, "left").withColumn("status", status).drop("_body", "_known")


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def deduplicate_content(df: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Each row's stored_id: the least id with the same content key."""
    return df.withColumn("stored_id", F.min(id_col).over(Window.partitionBy(*key)))


def audit_documents(documents: DataFrame, chunks: DataFrame, hash_of) -> DataFrame:
    """(document_id, verdict) of documents (document_id, record_hash and what hash_of needs) by their chunks (document_id, chunk_index,
    chunk_text): zero_chunks, non_contiguous_or_duplicate, blank_body, hash_mismatch or eligible. hash_of(body) is the record hash of the
    normalised body, over the documents' columns."""
    from quillspark.functions.text import normalize_body

    n, low, high = F.count("*"), F.min("chunk_index"), F.max("chunk_index")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda s: s["chunk_text"])
    whole = chunks.groupBy("document_id").agg(((low == 0) & (high == n - 1) & (F.count_distinct("chunk_index") == n)).alias("_whole"), F.array_join(ordered, "\n").alias("_raw"))
    rows = documents.join(whole, "document_id", "left").withColumn("_body", normalize_body(F.col("_raw")))
    verdict = (
        F.when(F.col("_whole").isNull(), "zero_chunks").when(~F.col("_whole"), "non_contiguous_or_duplicate").when(F.trim("_body") == "", "blank_body")
        .when(hash_of(F.col("_body")) == F.col("record_hash"), "eligible").otherwise("hash_mismatch")
    )
    return rows.select("document_id", verdict.alias("verdict"))


def replace_owned(old: DataFrame, new: DataFrame, owner: str, key: list[str]) -> DataFrame:
    """The next table: every owner in ``new`` loses its old rows and gets its new ones; of new rows with one key the first by all columns
    stays, and keys that other owners' rows hold are left to them."""
    kept = old.join(new.select(owner).distinct(), owner, "left_anti")
    order = [F.col(c) for c in new.columns if c not in key]
    return kept.unionByName(latest(new, key, *order).join(kept.select(*key), key, "left_anti"))


def pending_purges(tombstones: DataFrame, now: Column, retry_after: str, limit: int) -> DataFrame:
    """The deleted entities to purge next: never tried or tried long enough ago, the oldest try first, then the oldest deletion."""
    due = F.col("purged_at").isNull() & (F.col("tried_at").isNull() | (F.col("tried_at") <= now - F.expr(f"interval {retry_after}")))
    return tombstones.where(due).orderBy(F.col("tried_at").asc_nulls_first(), "deleted_at", "id").limit(limit)


def capped_digest(content: Column, most_bytes: int) -> Column:
    """Struct of sha256 and size of a binary; of one over the limit only the size."""
    size = F.octet_length(content)
    return F.struct(F.when(size <= most_bytes, F.sha2(content, 256)).alias("sha256"), size.cast("long").alias("size"), (size <= most_bytes).alias("fits"))


def within_quota(usage: DataFrame, quota: float, provider: str, ts: str, amount: str, order: str, is_lifetime: Column | None = None) -> DataFrame:
    """``usage`` with its bucket and ``accepted``: amounts add up by provider and calendar month (without end where is_lifetime holds), in
    order; one is refused, and not added, if it would exceed the quota, but for the first of its bucket.

    Each decision depends on those before, so a bucket's rows pass one task in order; only its sum is held.
    """
    month = F.date_format(ts, "yyyy-MM")
    rows = usage.withColumn("bucket", month if is_lifetime is None else F.when(is_lifetime, "lifetime").otherwise(month))
    ordered = rows.repartition(provider, "bucket").sortWithinPartitions(provider, "bucket", ts, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = None, 0.0
        for batch in batches:
            accepted = []
            for key, x in zip(zip(batch[provider], batch["bucket"]), batch[amount]):
                is_first = key != own
                own, total = key, 0.0 if is_first else total
                accepted.append(is_first or total + x <= quota)
                total += x if accepted[-1] else 0.0
            yield batch.assign(accepted=accepted)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", accepted boolean"
    return ordered.mapInPandas(run, schema)


def reassemble(segments: DataFrame, translated: DataFrame) -> DataFrame:
    """(id, body, first_missing) from segments (id, segment_id, text, suffix, translatable) and translations (id, segment_id, translation):
    segments in the order of their ids, each with its suffix. A translatable segment without translation leaves no body and is named."""
    rows = segments.join(translated, ["id", "segment_id"], "left")
    said = F.when(F.col("translatable"), F.col("translation")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("segment_id", said.alias("said"), "suffix")))
    missing = F.min(F.when(F.col("translatable") & F.col("translation").isNull(), F.col("segment_id")))
    body = F.array_join(F.transform(ordered, lambda s: F.concat(s["said"], s["suffix"])), "")
    return rows.groupBy("id").agg(F.when(missing.isNull(), body).alias("body"), missing.alias("first_missing"))
