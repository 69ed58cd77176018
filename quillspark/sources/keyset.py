"""Keyset-incremental pulls and their checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def incremental_batch(df: DataFrame, ts: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The next rows by (ts, key) behind a checkpoint; None starts from the beginning."""
    if after is not None:
        at = F.lit(after[0]).cast("timestamp")
        df = df.where((F.col(ts) > at) | ((F.col(ts) == at) & (F.col(key) > F.lit(after[1]))))
    return df.orderBy(ts, key).limit(limit)


def checkpoint(df: DataFrame, source: str, ts: str, key: str) -> DataFrame:
    """The last (ts, key) of each source."""
    return df.groupBy(source).agg(F.max(F.struct(ts, key)).alias("last")).select(source, f"last.{ts}", f"last.{key}")


def upsert_checkpoints(stored: DataFrame, incoming: DataFrame, source: str, ts: str, key: str) -> DataFrame:
    """The next checkpoints: each source's later one, so that a batch that comes again moves nothing back."""
    both = stored.select(source, ts, key).unionByName(incoming.select(source, ts, key))
    return checkpoint(both, source, ts, key)
