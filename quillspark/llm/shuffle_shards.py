"""Sharding by a two-pass external shuffle.

Pass one scatters the records by seeded hashes. A rendezvous hash of the id gives the shard (the shard with the largest
hash of (id, shard) wins, so one more shard takes records only into itself). A hash of the whole record gives one of the
shard's buckets, of which there are as many as keep a bucket near ``bucket_bytes``; so the records of one id are dealt over
the buckets of its shard. Records that are equal in every column and so many that they would fill a bucket are dealt by
their place in the input, which changes nothing but which of the equal ones comes where. Pass two loads one bucket at a time,
puts it in canonical order, shuffles it by Fisher-Yates with a generator seeded by (seed, shard, bucket), and writes it. The
order of a shard is bucket after bucket, so a record's slot is its place in the bucket behind the earlier buckets' records.

The law is ``key``: the id and the number of shards decide. The whole records are shuffled once, to as many tasks as hold
TASK_BYTES each; reading back adds a table of the buckets' offsets, which is broadcast if it is small. df is read three
times and must give the same rows each time, as a table does.

Defined results: ids are of any type; a null id counts as the hash of its text; a null text has size 1; rows with equal ids
share a shard; an empty table gives no shards. Files keep the records as one column ``record``, so no column of theirs can
clash; read_shards adds _shard and _slot, or, if the records have such a column, that name with more underscores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Bytes of records that a bucket should have: a task holds a few copies of one bucket. And those a task of pass two should read.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 64 << 20
#: Rows of the table of offsets, of some 30 bytes, up to which it is broadcast.
BROADCAST_ROWS = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def key_of(row_id: Column, text: Column) -> Column:
    """Hash of the id; of the text if it is null."""
    return F.coalesce(F.xxhash64(row_id.cast("string")) + F.when(row_id.isNull(), None).otherwise(0), F.xxhash64(F.lit("no id"), text))


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of (key, shard)."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(n_shards)]))
    return best["j"]


def record_hash(df: DataFrame) -> Column:
    """Hash of all columns of a row; the numbers between them tell which one a null is in. Maps are hashed as JSON."""
    parts = [x for k, f in enumerate(df.schema) for x in (F.lit(k), F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`"))]
    return F.xxhash64(*parts)


def record_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: those of strings and binaries, of nested values those of their JSON, 8 for any other."""

    def of(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(F.col(f"`{f.name}`"))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(f"`{f.name}`")))
        return F.lit(8)

    return sum((F.coalesce(of(f), F.lit(0)).cast("long") for f in df.schema), F.lit(1).cast("long"))


def added_name(name: str, columns: list[str]) -> str:
    """The name, with as many more underscores as none of the columns has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def _shuffled(seed: int) -> Callable:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        shard, bucket = (k.as_py() for k in key)
        table = table.take(pa.array(np.lexsort([table.column(c).to_numpy() for c in ("tie", "hash", "key")])))
        order = np.random.default_rng([seed, shard, bucket]).permutation(table.num_rows)  # a Fisher-Yates shuffle
        table = table.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))
        yield from table.select(["shard", "bucket", "place", "record"]).to_batches(max_chunksize=2000)

    return run


def write_shards(
    df: DataFrame, path: str, n_shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write df's records, shuffled, to ``path``/shard=N/; each has its bucket and its place there."""
    text = F.col(text_col)
    keyed = df.select(key_of(F.col(id_col), text).alias("key"), record_hash(df).alias("hash"), record_bytes(df).alias("size"), F.struct(*df.columns).alias("record"))
    copies = keyed.groupBy("key", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))  # no text is shuffled
    total = copies.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, ceil(total / n_shards / bucket_bytes))
    # Equal records that fill half a bucket: no more of them than twice the buckets.
    hot = copies.where((F.col("n") > 1) & (F.col("bytes") * 2 > bucket_bytes)).select(F.col("key").alias("hot_key"), F.col("hash").alias("hot_hash"), F.lit(True).alias("is_hot"))
    if buckets > 1 and 2 * buckets * n_shards <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    dealt = keyed.withColumn("at", F.monotonically_increasing_id()).join(hot, F.expr("key = hot_key and hash = hot_hash"), "left")
    tie = F.when(F.col("is_hot"), F.xxhash64("at")).otherwise(F.xxhash64(F.lit(seed + 2), "hash"))
    placed = dealt.select(
        shard_of(F.col("key"), n_shards, seed).alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 1), "key", "hash", F.when(F.col("is_hot"), F.col("at"))), F.lit(buckets)).cast("int").alias("bucket"),
        "key", "hash", tie.alias("tie"), "record",
    )
    tasks = min(buckets * n_shards, max(ceil(total / TASK_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = T.StructType([*(placed.schema[c] for c in ("shard", "bucket")), T.StructField("place", T.LongType()), placed.schema["record"]])
    out = placed.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").applyInArrow(_shuffled(seed), schema)
    if not total:  # a partitioned write of no rows leaves no file that tells the columns
        df.sparkSession.createDataFrame([], schema).drop("shard").write.parquet(f"{path}/shard=0")
        return
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The records with _shard and _slot, gapless from 0 in each shard."""
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # a row for each bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    columns = rows.schema["record"].dataType.names
    placed = rows.join(offsets, ["shard", "bucket"])
    return placed.select(
        *[F.col("record")[c].alias(c) for c in columns], F.col("shard").alias(added_name("_shard", columns)), (F.col("before") + F.col("place")).alias(added_name("_slot", columns))
    )


def shard_digest(rows: DataFrame, n_shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of read_shards' rows."""
    shard, slot = rows.columns[-2:]
    text = F.col(text_col)
    return rows.select(
        id_col,
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(shard).cast("int").alias("shard"),
        F.col(slot).cast("long").alias("slot"),
        shard_of(key_of(F.col(id_col), text), n_shards + 1, seed).cast("int").alias("grown_shard"),
    )
