"""Hard-negative mining by distributed radix selection.

An anchor's positives are its best rows of the same label; each (anchor, positive) pair has a window of scores, a share of the
positive's score up to that score, and the answer is the best rows of other labels in the window. No task ever sorts a window's
rows. Selection goes by the digits of (top of the window - score): tasks count the rows of every window by digit, the counts are
summed, the digit where the k-th row lies is located, and only rows of that digit are counted by their next digit. As soon as
few rows are left, or the last digit is known, the score bound of the window is known, and only rows at or above it are
gathered; of those, a task gives the best k of each window at most, as the ties at the bound may be any number.

Anchors are asked in blocks of ``block_rows``; a block (vectors, windows, digits so far) is bounded, goes to all tasks, and every
round of it is one pass over all rows. So nothing of unbounded size is sent to a task or the driver, and no key gathers rows.

Defined results: rows with a null id, label or vector or a null or non-finite component take no part. Shorter vectors are padded
with zeros. Rows with equal ids are never each other's positive or negative; otherwise each row stands for itself, but equal
anchor rows are asked once. An anchor without a positive, or a pair without a negative, gives no rows; a positive score below 0
has an empty window. An empty table gives no rows. Ids are whole numbers. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.vectors import Shape, matrix, scores, shape_of, whole_vectors
from quillspark.session import materialize, new_table_path

#: Anchors in a block; bits of a digit; scores that a task holds at once.
BLOCK_ROWS, DIGIT_BITS, MOST_SCORES = 2048, 8, 1 << 22
#: A window is gathered once no more than so many times k rows are at or above its bound.
FEW = 4


@dataclass
class Windows:
    """Windows of scores, the same number for each anchor: row w // per is window w's anchor. start and stop are the offsets below
    ``top`` that still count (stop excluded); floor is the lowest score that will be gathered."""

    per: int
    same_label: bool
    top: np.ndarray
    floor: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    need: np.ndarray

    @classmethod
    def over(cls, per: int, same_label: bool, low: np.ndarray, top: np.ndarray, k: int) -> Windows:
        return cls(per, same_label, top, low.copy(), np.zeros_like(top), np.maximum(top - low + 1, 0), np.full(len(top), k, np.int64))


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: Windows
    shape: Shape

    def pairs(self, batch: pa.RecordBatch, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchor, row id and score of the rows of the right kind that reach the anchor's lowest score, slice by slice."""
        step = max(1, MOST_SCORES // max(1, len(self.ids)))
        ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), self.shape)
        for a in range(0, len(ids), step):
            s = scores(self.vectors, vectors[a : a + step])
            kind = (self.labels[:, None] == labels[None, a : a + step]) == self.windows.same_label
            anchor, row = np.nonzero((s >= low[:, None]) & kind & (self.ids[:, None] != ids[None, a : a + step]))
            yield anchor, ids[a + row], s[anchor, row]


def _counted(block: Broadcast, shift: int) -> Callable:
    """Counts of the rows of each window by the digit at ``shift``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        w = b.windows
        lowest = np.where(w.stop > w.start, w.top - w.stop + 1, np.iinfo(np.int64).max).reshape(-1, w.per).min(axis=1)
        count = np.zeros(len(w.top) << DIGIT_BITS, np.int64)
        for batch in batches:
            for anchor, _, score in b.pairs(batch, lowest):
                for j in range(w.per):
                    own = anchor * w.per + j
                    offset = w.top[own] - score
                    inside = (offset >= w.start[own]) & (offset < w.stop[own])
                    digit = (offset[inside] - w.start[own[inside]]) >> shift
                    count += np.bincount((own[inside] << DIGIT_BITS) + digit, minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array((at >> DIGIT_BITS).astype(np.int32)), pa.array((at & (1 << DIGIT_BITS) - 1).astype(np.int32)), pa.array(count[at])], names=["w", "digit", "n"])

    return run


def _best(w: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each window, by score from the highest and id."""
    order = np.lexsort((ids, -score, w))
    w, ids, score = w[order], ids[order], score[order]
    kept = np.arange(len(w)) - np.searchsorted(w, w) < k
    return w[kept], ids[kept], score[kept]


def _gathered(block: Broadcast, k: int) -> Callable:
    """The best k rows of this task for each window, of those at or above the window's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        w = b.windows
        lowest = np.where(w.floor <= w.top, w.floor, np.iinfo(np.int64).max).reshape(-1, w.per).min(axis=1)
        held = (np.empty(0, np.int64),) * 3
        for batch in batches:
            for anchor, ids, score in b.pairs(batch, lowest):
                for j in range(w.per):
                    own = anchor * w.per + j
                    inside = (score >= w.floor[own]) & (score <= w.top[own])
                    held = _best(*(np.concatenate(x) for x in zip(held, (own[inside], ids[inside], score[inside]), strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2])], names=["w", "id", "score"])

    return run


def _select(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """w, id, score and place of the first k rows of each of the block's windows: radix selection of the floors, then a gathering."""
    context, w = rows.sparkSession.sparkContext, block.windows
    shift = max(0, int((w.stop - w.start).max(initial=1) - 1).bit_length() - DIGIT_BITS)
    while (w.stop > w.start).any():
        counts = rows.mapInArrow(_counted(context.broadcast(block), shift), "w int, digit int, n long").groupBy("w", "digit").agg(F.sum("n").alias("n"))
        needs = rows.sparkSession.createDataFrame(pa.table({"w": np.arange(len(w.top), dtype=np.int32), "need": w.need}))  # a row for each window of the block
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("digit"))
        reached = counts.withColumn("upto", upto).join(F.broadcast(needs), "w").where("upto >= need")
        # The digit of the k-th row; a window that isn't among them has fewer rows and is gathered whole.
        found = reached.groupBy("w").agg(F.min(F.struct("digit", "upto", "n")).alias("x")).select("w", "x.*").toArrow()
        at, digit, upto, n = (found.column(c).to_numpy() for c in ("w", "digit", "upto", "n"))
        low = w.start[at] + (digit.astype(np.int64) << shift)
        start, stop = np.zeros_like(w.start), np.zeros_like(w.stop)
        w.floor[at] = np.maximum(w.floor[at], w.top[at] - (low + (1 << shift)) + 1)
        open_ = (k - w.need[at] + upto > FEW * k) & (shift > 0)
        start[at[open_]], stop[at[open_]] = low[open_], np.minimum(low + (1 << shift), w.stop[at])[open_]
        w.need[at] -= upto - n
        w.start, w.stop = start, stop
        shift = max(0, shift - DIGIT_BITS)
    kept = rows.mapInArrow(_gathered(context.broadcast(block), k), "w int, id long, score long")
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return kept.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256,
    n_positives: int = 5, n_negatives: int = 5, low_percent: int = 80, high_percent: int = 100, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchors`` is over the columns id and label; a window is
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score."""
    spark = df.sparkSession
    own = (F.col("label") if label is None else label).cast("long").alias("label")
    rows = whole_vectors(df, id_col, vector_col, scale, own).where("label is not null")
    rows = materialize(rows.select("id", "label", "v", "length"), "vectors")
    shape, path = shape_of(rows), new_table_path(spark, "hard_negatives")
    rows = rows.select("id", "label", "v")
    asked = materialize(rows.where(anchors).distinct(), "anchors")
    n_blocks = max(1, ceil(asked.count() / block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_blocks)))
    for k in range(n_blocks):
        mine = asked.where(F.col("block") == k).orderBy("id", "label", "v").toArrow()  # block_rows rows, or a few more
        ids, labels, vectors = mine.column("id").to_numpy(), mine.column("label").to_numpy(), matrix(mine.column("v"), shape)
        reach = np.full(len(ids), int(shape.largest) + 1, np.int64)
        block = Block(ids, labels, vectors, Windows.over(1, True, -reach, reach, n_positives), shape)
        found = _select(rows, block, n_positives).toArrow()  # n_positives rows for each anchor of the block
        w, place, score, positive = (found.column(c).to_numpy() for c in ("w", "place", "score", "id"))
        top, low, known = np.full((len(ids), n_positives), -1, np.int64), np.zeros((len(ids), n_positives), np.int64), np.zeros((len(ids), n_positives), np.int64)
        at = (w, place - 1)
        top[at], low[at], known[at] = high_percent * score // 100, -(-low_percent * score // 100), positive
        block.windows = Windows.over(n_positives, False, low.reshape(-1), np.where(top < low, low - 1, top).reshape(-1), n_negatives)
        named = pa.table({"w": (w * n_positives + place - 1).astype(np.int32), "anchor_id": ids[w], "positive_id": positive, "positive_score": score})
        picked = _select(rows, block, n_negatives).join(F.broadcast(spark.createDataFrame(named)), "w")
        picked = picked.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        if n_blocks == 1:
            return picked
        picked.write.mode("append").parquet(path)
    return spark.read.schema(picked.schema).parquet(path)
