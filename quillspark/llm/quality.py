"""Quality rules by repetition coverage.

``quality_rules(df)`` measures, for every whole text, how many of its characters lie inside n-word windows that occur
more than once in the text (rolling hashes, several n) and inside lines that repeat an earlier line, and keeps the text
if no share is above its limit. All counts come from one vectorised pass over the text's bytes; nothing is shuffled.

Defined results: a null or empty text has all counts 0, fails the base rule (fewer than MIN_WORDS words) and is not
kept. Repeated rows each get a row. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.texts import IS_SPACE, IS_LEAD, Slice, slices, utf8, windows

#: Largest share of a text's word characters inside repeated n-word windows, by n.
WINDOW_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (*(f"dup_{n}gram_share" for n in WINDOW_LIMITS), "dup_line_share")


def repeated(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their row."""
    order = np.lexsort((rows, values))
    r, v = rows[order], values[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twice = np.zeros(len(rows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def later(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values equal an earlier one of their row."""
    order = np.lexsort((np.arange(len(rows)), rows, values))
    r, v = rows[order], values[order]
    out = np.zeros(len(rows), bool)
    out[order[1:][(r[1:] == r[:-1]) & (v[1:] == v[:-1])]] = True
    return out


def measure(s: Slice) -> dict[str, np.ndarray]:
    w = s.words()
    h, chars, n_rows = s.hashes(w), s.points(w), w.n_rows
    by_row = lambda pieces, weight: np.bincount(pieces.rows, weight, n_rows).astype(np.int64)
    out = {"n_words": w.per_row, "word_chars": by_row(w, chars), "n_symbols": s.counts(IS_SYMBOL[s.data])}
    # A window can only repeat where its first words do: the shortest length sorts all windows, longer ones what is left.
    at, value = windows(h, w.rows, min(WINDOW_LIMITS))
    candidates = at[repeated(w.rows[at], value)]
    for n in sorted({*WINDOW_LIMITS, REPEAT_WINDOW}):
        at, value = windows(h, w.rows, n)
        among = np.isin(at, candidates, assume_unique=True)
        at, value = at[among], value[among]
        at = at[repeated(w.rows[at], value)]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        inside = np.cumsum(cover[:-1]) > 0
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = by_row(w, inside)
        if n in WINDOW_LIMITS:
            out[f"dup_{n}gram_share"] = by_row(w, inside * chars) / np.maximum(out["word_chars"], 1)
    lines = s.lines()
    words_before = np.searchsorted(w.starts, np.stack([lines.starts, lines.ends]))
    filled = words_before[1] > words_before[0]
    dup = np.zeros(len(filled), bool)
    dup[filled] = later(lines.rows[filled], s.hashes(lines)[filled])
    out["n_dup_lines"] = by_row(lines, dup)
    points = s.points(lines)
    out["dup_line_share"] = by_row(lines, dup * points) / np.maximum(by_row(lines, filled * points), 1)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        parts = [measure(Slice(data, offsets, a, b)) for a, b in slices(offsets)]
        if parts:
            got = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in COUNTS]
            got += [pa.array(np.concatenate([p[k] for p in parts]).astype(np.float64)) for k in SHARES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *got], names=["id", *COUNTS, *SHARES])


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, counts, shares, base_failed and kept."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join([*(f"{k} long" for k in COUNTS), *(f"{k} double" for k in SHARES)])
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measured, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    fine = F.col("dup_line_share") <= LINE_LIMIT
    for n, limit in WINDOW_LIMITS.items():
        fine &= F.col(f"dup_{n}gram_share") <= limit
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine).withColumnRenamed("id", id_col)
