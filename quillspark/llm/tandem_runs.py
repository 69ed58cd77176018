"""Runs of repeated words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a longest stretch of words with a smallest period q, of ``least_words`` words and ``least_periods`` periods at least. Per batch of texts:

* Only stretches that are covered by windows of words occurring twice in their text can hold a run; the rest is left out by one sort of window
  hashes (a run of n words and period q repeats windows of n - q words).
* The stretches' suffix tree is kept as a suffix array over names of all factors of lengths that are powers of two (prefix doubling): a place in
  the tree is a length and an interval of suffixes, found by binary search with two comparisons a step; longest common extensions, forwards and
  backwards, go down the powers.
* The Lempel-Ziv blocks come from the longest earlier factor of every position. For every block and period the extensions around its two
  borders give the leftmost-covering squares; those with a power as a root are left out.
* Suffix-link walks complete the vocabulary: the link of a leaf is the leaf of the next position, so a walk goes along its leaf's text as long as
  that continues the square, and ends where the next walk of the same stretch begins (a marked place). Rotations that a walk's own text no longer
  shows have a leftmost occurrence of their own, which another covering square reaches.
* Every place of the vocabulary is located: its interval has all its occurrences. Squares of one period at neighbouring positions merge
  into runs.

All texts of a batch are worked on together in numpy, in linear space and in time n log n; nothing is shuffled and every text is taken whole.

``tandem_runs`` returns each row's runs and its words without the repeats: a word goes if a run has it behind its first period.

Defined results: a null text, or one without words, has no runs and an empty rest. Words are ``[^\\x20\\x09-\\x0D]+`` and equal if their 64-bit
hashes are. Repeated rows each get a row. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.texts import Pieces, Slice, mix, slices, utf8, windows

LEAST_WORDS, LEAST_PERIODS = 24, 3
RUNS = "array<struct<start:long,length:long,period:long>>"


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each number of the ranges start, start + 1, ... belongs to, and the numbers."""
    of = np.repeat(np.arange(len(starts)), counts)
    return of, np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(of))


class SuffixTree:
    """Of symbols whose equal factors all lie within one stretch; every stretch ends with a symbol of its own."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        while self.names[-1].max() + 1 < self.n:
            last, step = self.names[-1].astype(np.int64), 1 << (len(self.names) - 1)
            behind = np.zeros(self.n, np.int64)
            behind[:-step] = last[step:] + 1
            self.names.append(np.unique(last * (self.n + 1) + behind, return_inverse=True)[1].astype(np.int32))
        self.rank = self.names[-1]
        self.suffix = np.argsort(self.rank, kind="stable")

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest factor that begins at both i and j, which differ."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            out += (self.names[k][i + out] == self.names[k][j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest factor that ends at both i and j, which differ; 0 at -1."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            here = (a >= 0) & (b >= 0)
            out += (here & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def earlier(self) -> np.ndarray:
        """Length of the longest factor of each position that begins at an earlier one too."""
        rank, suffix = self.rank.tolist(), self.suffix.tolist()
        # Neighbours in the suffix array, with the positions from the last on taken out.
        after, before = [*range(1, self.n + 1), 0], [-1, *range(self.n)]
        low, high = [0] * self.n, [0] * self.n
        for i in range(self.n - 1, -1, -1):
            r = rank[i]
            b, a = before[r], after[r]
            low[i] = suffix[b] if b >= 0 else -1
            high[i] = suffix[a] if a < self.n else -1
            after[b], before[a] = a, b  # -1 and n are the spare places
        out = np.zeros(self.n, np.int64)
        for side in (np.array(low), np.array(high)):
            at = np.flatnonzero(side >= 0)
            out[at] = np.maximum(out[at], self.ahead(at, side[at]))
        return out

    def place(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with the factor of that length at ``at``."""
        power = np.frexp(length.astype(np.float64))[1] - 1
        flat, rest = np.concatenate(self.names), length - (1 << power)
        first, second = flat[power * self.n + at], flat[power * self.n + at + rest]

        def same(rank: np.ndarray) -> np.ndarray:
            s = self.suffix[rank]
            # A factor whose first power is the same ends before its stretch does.
            return (flat[power * self.n + s] == first) & (flat[power * self.n + np.minimum(s + rest, self.n - 1)] == second)

        own = self.rank[at].astype(np.int64)
        low, lowest, high, highest = np.zeros_like(own), own.copy(), own.copy(), np.full_like(own, self.n - 1)
        while (low < lowest).any():
            middle = (low + lowest) >> 1
            yes = same(middle)
            lowest, low = np.where(yes, middle, lowest), np.where(yes, low, np.minimum(middle + 1, lowest))
        while (high < highest).any():
            middle = (high + highest + 1) >> 1
            yes = same(middle)
            high, highest = np.where(yes, middle, high), np.where(yes, highest, np.maximum(middle - 1, high))
        return low, high + 1


def blocks(earlier: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and stretch of the Lempel-Ziv blocks; ``stretches`` has the stretches' first positions and the end of the last."""
    step, starts = np.maximum(earlier, 1).tolist(), []
    for a, b in zip(stretches[:-1].tolist(), (stretches[1:] - 1).tolist(), strict=True):
        while a < b:
            starts.append(a)
            a += step[a]
    starts = np.array(starts, np.int64)
    of = np.searchsorted(stretches, starts, "right") - 1
    ends = np.minimum(starts + np.maximum(earlier[starts], 1), stretches[of + 1] - 1)
    return starts, ends, of


def covering(tree: SuffixTree, stretches: np.ndarray, most_period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the leftmost-covering squares, of a period up to the stretch's greatest."""
    start, end, of = blocks(tree.earlier(), stretches)
    size, most = end - start, most_period[of]
    # Squares around a block's end: both halves meet it, the first in the block.
    inner = np.flatnonzero(end < stretches[of + 1] - 1)
    b, k = ranges(np.ones(len(inner), np.int64), np.minimum(size[inner], most[inner]))
    b = inner[b]
    at = end[b]
    ahead, behind = tree.ahead(at, at - k), tree.behind(at - 1, at - k - 1)
    fine = (ahead + behind >= k) & (ahead > 0)
    starts, periods = [np.maximum(at - k - behind, at - 2 * k + 1)[fine]], [k[fine]]
    # Squares around a block's start, with their middle in the block.
    following = np.zeros(len(start), np.int64)
    following[:-1] = np.where(of[1:] == of[:-1], size[1:], 0)
    reach = np.minimum(np.minimum(size + following, most), stretches[of + 1] - 2 - start)
    b, k = ranges(np.ones(len(start), np.int64), np.maximum(reach, 0))
    at = start[b]
    ahead, behind = tree.ahead(at, at + k), tree.behind(at - 1, at + k - 1)
    left = np.maximum(at - behind, at - k + 1)
    fine = (ahead + behind >= k) & (ahead > 0) & (left + k <= end[b])
    return np.concatenate([*starts, left[fine]]), np.concatenate([*periods, k[fine]])


def rooted(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a square's root is no power of a shorter factor."""
    out, rest = np.ones(len(start), bool), period.copy()
    least = np.arange(int(period.max(initial=1)) + 1)  # least prime factor
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, len(least), p)] = p
    while (rest > 1).any():
        at = np.flatnonzero(rest > 1)
        prime = least[rest[at]]
        part = period[at] // prime
        out[at] &= tree.ahead(start[at], start[at] + part) < period[at] - part
        rest[at] //= prime
    return out


def find_runs(symbols: np.ndarray, stretches: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by period and start. ``symbols`` has an own symbol at the end of each stretch."""
    tree = SuffixTree(symbols)
    most_period = (np.diff(stretches) - 1) // least_periods
    start, period = covering(tree, stretches, most_period)
    kept = rooted(tree, start, period)
    start, period = start[kept], period[kept]
    # Walks: along the text from each covering square, up to the next one of the same stretch of squares.
    last = start + tree.ahead(start, start + period) - period
    order = np.lexsort((start, last, period))
    start, period, last = start[order], period[order], last[order]
    marked = np.append((period[1:] == period[:-1]) & (last[1:] == last[:-1]), False)
    steps = np.where(marked, np.append(start[1:], 0) - start, last - start + 1)
    walk, square = ranges(start, steps)
    period = period[walk]
    # The vocabulary: every place of the tree once.
    power = np.frexp(2.0 * period)[1] - 1
    flat = np.concatenate(tree.names)
    names = np.stack([period, flat[power * tree.n + square], flat[power * tree.n + square + 2 * period - (1 << power)]])
    first = np.unique(names, axis=1, return_index=True)[1] if names.shape[1] else np.empty(0, np.int64)
    low, high = tree.place(square[first], 2 * period[first])
    of, suffix = ranges(low, high - low)
    at, period = tree.suffix[suffix], period[first][of]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    begins = np.ones(len(at), bool)
    begins[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(begins)
    start, period, length = at[begin], period[begin], np.diff(np.append(begin, len(at))) + 2 * period[begin] - 1
    long = length >= np.maximum(least_words, least_periods * period)
    return start[long], length[long], period[long]


def runs_of(s: Slice, w: Pieces, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (counted over the slice), length and period of all runs of a slice's texts, by start and period."""
    none = (np.empty(0, np.int64),) * 3
    hashes = s.hashes(w)
    at, value = windows(hashes, w.rows, max(1, least_words - least_words // least_periods))
    value = value ^ mix(w.rows[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    if not twice.any():
        return none
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + max(1, least_words - least_words // least_periods), -1)
    inside = np.cumsum(edge[:-1]) > 0
    begins = inside & (np.append(True, ~inside[:-1]) | np.append(True, w.rows[1:] != w.rows[:-1]))
    word = np.flatnonzero(inside)
    stretch = np.cumsum(begins)[word] - 1
    size = np.bincount(stretch)
    kept = size[stretch] >= least_words
    word, stretch = word[kept], stretch[kept]
    if not len(word):
        return none
    stretch = np.cumsum(np.append(True, stretch[1:] != stretch[:-1])) - 1
    n = int(stretch[-1]) + 1
    place = np.arange(len(word)) + stretch  # one more for the own symbol at the end of each stretch
    known, number = np.unique(hashes[word], return_inverse=True)
    symbols = np.arange(len(word) + n, dtype=np.int64) + np.int64(n) * len(known)
    symbols[place] = stretch * len(known) + number
    words = np.full(len(symbols), -1, np.int64)
    words[place] = word
    stretches = np.append(place[np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))], len(symbols))
    start, length, period = find_runs(symbols, stretches, least_words, least_periods)
    start = words[start]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(least_words: int, least_periods: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                s = Slice(data, offsets, a, b)
                w = s.words()
                start, length, period = runs_of(s, w, least_words, least_periods)
                edge = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                # The kept words' bytes, each with a space behind it.
                size = w.ends[kept] - w.starts[kept] + 1
                _, byte = ranges(w.starts[kept], size)
                text = s.data[np.minimum(byte, max(0, len(s.data) - 1))]
                ends = np.cumsum(size)
                text[ends - 1] = 32
                upto = np.append(0, ends)[np.searchsorted(w.rows[kept], np.arange(b - a + 1))]
                raw = text.tobytes()
                rest = [raw[x : max(x, y - 1)].decode() for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                row = w.rows[start]
                runs = pa.StructArray.from_arrays([pa.array(start - w.first[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(rest, pa.string())], names=["id", "runs", "collapsed"])

    return run


def tandem_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The id, the runs (start and length in words, period; by start and period) and the collapsed text of every row of df.
    ``least_periods`` is 3 or more, or 2 for all repeats."""
    if least_periods < 2 or least_words < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_collapsed(least_words, least_periods), f"id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of several the first by start, then period. Null if there is none."""
    more = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(runs, F.lit(None).cast(RUNS[6:-1]), lambda a, x: F.when(a.isNull() | more(a, x), x).otherwise(a))


def runs_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the strongest run and digests of the rows of tandem_runs."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def looped_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's id and text, with the words of a tenth of the texts put in a loop: of an id whose hash h = crc32(id) is divisible by 10, the words
    from the g % n th on repeat the first 1 + (n - g % n) div (3 + g % 8) of them, where g = h div 10 and n is the number of words."""
    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"), F.crc32(F.col(id_col).cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.expr("h div 10"), F.greatest(F.size("words"), F.lit(1))
    rows = rows.withColumn("a", g % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    looped = F.array_join(F.transform("words", lambda w, i: F.get("words", at(i))), " ")
    return rows.select(id_col, F.when(F.col("h") % 10 == 0, looped).otherwise(F.col("text")).alias("text"))
