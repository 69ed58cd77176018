"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of hashed SHINGLE-word shingles. Equal texts form one class, so only classes are compared:

1. Every class gets HASHES MinHash values. Classes that agree on all ROWS values of one of the BANDS bands are candidates.
2. A candidate pair's values are compared CHECK at a time; after n of them with m equal, the pair is dropped if the
   posterior probability that its similarity reaches the threshold, P(J >= t | m of n) under a uniform prior, is below
   ``TOLERANCE``. The components of the pairs that survive are groups: no link leaves its group.
3. Inside each group pairs are compared in the same way again, and those that survive are verified exactly, by counting
   common shingles.

No task holds a whole bucket or group. Its classes are dealt into blocks, and each pair of blocks goes to one task; the pairs
of a group go to successive tasks. In a group, blocks hold classes of about one size, and only blocks are paired whose sizes
allow the threshold. Pairs never leave a task: out come each class's number of links and a spanning forest of the links.
Components of those are the classes of near-duplicates.

A pair at the threshold escapes all bands with probability (1 - t**ROWS)**BANDS, 7e-5 for t = 0.8, and the pruning with
about 1e-5; more similar pairs far more rarely. What is reported is exact.

Defined results: null and empty texts, and texts without a word, have no shingles, no links, and a class of their own; a
text of fewer than SHINGLE words has one shingle. A row's n_links counts the other rows, copies included, whose similarity
reaches the threshold. class_id is the least id of the class, null if it has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, comb, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.components import components
from quillspark.llm.texts import Slice, mix, shingles, slices, utf8
from quillspark.session import materialize

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
CHECK, TOLERANCE = 20, 1e-4
#: Classes of a block, at least where there are as many and at most, and bytes of shingles at most (but for a single class).
SMALL_BLOCK, LARGE_BLOCK, BLOCK_BYTES = 64, 4096, 8 << 20
#: Classes on a side of the tiles in which a pair of blocks is compared; survivors of a tile up to which they are counted one by one.
TILE, FEW = 512, 2000
#: Pairs whose values are compared at a time, and cells of the matrix of classes by shingles.
MOST_PAIRS, MOST_CELLS = 100_000, 1 << 22
#: Rows that may be broadcast: of some 60 bytes each.
BROADCAST_ROWS = 200_000
_U = np.uint64


@lru_cache(1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7).integers(0, 1 << 63, (2, HASHES), dtype=_U)
    return draw[0] | _U(1), draw[1]


def signatures(rows: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    """[row, hash] least values; rows (sorted) without a shingle keep the largest value."""
    out = np.full((n_rows, HASHES), 0xFFFFFFFF, np.uint32)
    a, b = _family()
    at = 0
    while at < len(rows):
        end = int(np.searchsorted(rows, rows[min(len(rows), at + 50_000) - 1], "right"))
        own, x = rows[at:end], values[at:end]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        for k in range(HASHES):
            out[own[starts], k] = np.minimum.reduceat(((x * a[k] + b[k]) >> _U(32)).astype(np.uint32), starts)
        at = end
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in slices(offsets):
            rows, values = shingles(Slice(data, offsets, a, b), SHINGLE)
            some = np.bincount(rows, minlength=b - a) > 0
            sig = signatures(rows, values, b - a)
            packed = pa.array([sig[i].tobytes() if some[i] else None for i in range(b - a)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), packed], names=["id", "key", "sig"])


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = 0, CHECK, 2 * CHECK ...: the least m with P(J >= threshold | m of n equal) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(0, HASHES + 1, CHECK):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray | None, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs (a, b) the pruning leaves; a pair that an earlier band than ``band`` has too is left to that one."""
    need = least_matches(threshold, tolerance)
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step in range(HASHES // CHECK):
        same = sig[a[alive], step * CHECK : (step + 1) * CHECK] == sig[b[alive], step * CHECK : (step + 1) * CHECK]
        equal[alive] += same.sum(axis=1)
        keep = equal[alive] >= need[step + 1]
        if band is not None:
            whole = same.reshape(len(alive), CHECK // ROWS, ROWS).all(axis=2)
            bands = step * (CHECK // ROWS) + np.arange(CHECK // ROWS)
            keep &= ~(whole & (bands < band[alive][:, None])).any(axis=1)
        alive = alive[keep]
    return alive


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Of n nodes in ascending order: the least node of each one's component, by the pairs (a, b) and an earlier answer."""
    label = np.arange(n) if label is None else label
    a, b = label[a], label[b]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal leading columns (rows come sorted by them), with where the runs begin."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole(table: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in range(n_keys):
            codes = table.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        if last or not len(starts):
            return table, starts, table.slice(0, 0)
        return table.slice(0, starts[-1]), starts[:-1], table.slice(starts[-1])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        table, starts, rest = whole(pa.Table.from_batches(held), False)
        if len(starts):
            yield table, starts
        held, size = rest.to_batches(), rest.num_rows
    if size:
        table, starts, _ = whole(pa.Table.from_batches(held), True)
        yield table, starts


def tiles(n_low: int, n_high: int, within: bool) -> Iterator[tuple[slice, slice]]:
    """Pieces of the pairs to compare: of the low side with the high one, or of the low side with itself."""
    for a in range(0, n_low, TILE):
        for b in range(a if within else 0, n_low if within else n_high, TILE):
            yield slice(a, a + TILE), slice(b, b + TILE)


def tile_pairs(a: np.ndarray, b: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows a and b; within a side only those of a lesser and a greater row."""
    x, y = np.repeat(a, len(b)), np.tile(b, len(a))
    return (x[x < y], y[x < y]) if within else (x, y)


def _sides(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of the low and the high side of each run, and whether it is a block with itself."""
    role, within = table.column("role").to_numpy(), table.column("within").to_numpy(zero_copy_only=False)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
        cut = s + int(np.searchsorted(role[s:e], 1))
        if within[s] or s < cut < e:
            yield np.arange(s, cut), np.arange(cut, e), bool(within[s])


def _signatures_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(table.num_rows, HASHES)


class Forest:
    """Components of n rows, pairs being kept until there are many."""

    def __init__(self, n: int):
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.held.append((x, y))
        self.size += len(x)
        if self.size >= MOST_PAIRS:
            self.labels()

    def labels(self) -> np.ndarray:
        if self.held:
            x, y = map(np.concatenate, zip(*self.held))
            self.label, self.held, self.size = forest(len(self.label), x, y, self.label), [], 0
        return self.label


def _forests(table: pa.Table, starts: np.ndarray, linked: Callable, at_once: int, counted: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What links rows of each run: (own, label), an edge being needed from each row of which they differ to its label.

    A block's links with itself come from its own run. So in a run of two blocks only the least rows of each block's components need
    an edge, and edges do not grow with the number of blocks. linked(x, y) gives the places of the pairs that are linked, of some
    ``at_once`` pairs or a tile; ``counted`` is told of those that the run is there for.
    """
    own, every = Forest(table.num_rows), Forest(table.num_rows)
    held: list[tuple[np.ndarray, np.ndarray, bool]] = []

    def settle() -> None:
        x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        inner = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
        held.clear()
        left = linked(x, y)
        x, y, inner = x[left], y[left], inner[left]
        every.add(x, y)
        own.add(x[inner], y[inner])
        if counted:
            counted(x[~inner], y[~inner])

    size = 0
    for low, high, within in _sides(table, starts):
        for first, second, itself, inner in [(low, low, True, False)] if within else [(low, low, True, True), (high, high, True, True), (low, high, False, False)]:
            for a, b in tiles(len(first), len(second), itself):
                x, y = tile_pairs(first[a], second[b], itself)
                held.append((x, y, inner))
                size += len(x)
                if size >= at_once:
                    settle()
                    size = 0
    if held:
        settle()
    mine, label = own.labels(), every.labels().copy()
    inner = np.flatnonzero(mine != np.arange(len(mine)))  # said by the blocks' own runs
    label[inner] = mine[inner]
    return mine, label


def _pruned(threshold: float, tolerance: float) -> Callable:
    """Rows (of, part, ordinal, within, role, key, band, sig), sorted, to (key, root): a forest of the surviving pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(batches, 3):
            sig, band = _signatures_of(table), table.column("band").to_numpy()

            def survivors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return surviving(sig, x, y, band[x], threshold, tolerance)

            own, label = _forests(table, starts, survivors, MOST_PAIRS)
            at = np.flatnonzero(own != label)
            keys = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), keys.take(pa.array(label[at]))], names=["u", "v"])

    return run


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """[i, j] common elements of the sorted sets a[i] and b[j], exactly."""
    flat = np.concatenate([*a, *b])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [*map(len, a), *map(len, b)])
    number = np.cumsum(times > 1) - 1
    some = times[code] > 1
    owner, code = owner[some], number[code[some]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    shared, width = int((times > 1).sum()), max(1, MOST_CELLS // (len(a) + len(b)))
    out = np.zeros((len(a), len(b)))
    for c in range(0, shared, width):
        x, y = np.searchsorted(code, [c, c + width])
        cells = np.zeros((len(a) + len(b), min(width, shared - c)), np.float32)
        cells[owner[x:y], code[x:y] - c] = 1
        out += cells[: len(a)] @ cells[len(a) :].T
    return out


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common elements of the pairs (x, y)."""
    if len(x) <= FEW:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())], np.float64)
    a, p = np.unique(x, return_inverse=True)
    b, q = np.unique(y, return_inverse=True)
    return common_counts([sets[i] for i in a], [sets[j] for j in b])[p, q]


def _verified(threshold: float, tolerance: float) -> Callable:
    """Rows (of, part, ordinal, within, role, key, n, sig, shingles), sorted, to (key, root or null, links) of the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(batches, 3):
            sig, copies = _signatures_of(table), table.column("n").to_numpy()
            sets = [np.frombuffer(x, _U) for x in table.column("shingles").to_pylist()]
            size = np.array(list(map(len, sets)), np.float64)
            links = np.zeros(table.num_rows, np.int64)

            def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                left = surviving(sig, x, y, None, threshold, tolerance)
                common = _common(sets, x[left], y[left])
                return left[common / (size[x[left]] + size[y[left]] - common) >= threshold]

            def counted(x: np.ndarray, y: np.ndarray) -> None:
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])

            own, label = _forests(table, starts, linked, 1, counted)
            at = np.flatnonzero((links > 0) | (own != label))
            to = pa.array(label[at], mask=own[at] == label[at])
            keys = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), keys.take(to), pa.array(links[at])], names=["u", "v", "links"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in slices(offsets):
            rows, values = shingles(Slice(data, offsets, a, b), SHINGLE)
            ends = np.searchsorted(rows, np.arange(b - a + 1))
            packed = [np.unique(values[ends[i] : ends[i + 1]]).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(packed, pa.binary()), *(c.slice(a, b - a) for c in batch.columns[2:])],
                names=["key", "shingles", *batch.schema.names[2:]],
            )


def _in_block_pairs(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Deal the rows of df (of, part, key ...) to pairs of blocks, sorted in their tasks by pair, side and key.

    parts has (of, part, size, bytes) for each part of an ``of`` in df. A part's rows are dealt over its blocks by a hash of their
    keys. Blocks of a part are paired with each other and with those of the next part. Pairs of one ``of`` have successive
    ordinals and go to successive tasks.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ceil(sqrt(tasks))  # so many blocks make pairs for half the tasks: every further one adds edges for each row
    blocks = F.greatest(F.ceil(F.col("size") / LARGE_BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.least(F.ceil(F.col("size") / SMALL_BLOCK), F.lit(spread))).cast("long")
    sized = parts.select("of", "part", blocks.alias("blocks"))
    beside = lambda by, name: sized.select("of", (F.col("part") + by).alias("part"), F.col("blocks").alias(name))
    sized = sized.join(beside(1, "before"), ["of", "part"], "left").join(beside(-1, "after"), ["of", "part"], "left").na.fill(0, ["before", "after"])
    sized = materialize(sized.where("blocks > 1 or before > 0 or after > 0"), "blocks")  # the others are one block without a neighbour
    sized = F.broadcast(sized) if sized.count() <= BROADCAST_ROWS else sized
    dealt = df.join(sized, ["of", "part"], "left").na.fill(1, ["blocks"]).na.fill(0, ["before", "after"]).withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")))

    def pair(part: Column, ordinal: Column, role: Column, within: Column) -> Column:
        return F.struct(part.alias("part"), ordinal.alias("ordinal"), role.cast("int").alias("role"), within.alias("within"))

    def own(other: Column) -> Column:
        low, high = F.least(F.col("side"), other), F.greatest(F.col("side"), other)
        return pair(F.col("part"), F.floor(low * F.col("blocks") - low * (low - 1) / 2) + high - low, F.col("side") > other, F.col("side") == other)

    def cross(part: Column, low_blocks: Column, low: Column, high_blocks: Column, high: Column, role: int) -> Column:
        return pair(part, F.floor(low_blocks * (low_blocks + 1) / 2) + low * high_blocks + high, F.lit(role), F.lit(False))

    def each(n: Column, f) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)).otherwise(F.slice(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long")), f), 1, 0))

    pairs = F.concat(
        each(F.col("blocks"), own),
        each(F.col("after"), lambda k: cross(F.col("part"), F.col("blocks"), F.col("side"), F.col("after"), k, 0)),
        each(F.col("before"), lambda k: cross(F.col("part") - 1, F.col("before"), k, F.col("blocks"), F.col("side"), 1)),
    )
    rest = [c for c in df.columns if c not in ("of", "part")]
    out = dealt.select("of", F.explode(pairs).alias("to"), *rest).select("of", "to.part", "to.ordinal", "to.within", "to.role", *rest)
    task = F.pmod(F.xxhash64("of", "part") + F.col("ordinal"), F.lit(tasks)).cast("int")
    return out.repartitionById(tasks, task).sortWithinPartitions("of", "part", "ordinal", "role", "key")


def jaccard_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row for each row of df: id, class_id, n_links."""
    out = _classed(df, id_col, text_col, threshold, tolerance)
    return out.select(F.col("id").alias(id_col), F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), "n_links")


def _classed(df: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> DataFrame:
    """id, key (of the text), in_class (a class of others too), class_id, class_key, n_links of each row of df.

    The row of a class whose id is class_id and whose key is class_key stands for it.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), text.alias("text"))
    signed = materialize(rows.mapInArrow(_signed, f"id {kind}, key binary, sig binary"), "signatures")
    classes = signed.where("sig is not null").groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("n"), F.first("sig").alias("sig"))

    band = F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)])).alias("band", "of")
    banded = classes.select("key", band)
    crowded = banded.groupBy("of").agg(F.count("*").alias("size")).where("size > 1").select("of", F.lit(0).cast("long").alias("part"), "size", F.lit(0).alias("bytes"))
    candidates = banded.join(crowded.select("of", "part"), "of").join(classes.select("key", "sig"), "key").select("of", "part", "key", "band", "sig")
    pruned = _in_block_pairs(candidates, crowded).mapInArrow(_pruned(threshold, tolerance), "u binary, v binary")
    groups = materialize(components(pruned), "groups")

    members = groups.select(F.col("node").alias("key"), F.col("component").alias("of"))
    members = materialize(members.join(classes, "key"), "members")
    n_members = members.count()
    named = members.select(F.col("key").alias("member"), "of", "n", "sig", "least_id")
    mine = rows.join(F.broadcast(named) if n_members <= BROADCAST_ROWS else named, F.expr("key = member and id <=> least_id"))
    sets = materialize(mine.select("key", "text", "of", "n", "sig").mapInArrow(_shingled, "key binary, shingles binary, of binary, n long, sig binary"), "sets")
    if sets.count() > n_members:  # rows that come again with the same id and text
        sets = materialize(sets.dropDuplicates(["key"]), "sets")
    # Sizes of one part are within a factor of 1 / threshold and a little more, so sets that may be linked are in the same or the next part.
    part = F.floor(F.log(F.octet_length("shingles") / 8) / F.lit(log(1 / (threshold * 0.999)))).cast("long")
    sets = sets.withColumn("part", part)
    parts = sets.groupBy("of", "part").agg(F.count("*").alias("size"), F.sum(F.octet_length("shingles")).alias("bytes"))
    dealt = _in_block_pairs(sets.select("of", "part", "key", "n", "sig", "shingles"), parts)
    links = materialize(dealt.mapInArrow(_verified(threshold, tolerance), "u binary, v binary, links long"), "links")

    linked = components(links.select("u", "v"))
    leasts = members.select(F.col("key").alias("node"), "least_id")
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", F.col("node").alias("key"))).alias("first")
    ids = linked.join(leasts, "node").groupBy("component").agg(first)
    counted = links.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    classed = linked.join(ids, "component").select(F.col("node").alias("key"), F.col("first.least_id").alias("class_id"), F.col("first.key").alias("class_key"), F.lit(True).alias("linked"))
    known = classes.where("n > 1").select("key", "n", "least_id").join(counted.join(classed, "key", "full"), "key", "full")
    known = known.select(
        "key", (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("least_id")).alias("class_id"),
        F.coalesce("class_key", "key").alias("class_key"), F.lit(True).alias("known"),
    )
    out = signed.select("id", "key", F.col("sig").isNotNull().alias("some")).join(known, "key", "left")
    own = F.coalesce(F.col("known") & F.col("some"), F.lit(False))
    return out.select("id", "key", own.alias("in_class"), "class_id", "class_key", F.when(own, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, whole, of which one of each class stays: one of its least id (of no id only if none has any) and, of several texts
    with that id, of the least digest. Rows whose text has no word all stay."""
    found = _classed(df, id_col, text_col, threshold, TOLERANCE).where("in_class")
    found = materialize(found.groupBy("id", "key").agg(F.count("*").alias("n"), F.first(F.expr("id <=> class_id and key = class_key")).alias("stays")), "found")
    key = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))

    def of(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("id").alias("_known_id"), F.col("key").alias("_known_key"))
        which = F.broadcast(which) if which.count() <= BROADCAST_ROWS else which
        return rows.join(which, rows[id_col].eqNullSafe(which["_known_id"]) & (key == which["_known_key"]), how)

    kept = of(df, found.where("not stays"), "left_anti")
    again = found.where("stays and n > 1")
    if not again.limit(1).count():
        return kept
    name = "_key"
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    once = of(kept, again, "left_semi").withColumn(name, key)
    return of(kept, again, "left_anti").unionByName(once.dropDuplicates([id_col, name]).drop(name))
