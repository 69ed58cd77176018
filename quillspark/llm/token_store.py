"""Content-addressed store of token ids.

``write_store`` encodes whole texts, cuts each document's id stream into chunks where a rolling hash of the last WINDOW
ids says so, and writes

* ``chunks``: every distinct chunk once, keyed by the BLAKE2b digest of its packed ids;
* ``recipes``: in ascending id order, a document's chunk keys, id count, offset in its part and Merkle root;
* ``manifest``: per part, its offset in the id stream and the Merkle root of its documents.

``read_store`` reads these files back and verifies them: each chunk against its key, each document against its root, and
each part against the manifest. ``documents_ids`` rebuilds the id lists themselves.

The corpus's ids are shuffled once, to keep each chunk once. Reading back moves only a digest of each chunk: the CRC of a
document follows from its chunks' CRCs and lengths.

A text's ids are put together from those of its words where the tokenizer's file says that this is the same: its normalizer,
pre-tokenizer, model and special tokens must be as stated in SEPARABLE. With any other file whole texts are encoded, more slowly.

Defined results: a null or empty text has the end id alone; null ids come first; rows with equal ids are ordered by
content and each gets its own stretch; an empty table gives empty files. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.texts import Pieces, Slice, slices, utf8
from quillspark.llm.wordcache import WordTable, stretches
from quillspark.session import drop_path

#: A cut needs WINDOW ids before it; a chunk has 2**CUT_BITS more on average, and MOST_IDS at most.
WINDOW, CUT_BITS, MOST_IDS = 16, 8, 4096
KEY_BYTES = 16
#: Words whose ids a worker remembers, of about 60 bytes each.
MOST_WORDS = 1_000_000
#: Signs behind a word that are told from it.
LONGEST_TAIL = 8
#: New words that the tokenizer gets as one input, and in one call.
LINE_WORDS, BLOCK_WORDS = 100, 4_000
#: Bytes of text whose distinct words are looked up together.
SLICE_BYTES = 1 << 20
#: The codec of staged and stored chunks: packed ids gain little from more effort.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Documents under one inner node of a part's Merkle tree.
FANOUT = 1024
_U = np.uint64
# What a tokenizer's file says if white space, and a comma or full stop after a letter, keep words apart, and
# case does not matter outside special tokens, which all begin with SPECIAL.
SEPARABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
SPECIAL = "<|"


@lru_cache(2)
def is_separable(path: str) -> bool:
    """Whether the texts' ids are their words' ids."""
    said = json.loads(Path(path).read_text("utf-8"))
    model = said["model"]
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    return plain and all(said.get(k) == v for k, v in SEPARABLE.items()) and all(t["content"].startswith(SPECIAL) for t in said.get("added_tokens", []))


def packed_kind(path: str) -> np.dtype:
    """What packed ids are."""
    return np.dtype("<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_whole(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, and where the texts begin and end."""
    kind = packed_kind(path)
    parts = [np.array([*x.ids, end_id], kind) for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    return np.concatenate([np.empty(0, kind), *parts]), np.concatenate([[0], np.cumsum(list(map(len, parts)), dtype=np.int64)])


@lru_cache(2)
def _encoder(path: str) -> tuple[WordTable, int]:
    """A word table over a separable tokenizer, and the bytes of a packed id.

    The normalizer turns white space into spaces and the pre-tokenizer drops them, so a text's ids are its words' ids.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer, kind = _tokenizer(path), packed_kind(path)
    plain = lambda w: tokenizer.encode(w, add_special_tokens=False).ids
    bar = plain("|")
    # Words of small letters in normal form need no normalizer, and are one piece for the pre-tokenizer, whose last token
    # alone has the end mark; so many go in as one line. Only where the tokenizer's own answers agree.
    letters = Tokenizer.from_file(path)
    letters.normalizer = None
    letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    is_end = np.zeros(1 << 8 * kind.itemsize if kind.itemsize == 2 else tokenizer.get_vocab_size(), bool)
    is_end[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    trial = ["hello", "straße", "élan", "a", "antidisestablishmentarianism", "日本語"]
    own = [letters.encode(w, add_special_tokens=False).ids for w in trial]
    agree = own == list(map(plain, trial)) and all(is_end[ids].sum() == 1 and is_end[ids[-1]] for ids in own)

    def lines(using: Tokenizer, words: list[bytes], between: bytes, after: bytes) -> np.ndarray:
        joined = [(between.join(words[i : i + LINE_WORDS]) + after).decode() for i in range(0, len(words), LINE_WORDS)]
        return np.concatenate([np.empty(0, kind), *(np.array(x.ids, kind) for x in using.encode_batch_fast(joined, add_special_tokens=False))])

    def is_simple(word: bytes) -> bool:
        w = word.decode()
        return w.isalpha() and w == w.lower() and is_normalized("NFC", w)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words go in lines, kept apart by their end marks or by bars: an input's cost is then paid once a line."""
        flats, counts = [np.empty(0, kind)], [np.empty(0, np.int64)]
        for at in range(0, len(words), BLOCK_WORDS):
            block = words[at : at + BLOCK_WORDS]
            sizes = np.array(list(map(len, block)))
            small = np.logical_and.reduceat(_SMALL[np.frombuffer(b"".join(block), np.uint8)], np.cumsum(sizes) - sizes)
            how = ["letters" if agree and (s or is_simple(w)) else "alone" if b"|" in w else "bars" for w, s in zip(block, small.tolist())]
            of = {k: [i for i, h in enumerate(how) if h == k] for k in ("letters", "bars", "alone")}
            n, begin, parts, total = np.empty(len(block), np.int64), np.empty(len(block), np.int64), [], 0
            for k, places in of.items():
                if not places:
                    continue
                own = [block[i] for i in places]
                if k == "letters":
                    flat = lines(letters, own, b" ", b"")
                    ends = np.flatnonzero(is_end[flat]) + 1
                    starts = np.append(0, ends[:-1])
                elif k == "bars":
                    flat = lines(tokenizer, own, b" | ", b" |")
                    ends = np.flatnonzero(flat == bar[0]) if len(bar) == 1 else np.empty(0, np.int64)
                    starts = np.append(0, ends[:-1] + 1)
                else:
                    each = [np.array(plain(w.decode()), kind) for w in own]
                    flat, ends = np.concatenate(each), np.cumsum(list(map(len, each)))
                    starts = np.append(0, ends[:-1])
                if len(ends) != len(places):
                    raise ValueError("the tokenizer didn't keep the words of a line apart")
                n[places], begin[places] = ends - starts, total + starts
                parts.append(flat)
                total += len(flat)
            flats.append(stretches(np.concatenate(parts), begin, n))
            counts.append(n)
        return np.concatenate(flats), np.concatenate(counts)

    return WordTable(encode, kind, MOST_WORDS), kind.itemsize


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20240501).integers(0, 1 << 63, 1 << 16, dtype=_U)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind WINDOW ids whose rolling hash says so."""
    if len(ids) < WINDOW:
        return np.empty(0, np.int64)
    h = _gear()[ids & 0xFFFF]
    for width in (1, 2, 4, 8):  # doubling: h[i] covers ids i .. i + 2 * width - 1
        h = h[:-width] * _U(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[width:]
    return np.flatnonzero(h >> _U(64 - CUT_BITS) == 0) + WINDOW


def cuts(n: int, marked: list[int]) -> list[int]:
    """Where the chunks of a document of n ids end, marked being its marks. A mark fewer than WINDOW ids into the document, which
    looks at ids of another one, is never taken; so chunks depend on the document's ids alone."""
    out, last = [], 0
    for at in marked:
        while at - last > MOST_IDS:
            last += MOST_IDS
            out.append(last)
        if at - last >= WINDOW:
            out.append(at)
            last = at
    while n - last > MOST_IDS:
        last += MOST_IDS
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a leaf without a partner moves up as it is."""
    level = leaves or [b"\0" * KEY_BYTES]
    while len(level) > 1:
        pairs = [hashlib.blake2b(level[i] + level[i + 1], digest_size=KEY_BYTES).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def _key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=KEY_BYTES).digest()


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_SMALL = np.array([97 <= b <= 122 for b in range(256)])
#: What the pre-tokenizer keeps together and apart from letters. Without the signs of special tokens, which it doesn't see.
_SIGN = np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in "<|>" for b in range(256)])


def _words(s: Slice) -> Pieces:
    """Words, up to LONGEST_TAIL signs after a letter at the end being a word of their own: the pre-tokenizer cuts there too."""
    w = s.words()
    tails = w.ends.copy()  # where the signs begin
    at = np.arange(len(tails))
    for _ in range(LONGEST_TAIL):
        at = at[tails[at] - 1 > w.starts[at]]
        at = at[_SIGN[s.data[tails[at] - 1]]]
        tails[at] -= 1
    cut = np.flatnonzero((tails < w.ends) & _LETTER[s.data[tails - 1]])
    return Pieces(np.insert(w.starts, cut + 1, tails[cut]), np.insert(w.ends, cut, tails[cut]), s.bounds)


def encode_rows(data: np.ndarray, offsets: np.ndarray, begin: int, end: int, cache: WordTable, kind: np.dtype, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each with the end id, and where the rows begin and end. Each distinct word of the slice is looked up once; numpy puts the ids in place."""
    raw = data[offsets[begin] : offsets[end]]
    if b"<|" not in raw.tobytes():  # special tokens are told by their case, all else is lowered by the tokenizer anyway
        raw = _LOWER[raw]
    s = Slice(raw, offsets[begin : end + 1] - offsets[begin], 0, end - begin)
    w = _words(s)
    hashes = s.hashes(w)
    order = np.argsort(hashes)
    new = np.append(True, np.diff(hashes[order]) != 0)[: len(order)]
    first, inverse = order[new], np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    flat, begins, counts = cache.of(raw, w.starts[first], w.ends[first], hashes[first])
    n = counts[inverse]
    ids = stretches(flat, begins[inverse], n)
    row_ends = np.concatenate([[0], np.cumsum(n)])[w.first[1:]]
    return np.insert(ids, row_ends, end_id), np.concatenate([[0], row_ends + np.arange(1, len(row_ends) + 1)])


def _encoded(tokenizer: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, cache = packed_kind(tokenizer), _encoder(tokenizer)[0] if is_separable(tokenizer) else None
        width = kind.itemsize
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                counts, roots, keys, chunks, ends = [], [], [], [], [0]
                if cache is None:
                    ids, bounds = encode_whole([data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)], tokenizer, end_id)
                else:
                    ids, bounds = encode_rows(data, offsets, a, b, cache, kind, end_id)
                packed, marked = ids.tobytes(), marks(ids)
                firsts = np.searchsorted(marked, bounds, "right").tolist()
                for row, (begin, end) in enumerate(pairwise(bounds.tolist())):
                    at, own = begin, []
                    for cut in cuts(end - begin, (marked[firsts[row] : firsts[row + 1]] - begin).tolist()):
                        chunks.append(packed[at * width : (begin + cut) * width])
                        own.append(_key(chunks[-1]))
                        at = begin + cut
                    counts.append(end - begin)
                    roots.append(merkle(own))
                    keys += own
                    ends.append(len(keys))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(keys, pa.binary())), pa.ListArray.from_arrays(ends, pa.array(chunks, pa.binary())),
                    ],
                    names=["id", "n_tokens", "root", "keys", "chunks"],
                )

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row number and id offset within the part; rows come in order."""
    row, at = 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = at + np.cumsum(n)
        place = pa.array(np.arange(row, row + len(n), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, place, pa.array(ends - n)], names=[*batch.schema.names, "row", "local_start"])
        row, at = row + len(n), int(ends[-1]) if len(n) else at


def _manifest(recipes: DataFrame) -> DataFrame:
    """Merkle roots upwards: FANOUT documents a node, then the nodes of a part."""
    node = F.floor(F.col("row") / FANOUT)
    ordered = lambda by, what: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda s: s[what]), ""), 256)
    nodes = recipes.withColumn("hex", F.hex("root")).groupBy("part", node.alias("node")).agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), ordered("row", "hex").alias("hash")
    )
    return nodes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"), ordered("node", "hash").alias("root"))


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode df's texts with the tokenizers file ``tokenizer`` and write the store to ``path``, a shared folder."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, root binary, keys array<binary>, chunks array<binary>"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    staged = f"{path}/staged"
    rows.mapInArrow(_encoded(tokenizer, end_id), schema).write.options(**PACKED).parquet(staged)
    encoded = spark.read.schema(schema).parquet(staged)
    pairs = encoded.select(F.explode(F.arrays_zip("keys", "chunks")).alias("c")).select(F.col("c.keys").alias("key"), F.col("c.chunks").alias("ids"))
    pairs.groupBy("key").agg(F.first("ids").alias("ids")).write.options(**PACKED).parquet(f"{path}/chunks")
    recipes = encoded.select("id", "n_tokens", "root", "keys").repartitionByRange("id", "root").sortWithinPartitions("id", "root")
    recipes = recipes.mapInArrow(_numbered, f"id {kind}, n_tokens long, root binary, keys array<binary>, row long, local_start long")
    recipes.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    drop_path(spark, staged)
    _manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


@lru_cache(1)
def _crc_shifts() -> np.ndarray:
    """[k, byte, value]: what appending 2**k zero bytes does to each byte of a CRC-32 (its polynomial, reflected)."""
    columns = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit appended, by bit of the CRC

    def apply(cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for i in range(32):
            out ^= np.where(x >> np.uint32(i) & 1, cols[i], 0).astype(np.uint32)
        return out

    for _ in range(3):
        columns = apply(columns, columns)
    tables = []
    for _ in range(48):
        tables.append([apply(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])
        columns = apply(columns, columns)
    return np.array(tables)


def crc_of_parts(crcs: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of parts (beginning at ``starts``) from the parts' CRCs and byte lengths."""
    shifts = _crc_shifts()
    ends = np.append(starts[1:], len(crcs))
    total = np.cumsum(lengths)
    after = np.repeat(total[ends - 1], ends - starts) - total
    out = crcs.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        on = np.flatnonzero(after >> k & 1)
        x = out[on]
        out[on] = shifts[k][0][x & 255] ^ shifts[k][1][x >> 8 & 255] ^ shifts[k][2][x >> 16 & 255] ^ shifts[k][3][x >> 24]
    return np.bitwise_xor.reduceat(out, starts)


def _chunk_digests(width: int) -> Callable:
    """Of each stored chunk: whether it has its key, ids and CRC of them as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, crcs = batch.column(0).to_pylist(), [], []
            for key, chunk in zip(keys, batch.column(1).to_pylist()):
                if _key(chunk) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                ids = np.frombuffer(chunk, f"<u{width}")
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["key", "size", "crc"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, n = batch.column("parts"), batch.column("n_tokens").to_numpy()
        flat, starts = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets.to_numpy()[0]
        size, crc = flat.field("size").to_numpy(), flat.field("crc").to_numpy()
        if (np.add.reduceat(size, starts) != n).any():
            raise ValueError("a recipe's chunks don't add up to its count of ids")
        keys, ends = flat.field("key").to_pylist(), np.append(starts[1:], len(flat))
        for root, a, b in zip(batch.column("root").to_pylist(), starts, ends):
            if merkle(keys[a:b]) != root:
                raise ValueError("a recipe doesn't have its Merkle root")
        whole = crc_of_parts(crc, 4 * size, starts).astype(np.int64)
        keep = ["id", "start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(whole), pa.array(ends - starts)], names=[*keep, "ids_crc32", "n_chunks"])


def _offsets(spark: SparkSession, path: str) -> DataFrame:
    """The parts' offsets in the id stream. A part is a whole task's rows, so this is a small table."""
    from pyspark.sql import Window

    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))


def _recipe_chunks(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes").join(_offsets(spark, path), "part")
    return recipes.select("id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "root", F.posexplode("keys").alias("seq", "key"))


def read_store(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Of every document, from the files alone: id, start, n_tokens, ids_crc32, n_chunks. Damage raises an error."""
    stored = _manifest(spark.read.parquet(f"{path}/recipes")).select("part", "root")
    wrong = stored.join(spark.read.parquet(f"{path}/manifest").select("part", F.col("root").alias("said")), "part", "full").where("not(root <=> said)")
    if wrong.limit(1).count():
        raise ValueError("the manifest doesn't have its parts' Merkle roots")
    width = packed_kind(tokenizer).itemsize
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_chunk_digests(width), "key binary, size long, crc long")
    kind = spark.read.parquet(f"{path}/recipes").schema["id"].dataType.simpleString()
    # A document's start is its own: every document has the end id at least.
    rows = _recipe_chunks(spark, path).join(chunks, "key", "left").groupBy("id", "start", "n_tokens", "root").agg(
        F.array_sort(F.collect_list(F.struct("seq", "key", "size", "crc"))).alias("parts")
    )
    return rows.mapInArrow(_verified, f"id {kind}, start long, n_tokens long, ids_crc32 long, n_chunks long")


def documents_ids(spark: SparkSession, path: str) -> DataFrame:
    """id, start and packed ids (little-endian, as stored) of every document, rebuilt from its chunks."""
    rows = _recipe_chunks(spark, path).join(spark.read.parquet(f"{path}/chunks"), "key").groupBy("id", "start")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ids"))), lambda s: s["ids"])
    return rows.agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
