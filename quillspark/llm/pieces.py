"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file gives the pieces with their log scores. A file whose scores are whole numbers is one of merges, and they are
ranks, which are no log probabilities: summed, they would favour few early merges over short paths. Pieces of such a file
get the log probability of their rank r by the Zipf-Mandelbrot law, -log(r + OFFSET) less the log of the sum over all
ranks; tokenizers aren't trained here, so the law is stated, not fitted. A double-array trie (base, check, value) holds the ordinary
pieces; Viterbi keeps, for each prefix, the best sum of scores, earlier starts winning ties; a character that no piece
covers costs the least score minus UNKNOWN_PENALTY and becomes its UTF-8 bytes' pieces. Spaces become the marker U+2581,
one marker is put before a text, and decoding turns markers back into spaces and drops the first.

A text is cut where no piece can reach across (before each run of spaces and around characters of no piece), so a stretch
is encoded once per batch, all new stretches of one length together in numpy.

Defined results: a null text encodes to null, an empty one to no pieces; U+2581 in a text is a space from then on; texts
of any length are encoded whole. Repeated rows each get a row; other columns are kept out of it.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillspark.llm.texts import slices, utf8
from quillspark.llm.wordcache import WordCache

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's offset of ranks that count from 0.
OFFSET = 2.7
# Kinds of pieces in the model file.
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
#: Stretches up to this length are encoded side by side; longer ones one by one.
SIDE_BY_SIDE = 48
#: Slots of the double array looked at together for a node's children.
SEARCH = 1024


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of every id of a SentencePiece model file."""
    out = []
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0" * 4), "<f4")[0]), f.get(3, NORMAL)))
    return out


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Log probabilities as they are; ranks (whole numbers below 1) by the Zipf-Mandelbrot law."""
    if not len(scores) or (scores != np.round(scores)).any():
        return scores
    weight = 1 / (OFFSET + np.argsort(np.argsort(-scores, kind="stable")))
    return np.log(weight / weight.sum())


@dataclass
class Trie:
    """Double array: the child of state s by code c is t = base[s] + c if check[t] == s; value[t] is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, words: dict[tuple[int, ...], int]) -> Trie:
        tree: dict = {}
        for word, value in words.items():
            node = tree
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        # Nodes of many children first, while there is room; those of one child fill the holes.
        todo, order, free = [(-len(tree), 0, 0, tree)], 0, 1
        while todo:
            _, _, s, node = heapq.heappop(todo)
            codes = np.array(sorted(c for c in node if c >= 0), np.int64)
            if -1 in node:
                value[s] = node[-1]
            if not len(codes):
                continue
            at = free
            while True:
                if at + SEARCH + int(codes[-1]) >= len(check):
                    grow = len(check)
                    base, check, value = (np.concatenate([x, np.full(grow, v, np.int32)]) for x, v in ((base, 0), (check, -1), (value, -1)))
                holes = np.flatnonzero(check[at : at + SEARCH] < 0) + at
                if at == free and len(holes) < SEARCH // 16:
                    free += SEARCH  # nearly full: not searched again
                starts = holes[holes > codes[0]] - codes[0]
                fits = starts[(check[starts[:, None] + codes] < 0).all(axis=1)]
                if len(fits):
                    break
                at += SEARCH
            b = int(fits[0])
            base[s] = b
            check[b + codes] = s
            for c in codes.tolist():
                order += 1
                heapq.heappush(todo, (-len(node[c]), order, b + c, node[c]))
        spare = int(max((c for w in words for c in w), default=0)) + 1
        pad = lambda x, v: np.concatenate([x, np.full(spare, v, np.int32)])
        return cls(pad(base, 0), pad(check, -1), pad(value, -1))


@dataclass
class PieceModel:
    """What encoding and decoding need, small enough to go with a task."""

    trie: Trie
    codes: dict[str, int]
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    unknown_id: int
    unknown_score: float
    outputs: list[bytes]
    stretch: str
    width: int
    _cache: WordCache | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        pieces = read_pieces(path)
        usable = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        often = Counter(c for p in usable for c in p)
        codes = {c: k + 1 for k, c in enumerate(sorted(often, key=lambda c: (-often[c], c)))}
        byte_ids = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(p[1:-1], 16)] = i
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        outputs = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            outputs[i] = bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER_DEFINED) else b" \xe2\x81\x87 " if kind == UNKNOWN else b""
        # Cut before a run of marks unless a piece has one after another character, and at line feeds unless a piece has one.
        across = any(MARK in p.lstrip(MARK) for p in usable)
        feed = "" if any("\n" in p for p in usable) else "\\n"
        scores = np.array([p[1] for p in pieces])
        plain = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
        scores[plain] = log_scores(scores[plain])
        stretch = r"(?s:.+)" if across else rf" +[^ {feed}]*|[^ {feed}]+" + ("|\\n" if feed else "")
        return cls(
            Trie.build({tuple(codes[c] for c in p): i for p, i in usable.items()}), codes, scores,
            max(map(len, usable), default=1), byte_ids, unknown, min(scores[plain], default=0.0) - UNKNOWN_PENALTY, outputs, stretch, 2 if len(pieces) <= 1 << 16 else 4,
        )

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": None}

    @property
    def cache(self) -> WordCache:
        if self._cache is None:
            self._cache = WordCache(self.encode_stretches)
        return self._cache

    def _best_paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: [stretch, character]. For every prefix end: where its last piece starts, and its id (-1: unknown)."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, length = codes.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        unknown = self.unknown_score
        every = np.arange(n)
        for i in range(length):
            rows, state = every, np.zeros(n, np.int32)
            single = np.zeros(n, bool)
            for j in range(i, min(length, i + self.longest)):
                at = base[state] + codes[rows, j]
                ok = (codes[rows, j] > 0) & (check[at] == state)
                rows, state = rows[ok], at[ok]
                if not len(rows):
                    break
                found = value[state]
                hit = found >= 0
                r, v = rows[hit], found[hit]
                score = best[r, i] + self.scores[v]
                if j == i:
                    single[r] = True
                better = score > best[r, j + 1]
                r = r[better]
                best[r, j + 1], came[r, j + 1], piece[r, j + 1] = score[better], i, v[better]
            r = every[~single]
            score = best[r, i] + unknown
            better = score > best[r, i + 1]
            r = r[better]
            best[r, i + 1], came[r, i + 1], piece[r, i + 1] = score[better], i, -1
        return came, piece

    def _one_path(self, codes: list[int]) -> tuple[list[int], list[int]]:
        """The same for a single stretch of any length."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        length, least = len(codes), self.unknown_score
        best, came, piece = [0.0] + [-np.inf] * length, [0] * (length + 1), [-1] * (length + 1)
        for i in range(length):
            state, single = 0, False
            for j in range(i, min(length, i + self.longest)):
                at = int(base[state]) + codes[j]
                if not codes[j] or check[at] != state:
                    break
                state, v = at, int(value[at])
                if v >= 0:
                    single |= j == i
                    score = best[i] + float(self.scores[v])
                    if score > best[j + 1]:
                        best[j + 1], came[j + 1], piece[j + 1] = score, i, v
            if not single and best[i] + least > best[i + 1]:
                best[i + 1], came[i + 1], piece[i + 1] = best[i] + least, i, -1
        return came, piece

    def _ids(self, stretch: str, came, piece) -> list[int]:
        out, at = [], len(stretch)
        while at > 0:
            start, p = int(came[at]), int(piece[at])
            if p >= 0:
                out.append([p])
            else:
                own = [int(self.byte_ids[b]) for b in stretch[start:at].encode()]
                out.append(own if min(own) >= 0 else [self.unknown_id])
            at = start
        return [i for ids in reversed(out) for i in ids]

    def encode_stretches(self, stretches: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(stretches)
        by_length = defaultdict(list)
        marked = [s.replace(" ", MARK) for s in stretches]
        for k, s in enumerate(marked):
            by_length[len(s)].append(k)
        for length, own in by_length.items():
            if length <= SIDE_BY_SIDE:
                for a in range(0, len(own), 50_000):
                    part = own[a : a + 50_000]
                    codes = np.array([[self.codes.get(c, 0) for c in marked[k]] for k in part], np.int32).reshape(len(part), length)
                    came, piece = (x.tolist() for x in self._best_paths(codes))
                    for r, k in enumerate(part):
                        out[k] = np.array(self._ids(marked[k], came[r], piece[r]), f"<u{self.width}").tobytes()
            else:
                for k in own:
                    path = self._one_path([self.codes.get(c, 0) for c in marked[k]])
                    out[k] = np.array(self._ids(marked[k], *path), f"<u{self.width}").tobytes()
        return out

    def stretches(self, text: str) -> list[str]:
        return re.findall(self.stretch, " " + text.replace(MARK, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        got = self.stretches(text)
        self.cache.learn([got])
        return np.frombuffer(b"".join(map(self.cache.__getitem__, got)), f"<u{self.width}").tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.outputs.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _encoded(model: PieceModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{model.width}"
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)]
                rows = [model.stretches(t) for t in texts]
                model.cache.learn(rows)
                packed = [b"".join(map(model.cache.__getitem__, row)) for row in rows]
                ids = np.frombuffer(b"".join(packed), kind).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(p) // model.width for p in packed])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array(missing[a:b]))
                kept = [c.slice(a, b - a) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, *kept], names=["id", "pieces", *batch.schema.names[2:]])

    return run


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """id and pieces (array of ids) of every row of df, and the column ``keep`` as it is."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([keep] if keep is not None else []))
    schema = T.StructType([rows.schema[0], T.StructField("pieces", T.ArrayType(T.IntegerType())), *rows.schema[2:]])
    return rows.mapInArrow(_encoded(PieceModel.load(model_path)), schema).withColumnRenamed("id", id_col)


def _decoded(model: PieceModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            null = lists.is_null().to_numpy(zero_copy_only=False)
            texts, n, crc = [], [], []
            for i in range(len(lists)):
                own = ids[ends[i] : ends[i + 1]]
                texts.append(None if null[i] else model.decode(own.tolist()))
                n.append(len(own))
                crc.append(zlib.crc32(own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), *batch.columns[2:]],
                names=["id", "text", "n_pieces", "ids_crc32", *batch.schema.names[2:]],
            )

    return run


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", pieces_col: str = "pieces", keep: str | None = None) -> DataFrame:
    """id, text, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) of every row of df, and the column ``keep``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces"), *([keep] if keep else []))
    found = [T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_pieces", "ids_crc32"))]
    return rows.mapInArrow(_decoded(PieceModel.load(model_path)), T.StructType([rows.schema[0], *found, *rows.schema[2:]])).withColumnRenamed("id", id_col)
