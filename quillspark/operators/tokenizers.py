"""Tokenizers by name: plain words, and files that are pinned by the SHA-256 of their bytes.

A name is ``words``, ``ranks@<sha256>`` (a byte-pair file of lines of a base64 token and its rank) or ``hf@<sha256>`` (a JSON file of the tokenizers library).
Files lie in a folder of artifacts as <sha256>.tiktoken or .json, or are sent by SparkContext.addFile; one that is missing, or whose bytes have another
hash, is an error, never another tokenizer. A tokenizer maps a text to the extents of its tokens in characters; a token that ends within a
character counts as ending before it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

Encode = Callable[[str], list[tuple[int, int]]]
#: How texts are cut into pieces that are merged by themselves (the pattern of public byte-pair vocabularies).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NAME = re.compile(r"(ranks|hf)@([0-9a-f]{64})")
SUFFIXES = {"ranks": ".tiktoken", "hf": ".json"}


def word_tokens(text: str) -> list[tuple[int, int]]:
    """Words and single other characters."""
    return [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the piece's tokens end: of neighbouring parts, those whose join has the least rank are joined first, the first of equal ones before others."""
    if piece in ranks:
        return [len(piece)]
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
            continue  # one of the parts has been joined meanwhile
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [end[i] for i in range(n) if alive[i]]


def rank_tokens(data: bytes, pattern: str = PIECES) -> Encode:
    """The tokenizer of a rank file's bytes."""
    import regex

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a rank file must have every byte")
    cut, known = regex.compile(pattern), lru_cache(100_000)(lambda piece: tuple(merged(piece, ranks)))

    def encode(text: str) -> list[tuple[int, int]]:
        out, begin = [], 0
        for m in cut.finditer(text):
            raw, at = m[0].encode("utf-8", "replace"), m.start()
            ends = known(raw)
            if len(raw) == len(m[0]):
                places = [at + e for e in ends]
            else:
                starts = [k for k, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]  # of the characters
                count, places = 0, []
                for e in ends:
                    while starts[count + 1 if count + 1 < len(starts) else count] <= e and count + 1 < len(starts):
                        count += 1
                    places.append(at + count)
            for p in places:
                out.append((begin, p))
                begin = p
        return out

    return encode


def json_tokens(data: bytes) -> Encode:
    """The tokenizer of a JSON file's bytes; no special tokens, no truncation."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).offsets


def artifact(kind: str, sha256: str, folder: str | None) -> bytes:
    """The bytes of a pinned file, from the folder or from what Spark has sent."""
    name = sha256 + SUFFIXES[kind]
    path = Path(folder, name) if folder is not None else None
    if path is None or not path.is_file():
        from pyspark import SparkFiles

        path = Path(SparkFiles.get(name))
    if not path.is_file():
        raise ValueError(f"the tokenizer artifact {name} isn't there")
    data = path.read_bytes()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"the tokenizer artifact {name} has other bytes")
    return data


@lru_cache(4)
def tokenizer_of(name: str, folder: str | None = None) -> Encode:
    """The tokenizer of a name; an unknown name is an error."""
    if name == "words":
        return word_tokens
    m = NAME.fullmatch(name)
    if not m:
        raise ValueError(f"no tokenizer has the name {name!r}")
    return (rank_tokens if m[1] == "ranks" else json_tokens)(artifact(m[1], m[2], folder))
