"""Ids of words, remembered per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Words remembered at once; beyond it a cache starts anew, so memory stays bounded on any vocabulary.
MOST_WORDS = 100_000


class WordCache(dict):
    """word -> packed ids. ``encode`` maps a list of distinct words to their packed ids."""

    def __init__(self, encode: Callable[[list], Iterable[bytes]], most: int = MOST_WORDS):
        super().__init__()
        self.encode, self.most = encode, most

    def learn(self, rows: Iterable[list]) -> None:
        """Make every word of these rows present."""
        words = set().union(*rows)
        new = list(words.difference(self))
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        self.update(zip(new, self.encode(new)))


def stretches(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The elements of these stretches of ``flat``, one after another."""
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(sizes) else 0
    place = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts - (after - sizes)).astype(place), sizes) + np.arange(total, dtype=place)]


class WordTable:
    """Ids of words in flat arrays: found by the words' hashes, confirmed by their bytes. A word takes some 60 bytes, against 200 in a dict.

    ``encode`` gives the ids of distinct words, one after another, and their counts. A full table keeps the words that were asked
    for again, up to half of its room. Words of more than ``longest`` bytes aren't remembered.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, most: int, longest: int = 64):
        self.encode, self.kind, self.most, self.longest = encode, kind, most, longest
        self._set(*[np.empty(0, t) for t in (np.uint64, np.uint8, np.int32, kind, np.int32, bool)])

    def __len__(self) -> int:
        return len(self.hashes)

    def _set(self, hashes: np.ndarray, words: np.ndarray, word_sizes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray, again: np.ndarray) -> None:
        """Entries in any order: ``hashes`` is sorted, and ``entry`` says where each one's columns are."""
        self.entry = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.entry]
        self.words, self.word_sizes, self.word_starts = words, word_sizes, np.cumsum(word_sizes, dtype=np.int64) - word_sizes
        self.ids, self.id_sizes, self.id_starts = ids, id_sizes, np.cumsum(id_sizes, dtype=np.int64) - id_sizes
        self.again = again

    def _find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 without one."""
        found = np.full(len(hashes), -1, np.int64)
        if not len(self) or not len(hashes):
            return found
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        entry = self.entry[at]
        like = np.flatnonzero((self.hashes[at] == hashes) & (self.word_sizes[entry] == sizes))
        if len(like):
            entry, sizes = entry[like], sizes[like]
            differ = stretches(data, starts[like], sizes) != stretches(self.words, self.word_starts[entry], sizes)
            same = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
            found[like[same]] = entry[same]
        return found

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray) -> None:
        id_starts = np.cumsum(id_sizes) - id_sizes
        fit = np.flatnonzero((sizes <= self.longest) & (id_sizes <= self.longest))[: self.most]
        if len(self) + len(fit) > self.most:
            kept = np.flatnonzero(self.again)
            kept = kept[max(0, len(kept) - min(self.most // 2, self.most - len(fit))) :]  # the latest, if these are too many
            hashes_of = np.empty(len(self), np.uint64)
            hashes_of[self.entry] = self.hashes
            self._set(
                hashes_of[kept], stretches(self.words, self.word_starts[kept], self.word_sizes[kept]), self.word_sizes[kept],
                stretches(self.ids, self.id_starts[kept], self.id_sizes[kept]), self.id_sizes[kept], np.zeros(len(kept), bool),
            )
        if not len(fit):
            return
        order = np.argsort(hashes[fit])
        place = np.searchsorted(self.hashes, hashes[fit][order])
        self.entry = np.insert(self.entry, place, (len(self) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, place, hashes[fit][order])
        for of, flat, begin, n in (("word", stretches(data, starts[fit], sizes[fit]), len(self.words), sizes[fit]), ("id", stretches(ids, id_starts[fit], id_sizes[fit]), len(self.ids), id_sizes[fit])):
            for column, more in ((f"{of}s", flat), (f"{of}_sizes", n.astype(np.int32)), (f"{of}_starts", begin + np.cumsum(n) - n)):
                setattr(self, column, np.concatenate([getattr(self, column), more]))
        self.again = np.concatenate([self.again, np.zeros(len(fit), bool)])

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words of ``data``, and hashes of them, in their order: an array of ids, where each word's begin there, and how many there are."""
        sizes = ends - starts
        found = self._find(data, starts, sizes, hashes)
        old, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        entry = found[old]
        self.again[entry] = True
        flat, counts = stretches(self.ids, self.id_starts[entry], self.id_sizes[entry]), np.empty(len(hashes), np.int64)
        counts[old] = self.id_sizes[entry]
        begins = np.empty(len(hashes), np.int64)
        begins[old] = np.cumsum(counts[old]) - counts[old]
        if len(new):
            text = data.tobytes()
            ids, n = self.encode([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            counts[new] = n
            begins[new] = len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, ids])
            self._learn(data, starts[new], sizes[new], hashes[new], ids, n)
        return flat, begins, counts
