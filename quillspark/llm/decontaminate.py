"""Benchmark decontamination by the q-gram lemma.

An alignment of an item of m characters with at most k edits shares at least m - Q + 1 - k * Q q-grams with the text, on
diagonals no more than k apart. So the filter counts, for each text, item and diagonal band (bands of two widths,
overlapping by one, so that any k + 1 neighbouring diagonals lie in one band), the shared q-grams; regions that meet the
bound are verified by an edit distance computed in a band around their diagonals. Nothing within the budget is lost.

Phrases that many items share would make a text's hits grow with hits times items. As k edits destroy k * Q q-grams at
most, an item is counted by its rare q-grams alone (those in no more than COMMON items' places) wherever their number
exceeds k * Q. Other items are first held against windows of the text by short grams: a window that contains the item
lacks at most k * n of the item's distinct n-grams (n of SHORTS), and that is one matrix product for many windows and
items. Only what passes is counted. Regions pass the same test again. Windows and regions of equal contents are looked at
once, many regions are verified side by side, and a region is left as soon as its least cost is over the budget. Items that begin alike
share the costs of what they share in a window, so a stem that makes up most of many items is aligned once for all of them.

Texts and items are compared in lower case with every run of characters other than letters and digits as one space.
The benchmark is a query set against all rows: it is handled in blocks of at most ``block_chars`` characters, each sent to
the tasks whole.

Defined results: null or empty texts and items match nothing, nor do items without a letter or digit; items shorter than
Q, or too short for the lemma to leave a shared q-gram, get a smaller edit budget, down to 0 (exact occurrence, for the
shortest as whole words). Ids are of any type, null included. Repeated rows of df each give their matches, repeated items
too. Of a text and an item, the region of the fewest edits is given, of those the first. An empty benchmark or table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.texts import mix, slices, utf8

Q = 10
#: Edits allowed for each character of an item.
EDIT_RATE = 0.08
BLOCK_CHARS = 4_000_000
#: Places in items that a q-gram may have to be rare.
COMMON = 32
#: Lengths of the window test's short grams, and the bits of a gram's place in the test's table.
SHORTS, SHORT_BITS = (4, 2), 11
#: Hits counted at a time, cells of a batch of alignments, and windows tested at a time.
MOST_HITS, MOST_CELLS, MOST_WINDOWS = 1 << 20, 1 << 20, 512
_U = np.uint64
_BITS = 22
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it a letter or digit, and its lower case."""
    is_word = np.array([chr(c).isalnum() for c in range(0x110000)])
    low = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(is_word).tolist():
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    return is_word, low


def normalize(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compared form of code points, and the place of each of its characters."""
    is_word, low = _letters()
    word = is_word[points]
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    return np.where(word[at], low[points[at]], 32).astype(np.uint32), at


def grams(chars: np.ndarray, n: int = Q) -> np.ndarray:
    """Hash of the n characters from each place on."""
    out = np.zeros(max(0, len(chars) - n + 1), _U)
    for i in range(n if len(out) else 0):
        out = out * _BASE + chars[i : i + len(out)]
    return mix(out + _U(n))


def band_distances(
    items: np.ndarray, lengths: np.ndarray, windows: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, low: np.ndarray, width: int, budget: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many regions at once: least edits of the whole item against any stretch of its window, and the stretch's begin and end.

    Row r aligns items[r, :lengths[r]] (zeros behind) with the window text[starts[r] : starts[r] + sizes[r]] on the diagonals (window place
    minus item place) low[r] to low[r] + width - 1. Rows of one number in ``windows`` have windows of the same contents and diagonals; they are next to
    one another, by the order of their items. Such rows are one group, with one line of costs, up to the character at which their items
    part. A row over the budget gives a cost over it.
    """
    n, far = len(lengths), 1 << 30
    place = np.arange(width)
    best = np.full((n, 3), far)
    # How many characters a row shares with the row before, -1 in another window: where it gets a group of its own.
    shared = np.full(n, -1)
    apart = items[1:] != items[:-1]
    shared[1:] = np.where(windows[1:] == windows[:-1], np.where(apart.any(axis=1), apart.argmax(axis=1), items.shape[1]), -1)
    by_shared, by_length = np.argsort(shared, kind="stable"), np.argsort(lengths, kind="stable")
    opens, ends = np.searchsorted(shared[by_shared], np.arange(-1, items.shape[1] + 1)), np.searchsorted(lengths[by_length], np.arange(items.shape[1] + 2))
    rows = np.sort(by_shared[: opens[1]])  # first rows of the groups
    begin = low[rows][:, None] + place
    cost = np.where((begin >= 0) & (begin <= sizes[rows][:, None]), 0, far)  # an alignment may begin at any place
    alive = np.ones(len(rows), bool)
    for i in range(1, items.shape[1] + 1):
        more = np.sort(by_shared[opens[i] : opens[i + 1]])
        if len(more):
            parent = np.searchsorted(rows, more) - 1
            keep = alive[parent]
            at = np.searchsorted(rows, more)
            rows, alive = np.insert(rows, at, more), np.insert(alive, at, keep)
            cost, begin = np.insert(cost, at, cost[parent], axis=0), np.insert(begin, at, begin[parent], axis=0)
        alive &= lengths[rows] >= i
        if i % 8 == 0:
            alive &= cost.min(axis=1) <= budget
        if not alive.any():
            if shared.max() < i or not (lengths > i).any():
                break
            continue
        live = np.flatnonzero(alive)
        own, c, b = rows[live], cost[live], begin[live]
        j = i + low[own][:, None] + place  # characters of the window used so far
        fits = (j >= 1) & (j <= sizes[own][:, None])
        at = np.where(fits, starts[own][:, None] + j - 1, 0)
        diagonal = np.where(fits, c + (text[at] != items[own, i - 1][:, None]), far)
        above = np.full_like(c, far)
        above[:, :-1] = c[:, 1:] + 1
        new, from_above = np.minimum(diagonal, above), above < diagonal
        outside = (j < 0) | (j > sizes[own][:, None])
        new[outside] = far
        origin = b.copy()
        origin[:, :-1] = np.where(from_above[:, :-1], b[:, 1:], b[:, :-1])
        flat = new - place  # steps along the window cost one each: a running minimum
        least = np.minimum.accumulate(flat, axis=1)
        source = np.maximum.accumulate(np.where(flat == least, place, 0), axis=1)
        c, b = least + place, np.take_along_axis(origin, source, axis=1)
        c[outside] = far
        if len(live) == len(rows):
            cost, begin = c, b
        else:
            cost[live], begin[live] = c, b
        done = by_length[ends[i] : ends[i + 1]]
        if len(done):
            group = np.searchsorted(rows, done, "right") - 1
            done, group = done[alive[group]], group[alive[group]]
            k = cost[group].argmin(axis=1)
            best[done] = np.stack([cost[group, k], begin[group, k], lengths[done] + low[done] + k], axis=1)
    return best[:, 0], best[:, 1], best[:, 2]


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 ... of n[i] numbers each, one after another."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _short(chars: np.ndarray, n: int) -> np.ndarray:
    """Table places of the n-grams of the window test."""
    return (grams(chars, n) >> _U(64 - SHORT_BITS)).astype(np.int64)


class Contents:
    """Hashes of stretches of a text, and which short grams they have."""

    def __init__(self, chars: np.ndarray):
        self.short = [_short(chars, n) for n in SHORTS]
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(chars * np.cumprod(np.full(len(chars), _BASE), dtype=_U), dtype=_U)])
        self.down = np.cumprod(np.full(len(chars) + 1, _INVERSE), dtype=_U)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin]).astype(np.int64)

    def tables(self, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        """For each length of SHORTS: [stretch, place], 1 where the stretch has such a gram."""
        for n, places in zip(SHORTS, self.short):
            count = np.maximum(0, end - begin - n + 1)
            out = np.zeros((len(begin), 1 << SHORT_BITS), np.float32)
            out[np.repeat(np.arange(len(begin)), count), places[_ranges(begin, count)]] = 1
            yield out


class Index:
    """The q-grams of some items, by hash. Items without a letter or digit are left out."""

    def __init__(self, items: list[tuple[object, str]], rate: float = EDIT_RATE):
        self.ids, self.items = [], []
        for item_id, text in items:
            chars, _ = normalize(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
            chars = chars[1:] if len(chars) and chars[0] == 32 else chars
            chars = chars[:-1] if len(chars) and chars[-1] == 32 else chars
            if len(chars):
                self.ids.append(item_id)
                self.items.append(chars)
        size = np.array(list(map(len, self.items)), np.int64)
        self.budgets = np.maximum(0, np.minimum((rate * size).astype(np.int64), (size - Q) // Q))
        self.sizes, self.width = size, self.budgets + 1
        self.order = np.empty(len(size), np.int64)  # the items' places in alphabetical order
        self.order[sorted(range(len(size)), key=lambda i: self.items[i].astype(">u4").tobytes())] = np.arange(len(size))
        long = np.flatnonzero(size >= Q)
        own = [grams(self.items[i]) for i in long]
        h = np.concatenate([np.empty(0, _U), *own])
        owner = np.repeat(long, list(map(len, own))) if len(long) else np.empty(0, np.int64)
        offset = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in own)])
        _, inverse, places = np.unique(h, return_inverse=True, return_counts=True)
        rare = places[inverse] <= COMMON if len(h) else np.empty(0, bool)
        n_rare = np.bincount(owner[rare], minlength=len(size))
        lost = self.budgets * Q
        by_rare = n_rare > lost
        self.needs = np.where(by_rare, n_rare, size - Q + 1) - lost
        self.rare = self._sorted(h, owner, offset, rare & by_rare[owner])
        self.crowded = np.flatnonzero((size >= Q) & ~by_rare)
        common = ~by_rare[owner] if len(h) else rare
        self.common = np.unique(h[common])
        key = self._pair(h[common], owner[common])
        order = np.argsort(key, kind="stable")
        self.by_pair = key[order], offset[common][order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[np.concatenate([self.rare[0], self.common]) >> _U(64 - _BITS)] = True
        self.reach = int((size + self.budgets).max(initial=0)) + Q
        # The window test: the table places of each item's distinct short grams, and how many of them a window must have.
        self.places = [[np.unique(_short(x, n)) if len(x) >= Q else np.empty(0, np.int64) for x in self.items] for n in SHORTS]
        self.least = [np.array(list(map(len, p)), np.int64) - n * self.budgets for n, p in zip(SHORTS, self.places)]
        short = np.flatnonzero(size < Q)
        self.short = {m: short[size[short] == m] for m in np.unique(size[short]).tolist()}

    @staticmethod
    def _sorted(h: np.ndarray, owner: np.ndarray, offset: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.flatnonzero(keep)[np.argsort(h[keep], kind="stable")]
        return h[order], owner[order].astype(np.int64), offset[order].astype(np.int64)

    @staticmethod
    def _pair(h: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Key of a q-gram in an item."""
        return mix(h ^ mix(item.astype(_U) + _U(1)))

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, begin, end, edits) of the best region of each row and item; places are code points of the text."""
        sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        chars, at = normalize(points)
        first = np.searchsorted(at, bounds)  # where each row's compared characters begin
        found = np.concatenate([self._verified(chars, first, self._regions(chars, first)), self._short_matches(chars, first)])
        # row, item, edits, begin, end: the first of each row and item in this order is the best
        found = found[np.lexsort((found[:, 4], found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        out = []
        for row, item, edits, begin, end in found[new].tolist():
            place = at[first[row] : first[row + 1]] - bounds[row]
            out.append((row, item, int(place[begin]), int(place[end - 1]) + 1, edits))
        return out

    def _short_matches(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """row, item, 0, begin, end of the first occurrence, as whole words, of each item shorter than Q."""
        out = [np.empty((0, 5), np.int64)]
        edge = np.zeros(len(chars) + 1, bool)
        edge[first] = True
        for m, own in self.short.items():
            h = grams(chars, m)
            known = np.array([grams(self.items[i], m)[0] for i in own], _U)
            order = np.argsort(known)
            hit = np.flatnonzero(np.isin(h, known))
            before = edge[hit] | (chars[np.maximum(hit - 1, 0)] == 32)
            after = edge[hit + m] | (chars[np.minimum(hit + m, len(chars) - 1)] == 32)
            row = np.searchsorted(first, hit, "right") - 1
            ok = before & after & (hit + m <= first[row + 1])
            hit, row = hit[ok], row[ok]
            left, right = (np.searchsorted(known[order], h[hit], side) for side in ("left", "right"))
            n = right - left
            item = own[order[_ranges(left, n)]]
            begin = np.repeat(hit - first[row], n)
            out.append(np.stack([np.repeat(row, n), item, np.zeros_like(begin), begin, begin + m], axis=1))
        return np.concatenate(out)

    def _regions(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """row, item, first and last diagonal of every band with enough shared q-grams, each once."""
        g = grams(chars)
        out = [np.empty((0, 4), np.int64)]
        h, owner, offset = self.rare
        known = np.flatnonzero(self.seen[g >> _U(64 - _BITS)])
        hit = known = known[known + Q <= first[np.searchsorted(first, known, "right")]]
        left, right = np.searchsorted(h, g[hit]), np.searchsorted(h, g[hit], "right")
        some = right > left
        hit, left, n = hit[some], left[some], (right - left)[some]
        for a, b in self._parts(hit, n):
            entry = _ranges(left[a:b], n[a:b])
            out.append(self._bands(np.repeat(hit[a:b], n[a:b]), owner[entry], offset[entry], first))
        if len(self.crowded):
            out += self._crowded_bands(chars, g, known[np.isin(g[known], self.common)], first)
        return np.unique(np.concatenate(out), axis=0)

    def _parts(self, hit: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of hits of some MOST_HITS entries; each begins early enough that a region ending in it lies in it whole."""
        if not len(hit):
            return
        total = np.cumsum(n)
        cut = 0
        while cut < len(hit):
            end = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + MOST_HITS, "right")))
            yield int(np.searchsorted(hit, hit[cut] - self.reach)), end
            cut = end

    def _crowded_bands(self, chars: np.ndarray, g: np.ndarray, hit: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The bands of crowded items, in windows of the text that have enough of the item's short grams."""
        row = np.searchsorted(first, hit, "right") - 1
        # A region lies whole in the window of the stretch in which it begins; a hit is looked at in each window it may belong to.
        reach = int((self.sizes + self.budgets)[self.crowded].max()) + Q
        stretch = (hit - first[row]) // reach
        if not len(hit):
            return []
        most = int(stretch.max()) + 2
        windows = np.unique(np.concatenate([row * most + stretch + 1, row * most + stretch]))
        row, stretch = windows // most, windows % most - 1
        row, stretch = row[stretch >= 0], stretch[stretch >= 0]
        begin = first[row] + stretch * reach
        end = np.minimum(begin + 2 * reach, first[row + 1])
        content = Contents(chars)
        order = np.lexsort((begin, content.hashes(begin, end), row))
        same = np.stack([row, content.hashes(begin, end)])[:, order]
        order = np.sort(order[np.append(True, (same[:, 1:] != same[:, :-1]).any(axis=0))])
        begin, end = begin[order], end[order]
        out = []
        for a in range(0, len(begin), MOST_WINDOWS):
            b, e = begin[a : a + MOST_WINDOWS], end[a : a + MOST_WINDOWS]
            there = list(content.tables(b, e))
            for c in range(0, len(self.crowded), MOST_WINDOWS):
                own = self.crowded[c : c + MOST_WINDOWS]
                passed = np.ones((len(b), len(own)), bool)
                for have, places, least in zip(there, self.places, self.least):
                    table = np.zeros((1 << SHORT_BITS, len(own)), np.float32)
                    table[np.concatenate([places[i] for i in own]), np.repeat(np.arange(len(own)), [len(places[i]) for i in own])] = 1
                    passed &= have @ table >= least[own]
                window, which = np.nonzero(passed)
                out += self._counted(g, hit, own[which], b[window], e[window], first)
        return out

    def _counted(self, g: np.ndarray, hit: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """The bands of each item in its window of the text, some MOST_HITS hits at a time."""
        low, high = np.searchsorted(hit, begin), np.searchsorted(hit, end)
        n = high - low
        total, cut = np.cumsum(n), 0
        while cut < len(n):
            stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + MOST_HITS, "right")))
            own, wanted = hit[_ranges(low[cut:stop], n[cut:stop])], np.repeat(item[cut:stop], n[cut:stop])
            key = self._pair(g[own], wanted)
            left, right = np.searchsorted(self.by_pair[0], key), np.searchsorted(self.by_pair[0], key, "right")
            # Hits that two windows share are counted once.
            n_items, longest = len(self.items), int(self.sizes.max())
            where = np.repeat(own * n_items + wanted, right - left)
            once = np.unique(where * longest + self.by_pair[1][_ranges(left, right - left)])
            where = once // longest
            yield self._bands(where // n_items, where % n_items, once % longest, first)
            cut = stop

    def _bands(self, hit: np.ndarray, item: np.ndarray, offset: np.ndarray, first: np.ndarray) -> np.ndarray:
        """row, item, first and last diagonal of the bands in which the hits are enough."""
        row = np.searchsorted(first, hit, "right") - 1
        # An item that shares too few q-grams with the text has no region in it.
        pairs, inverse, total = np.unique(row * len(self.items) + item, return_inverse=True, return_counts=True)
        enough = total[inverse] >= self.needs[item] if len(item) else np.empty(0, bool)
        hit, item, row, offset, pair = hit[enough], item[enough], row[enough], offset[enough], inverse[enough]
        if not len(hit):
            return np.empty((0, 4), np.int64)
        band = np.floor_divide(hit - first[row] - offset, self.width[item])
        least = int(band.min()) - 1
        span = int(band.max()) - least + 1
        bands, counts = np.unique(np.concatenate([pair * span + band - least, pair * span + band - 1 - least]), return_counts=True)
        row, item = np.divmod(pairs[bands // span], len(self.items))
        good = counts >= self.needs[item]
        row, item, low = row[good], item[good], (bands[good] % span + least) * self.width[item[good]]
        return np.stack([row, item, low, low + 2 * self.width[item] - 1], axis=1)

    def _exact(self, window: np.ndarray, item: int) -> int:
        """Where the window first has the item as it is, or -1."""
        raw, wanted = window.tobytes(), self.items[item].tobytes()
        at = raw.find(wanted)
        while at % 4 and at >= 0:
            at = raw.find(wanted, at + 1)
        return at // 4 if at >= 0 else -1

    def _plausible(self, contents: Contents, item: np.ndarray, at: np.ndarray, size: np.ndarray, region: np.ndarray) -> np.ndarray:
        """The regions that pass the window test."""
        passed = np.ones(len(item), bool)
        for have, places, least in zip(contents.tables(at, at + size), self.places, self.least):
            n = np.array([len(places[i]) for i in item], np.int64)
            which = np.repeat(np.arange(len(item)), n)
            passed &= np.bincount(which, have[which, np.concatenate([np.empty(0, np.int64), *(places[i] for i in item)])], len(item)) >= least[item]
        return region[passed]

    def _verified(self, chars: np.ndarray, first: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """row, item, edits, begin and end (in the row's compared characters) of the regions within the budget."""
        if not len(regions):
            return np.empty((0, 5), np.int64)
        row, item, low, high = regions.T
        k, m = self.budgets[item], self.sizes[item]
        begin = np.maximum(0, low - k)
        size = np.minimum(first[row + 1] - first[row], high + m + k) - begin
        diagonal = low - k - begin
        # Of regions of equal contents within a row, the first stands for all.
        at = first[row] + begin
        contents = Contents(chars)
        order = np.lexsort((begin, diagonal, hashes := contents.hashes(at, at + size), size, item, row))
        same = np.stack([row, item, size, hashes, diagonal])[:, order]
        kept = order[np.append(True, (same[:, 1:] != same[:, :-1]).any(axis=0))]
        kept = np.concatenate([self._plausible(contents, item[x], at[x], size[x], x) for x in np.array_split(kept, 1 + len(kept) // MOST_WINDOWS)])
        # Items that are there as they are need no alignment.
        exact = np.array([self._exact(chars[a : a + n], i) for a, n, i in zip(at[kept].tolist(), size[kept].tolist(), item[kept].tolist())], np.int64)
        same = kept[exact >= 0]
        place = begin[same] + exact[exact >= 0]
        out = [np.stack([row[same], item[same], np.zeros_like(same), place, place + m[same]], axis=1)]
        kept = kept[exact < 0]
        # Rows of equal windows and diagonals come together, in the order of their items, so that they share what their items share.
        kept = kept[np.lexsort((self.order[item[kept]], diagonal[kept], size[kept], hashes[kept], k[kept]))]
        window = np.stack([hashes[kept], size[kept], diagonal[kept]])
        window = np.cumsum(np.append(False, (window[:, 1:] != window[:, :-1]).any(axis=0))[: len(kept)])
        cut = 0
        while cut < len(kept):
            budget = int(k[kept[cut]])
            width = 4 * budget + 2  # two bands' diagonals and k on either side
            longest = max(width, int(m[kept[np.searchsorted(k[kept], budget) : np.searchsorted(k[kept], budget, "right")]].max()))
            stop = min(int(np.searchsorted(k[kept], budget, "right")), cut + max(1, MOST_CELLS // longest))
            own = kept[cut:stop]
            items = np.zeros((len(own), int(m[own].max())), np.uint32)
            for r, i in enumerate(item[own].tolist()):
                items[r, : len(self.items[i])] = self.items[i]
            edits, a, b = band_distances(items, m[own], window[cut:stop], chars, at[own], size[own], diagonal[own], width, budget)
            good = (edits <= budget) & (b > a)
            out.append(np.stack([row[own], item[own], edits, begin[own] + a, begin[own] + b], axis=1)[good])
            cut = stop
        return np.concatenate(out)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield a, b, [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)]


def _matched(index: Index, id_kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in _texts(batch.column(1)):
                found = index.matches(texts)
                if found:
                    row, item, begin, end, edits = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([a + r for r in row])), pa.array([index.ids[i] for i in item], id_kind),
                            *(pa.array(x, pa.int64()) for x in (begin, end, edits)), pa.array([int(index.budgets[i]) for i in item], pa.int64()),
                        ],
                        names=["id", "item_id", "start", "stop", "edits", "budget"],
                    )

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, rate: float, block_chars: int) -> Iterator[Index]:
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    n = 1 + (items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("i", "t")
        yield Index([(r.i, r.t) for r in block.collect()], rate)


def contaminations(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row for each row of df and benchmark item found in it: id, item_id, start, stop, edits, budget."""
    longs = [T.StructField(c, T.LongType()) for c in ("start", "stop", "edits", "budget")]
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), *longs])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = df.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, item_col, item_text, rate, block_chars):
        out = out.union(rows.mapInArrow(_matched(index, kind), schema))
    return out.withColumnRenamed("id", id_col)


def keep_uncontaminated(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of df, whole, in which no benchmark item is found. Nothing is shuffled."""
    at = df.columns.index(text_col)

    def without(index: Index) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, texts in _texts(batch.column(at)):
                    keep[[a + m[0] for m in index.matches(texts)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for index in _blocks(benchmark, item_col, item_text, rate, block_chars):
        df = df.mapInArrow(without(index), df.schema)
    return df
