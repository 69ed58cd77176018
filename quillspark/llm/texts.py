"""Vectorised word, line and hash primitives over the UTF-8 bytes of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomial prefix hashes with a final mix, so that the
hash of any word or line of a whole batch comes from two lookups in one cumulative sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is still handled whole.
SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE, _FOLD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that begin a code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, _U)
        step[0] = 1
        table = np.cumprod(step, dtype=_U)
        if n > 4 * SLICE_BYTES:
            return table[:n]
        _powers[kind] = table
    return _powers[kind][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, most_rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``most_rows`` rows, of one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, rows, row + most_rows)
        yield row, end
        row = end


class Pieces:
    """Words or lines of a slice: where each begins and ends, its row, and its hash."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.n_rows = starts, ends, len(bounds) - 1
        self.rows = np.searchsorted(bounds, starts, "right") - 1
        self.per_row = np.bincount(self.rows, minlength=self.n_rows)
        self.first = np.concatenate([[0], np.cumsum(self.per_row)])


class Slice:
    """Some rows' bytes, with what is computed of them on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begin: int, end: int):
        self.bounds = offsets[begin : end + 1] - offsets[begin]
        self.data = data[offsets[begin] : offsets[end]]
        self._prefix: np.ndarray | None = None

    def words(self, apart: np.ndarray = IS_SPACE) -> Pieces:
        """Runs of bytes that ``apart`` doesn't hold."""
        inside = ~apart[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        return Pieces(np.flatnonzero(first), np.flatnonzero(last) + 1, self.bounds)

    def lines(self) -> Pieces:
        """Pieces between line feeds, the empty ones of empty rows excepted."""
        feed = np.flatnonzero(self.data == 10)
        filled = np.flatnonzero(np.diff(self.bounds) > 0)
        starts = np.sort(np.concatenate([self.bounds[filled], feed + 1]))
        ends = np.sort(np.concatenate([self.bounds[filled + 1], feed]))
        keep = ends > starts
        return Pieces(starts[keep], ends[keep], self.bounds)

    def hashes(self, p: Pieces) -> np.ndarray:
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, _U)
            np.cumsum(_BYTE[self.data] * _power("up", len(self.data)), out=self._prefix[1:])
        body = (self._prefix[p.ends] - self._prefix[p.starts]) * _power("down", len(self.data) + 1)[p.starts]
        return mix(body ^ (p.ends - p.starts).astype(_U) * _FOLD)

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def points(self, p: Pieces) -> np.ndarray:
        """Code points of each piece."""
        total = np.concatenate([[0], np.cumsum(IS_LEAD[self.data], dtype=np.int64)])
        return total[p.ends] - total[p.starts]


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every n-word window that stays in its row."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, _U)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = out * _FOLD + hashes[i : len(hashes) - n + 1 + i]
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return at, mix(out[at])


def shingles(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each n-word shingle; a row of fewer words has one, of all its words; one without words has none."""
    w = s.words()
    h = s.hashes(w)
    at, value = windows(h, w.rows, n)
    rows = [w.rows[at]]
    values = [value]
    for k in range(1, n):
        short = np.flatnonzero(w.per_row == k)
        if len(short):
            got = h[w.first[short]].copy()
            for i in range(1, k):
                got = got * _FOLD + h[w.first[short] + i]
            rows.append(short)
            values.append(mix(got + _U(k)))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]
