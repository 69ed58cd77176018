"""Personal data by boosted trees over candidate spans.

Generators of high recall propose spans, which may overlap: e-mail-like and obfuscated addresses, dotted numbers, and runs
of digits with separators. The four base kinds (email, ip, card, phone) are validated by rule and always kept. The trees
judge what no rule validates. Every proposal is described by its format (length, digits, groups, separators, checksum,
character classes) and its context (characters and words around it).

There are no labels of personal data, so positives are made: a validated span of a text is written, in its own context, in
a form that no rule accepts (an address with a bracketed "at", a phone without its plus or with other separators, a card
with dots or slashes). Negatives are the generators' other proposals, but for those in the form of a national phone, of
which nothing is known, and prose around a bracketed "at". Documents are split by a hash of their text: on the held-back
ones each kind of proposal (contact, number) gets its own threshold, below the least score at which precision reaches
PRECISION; a kind without such a score selects nothing. Selected spans overlap no base span; of overlapping ones the best score wins.

The model is fitted on all documents: on the distinct descriptions of their candidates, so copies of a document count once. Descriptions
are coded by the bins of each feature, and equal codes are one row with their number; the rows stay distributed, and each
level of a tree takes one aggregation of gradients by bin, in whole numbers, so that no order of summing changes the model.
Thresholds come from all held-back descriptions, by narrow bins of scores. If the documents lack either class, only base spans are found.

Defined results: a null text has no spans; texts of any length are scanned whole; rows of equal or null ids are all
scanned; characters beyond ASCII are context only. Spans are in code points, end exclusive, ordered by start and kind.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.texts import slices, utf8
from quillspark.session import materialize

# The base kinds' patterns. The lookbehinds only spare starts at which the pattern can't match or would
# match the rest of a run that was already refused.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LABELS = (*KINDS, "contact", "number")
#: Generators beyond the base: obfuscated addresses, and numbers with at least seven digits.
OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[A-Za-z0-9-]{1,63})+", re.I | re.A)
NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,30}(?![0-9A-Za-z])")
#: Of the numbers, those of a national phone's form: an area code in brackets, or groups of three, three and four digits.
NATIONAL = re.compile(r"\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,5}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}")

#: Candidates of each class that one document gives to a fit that is told to be bounded, and those handled at once and in one task of an aggregation.
MOST_OF_ONE, BLOCK_ROWS, TASK_ROWS = 200, 4_096, 1 << 15
TREES, DEPTH, SHRINK, LEAST_LEAF = 40, 3, 0.3, 10
#: Bins of a feature, of a score, and parts of one that gradients are counted in.
BINS, SCORE_BINS, UNIT = 32, 1 << 14, 1 << 24
PRECISION = 0.99
CONTEXT = 24
_NO_DIGIT, _DIGITS, _WORDS = re.compile(r"[^0-9]+"), re.compile(r"[0-9]+"), re.compile(r"[a-z]+")
_HINTS = ("tel", "phone", "call", "mail", "contact", "fax", "card", "visa", "ip", "ssn", "iban", "account", "mobile", "order", "id", "ref", "no", "nr")


def digits_of(span: str) -> str:
    return _NO_DIGIT.sub("", span)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = digits_of(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, label, end) of the generators' proposals, the base spans left out."""
    out = [(m.start(), 4, m.end()) for m in OBFUSCATED.finditer(text)] if "at" in text.lower() and ("[" in text or "(" in text) else []
    out += [(m.start(), 5, m.end()) for m in NUMBER.finditer(text)]
    out += [(m.start(), 5, m.end()) for m in CARD.finditer(text) if 12 <= m.end() - m.start() <= 40]
    return sorted(set(out))


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a span. Nothing here says which rule proposed it."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits, groups = digits_of(span), _DIGITS.findall(span) or [""]
    words = _WORDS.findall((before + " " + after).lower())
    return [
        len(span), len(digits), len(groups), max(map(len, groups)), min(map(len, groups)), sum(c.isalpha() for c in span),
        span.count(" "), span.count("-"), span.count("."), span.count("("), span.count("/"), float(span[:1] == "+"), float("@" in span),
        float("at" in span.lower()), float(". " in span), float(12 <= len(digits) <= 19 and luhn(digits)), float(digits[:1] or -1), len(set(digits)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ":=#"), float(before[-1:] in " \n\t"),
        sum(c.isdigit() for c in before + after), float(all(len(g.lstrip("0")) <= 3 and int(g or 0) <= 255 for g in groups)), *(float(h in words) for h in _HINTS),
    ]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """How many edges of each feature are below a value."""
    return np.stack([np.searchsorted(e, c) for c, e in zip(x.T, edges)], axis=1).astype(np.uint8)


def nodes_of(codes: np.ndarray, feature: np.ndarray, at_bin: np.ndarray, level: int) -> np.ndarray:
    """Each row's node of a level of a tree."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for d in range(level):
        at = 2**d - 1 + node
        node = 2 * node + ((feature[at] >= 0) & (codes[rows, feature[at]] > at_bin[at]))
    return node


def sums_of(block: tuple[np.ndarray, np.ndarray, np.ndarray], trees: BoostedTrees, feature: np.ndarray, at_bin: np.ndarray, level: int) -> np.ndarray:
    """(node, feature, bin, what) sums over a block of codes, classes and numbers of rows."""
    codes, y, n = block
    out = np.zeros((2**level, codes.shape[1], BINS, 3), np.int64)
    for a in range(0, len(y), BLOCK_ROWS):
        part, own = codes[a : a + BLOCK_ROWS], n[a : a + BLOCK_ROWS]
        p = 1 / (1 + np.exp(-trees.coded(part)))
        values = [np.rint((p - y[a : a + BLOCK_ROWS]) * UNIT).astype(np.int64) * own, np.rint(p * (1 - p) * UNIT).astype(np.int64) * own, own]
        node = nodes_of(part, feature, at_bin, level)
        for f in range(codes.shape[1]):
            at = (node * codes.shape[1] + f) * BINS + part[:, f]
            for k, v in enumerate(values):
                np.add.at(out.reshape(-1, 3)[:, k], at, v)
    return out


@dataclass
class BoostedTrees:
    """Depth-limited regression trees on the log loss, each kept as arrays of a complete binary tree."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    #: The bin of each cut, for rows of bins.
    bins: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def grow(cls, edges: list[np.ndarray], rate: float, counted: Callable[[BoostedTrees, np.ndarray, np.ndarray, int], np.ndarray]) -> BoostedTrees:
        """Trees from sums alone. ``counted`` gives, for the trees so far and the splits of the next one by feature and bin, (node, feature, bin) sums of gradients, curvatures (both
        in parts of UNIT) and rows at a level."""
        rate = float(np.clip(rate, 0.001, 0.999))
        out = cls([], float(np.log(rate / (1 - rate))))
        for _ in range(TREES):
            feature, at_bin = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1, np.int64)
            leaf = np.zeros(2**DEPTH)
            for level in range(DEPTH):
                sums = counted(out, feature, at_bin, level)
                for k in range(2**level):
                    g, h, n = sums[k, 0, :, 0].sum() / UNIT, sums[k, 0, :, 1].sum() / UNIT, sums[k, 0, :, 2].sum()
                    best = (1e-6, -1, 0)
                    for f, e in enumerate(edges):
                        if not len(e) or n < 2 * LEAST_LEAF:
                            continue
                        gs, hs, ns = np.cumsum(sums[k, f, : len(e)], axis=0).T
                        gs, hs = gs / UNIT, hs / UNIT
                        gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
                        gain[(ns < LEAST_LEAF) | (n - ns < LEAST_LEAF)] = 0
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (float(gain[b]), f, b)
                    feature[2**level - 1 + k], at_bin[2**level - 1 + k] = best[1], best[2]
                    if level == DEPTH - 1:
                        left = sums[k, best[1], : best[2] + 1].sum(0) if best[1] >= 0 else sums[k, 0].sum(0)
                        right = sums[k, 0].sum(0) - left
                        leaf[2 * k : 2 * k + 2] = [-SHRINK * x[0] / UNIT / (x[1] / UNIT + 1.0) for x in (left, right)]
            cut = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, at_bin)])
            out.trees.append((feature, cut, leaf))
            out.bins.append(at_bin)
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        block = (binned(x, edges), y, np.ones(len(y), np.int64))
        return cls.grow(edges, y.mean(), lambda *at: sums_of(block, *at))

    def coded(self, codes: np.ndarray) -> np.ndarray:
        """Log odds of rows of bins."""
        z = np.full(len(codes), self.start)
        for (feature, _, leaf), at_bin in zip(self.trees, self.bins):
            z += leaf[nodes_of(codes, feature, at_bin, DEPTH)]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = 2 * node + ((feature[at] >= 0) & (x[np.arange(len(x)), feature[at]] > cut[at]))
            z += leaf[node]
        return 1 / (1 + np.exp(-z))


@dataclass
class PiiModel:
    """The trees and the least score of each kind of proposal; a kind without one selects nothing."""

    trees: BoostedTrees | None
    thresholds: dict[int, float]

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, label, end, score), sorted; base spans score 1."""
        base = base_spans(text)
        out = [(s, k, e, 1.0) for s, k, e in base]
        if self.trees is None:
            return out
        taken = sorted((s, e) for s, _, e in base)
        starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []

        def free(s: int, e: int) -> bool:
            at = bisect_left(starts, e)
            return at == 0 or reach[at - 1] <= s

        proposed = [c for c in candidates(text) if free(c[0], c[2])]
        if proposed:
            scores = self.trees.score(np.array([features(text, s, e) for s, _, e in proposed]))
            chosen: list[tuple[int, int]] = []
            ranked = sorted((c for c in zip(proposed, scores.tolist()) if c[1] >= self.thresholds.get(c[0][1], 2.0)), key=lambda c: (-c[1], c[0]))
            best: list[tuple[int, int, int, float]] = []
            for (s, k, e), score in ranked:
                at = bisect_left(chosen, (s, e))
                if (at == 0 or chosen[at - 1][1] <= s) and (at == len(chosen) or chosen[at][0] >= e):
                    chosen.insert(at, (s, e))
                    best.append((s, k, e, score))
            out += best
        return sorted(out)


#: Ways to write an address (local part, domain), a phone (its last ten digits, the ones before) and a card (groups of four
#: digits) in a form that no rule validates.
_ADDRESSES = (
    lambda a, d: f"{a} [at] {d.replace('.', ' [dot] ')}", lambda a, d: f"{a} (at) {d.replace('.', ' (dot) ')}",
    lambda a, d: f"{a}[at]{d.replace('.', '[dot]')}", lambda a, d: f"{a} (at) {d}", lambda a, d: f"{a} [at] {d}",
)
_PHONES = (
    lambda d, c: f"({d[:3]}) {d[3:6]}-{d[6:]}", lambda d, c: f"({d[:3]}) {d[3:6]} {d[6:]}", lambda d, c: f"{d[:3]}-{d[3:6]}-{d[6:]}", lambda d, c: f"{d[:3]}.{d[3:6]}.{d[6:]}",
    lambda d, c: f"{c or 1} {d[:3]} {d[3:6]} {d[6:]}", lambda d, c: f"{c or 1}-{d[:3]}-{d[3:6]}-{d[6:]}", lambda d, c: f"00{c or 1} {d[:3]} {d[3:6]} {d[6:]}", lambda d, c: f"+{c or 1}/{d[:3]}/{d[3:6]}/{d[6:]}",
)
_CARDS = (".".join, "/".join, " - ".join)
_SENTENCE_END = re.compile(r"([A-Za-z]+)\x20([A-Za-z]+\.\x20[A-Za-z]+)")


def rewritten(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[list[float], int, int]]:
    """Features, class and label of proposals in the forms that no rule validates: validated spans written anew, and prose with a bracketed "at"."""
    made = []
    for s, k, e in base:
        span = text[s:e]
        digits, pick = digits_of(span), zlib.crc32(span.encode("utf-8", "replace"))
        if k == 0:
            name, host = span.split("@", 1)
            made.append((s, e, _ADDRESSES[pick % len(_ADDRESSES)](name, host), 1))
            # Also without digits and with a host of two parts, as a corpus' addresses may all have the same shape.
            name, host = re.sub("[0-9]", "", name).strip("._"), ".".join(re.sub("[0-9]", "", host).split(".")[-2:])
            made.append((s, e, _ADDRESSES[(pick >> 8) % len(_ADDRESSES)](name, host), 1))
        elif k == 2:
            made.append((s, e, _CARDS[pick % len(_CARDS)]([digits[i : i + 4] for i in range(0, len(digits), 4)]), 1))
        elif k == 3 and len(digits) >= 10:
            made += [(s, e, _PHONES[(pick >> j) % len(_PHONES)](digits[-10:], digits[:-10]), 1) for j in (0, 8)]
    if any(k == 0 for _, k, _ in base):
        made += [(m.start(), m.end(), f"{m[1]} {'[at]' if m.start() % 2 else '(at)'} {m[2]}", 0) for m in islice(_SENTENCE_END.finditer(text), 2)]
    for s, e, said, is_personal in made:
        before = text[max(0, s - CONTEXT) : s]
        whole, end = before + said + text[e : e + CONTEXT], len(before) + len(said)
        label = next((k for a, k, b in candidates(whole) if (a, b) == (len(before), end)), None)
        if label is not None and (len(before), end) not in {(a, b) for a, _, b in base_spans(whole)}:
            yield features(whole, len(before), end), is_personal, label


def examples(text: str) -> Iterator[tuple[list[float], int, int]]:
    """Features, class (1: personal) and label of what a text teaches."""
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    for s, k, e in candidates(text):
        at = bisect_left(starts, e)
        if k == 5 and not NATIONAL.fullmatch(text, s, e) and (at == 0 or reach[at - 1] <= s):
            yield features(text, s, e), 0, k
    yield from rewritten(text, base)


def _texts(column: pa.Array) -> Iterator[list[str]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)]


def _few(found: Iterator[tuple], most: int = MOST_OF_ONE) -> list[tuple]:
    """At most so many distinct candidates of one document, of each class: the first by hash. Holds twice as many."""
    own: list[dict] = [{}, {}]
    for x in found:
        key = repr(x)
        own[x[1]][zlib.crc32(key.encode()), key] = x
        if len(own[x[1]]) > 2 * most:
            own[x[1]] = {k: own[x[1]][k] for k in sorted(own[x[1]])[:most]}
    return [kept[k] for kept in own for k in sorted(kept)[:most]]


def _examples(most: int | None = None) -> Callable:
    """Descriptions of the candidates of texts; of all of each text, or of ``most`` of each class."""
    kinds = (pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _texts(batch.column(0)):
                found = ((x, y, k, held) for t in texts for held in [zlib.crc32(t.encode("utf-8", "replace")) % 4 == 0] for x, y, k in (examples(t) if most is None else _few(examples(t), most)))
                while got := list(islice(found, BLOCK_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*got), kinds)], names=["x", "y", "label", "held"])

    return run


def _coded(edges: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0)
            for a in range(0, len(x), BLOCK_ROWS):
                own = x.slice(a, BLOCK_ROWS)
                codes = binned(own.flatten().to_numpy().reshape(len(own), len(edges)), edges)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), *(batch.column(i).slice(a, BLOCK_ROWS) for i in (1, 2, 3))], names=["code", "y", "label", "held"])

    return run


def _blocks(width: int) -> Callable:
    """Codes, classes, numbers, labels and whether held back, BLOCK_ROWS rows at a time."""

    def run(rows: Iterator) -> Iterator[tuple]:
        while got := list(islice(rows, BLOCK_ROWS)):
            codes = np.frombuffer(b"".join(bytes(r.code) for r in got), np.uint8).reshape(len(got), width)
            yield codes, np.array([r.y for r in got], float), np.array([r.n for r in got], np.int64), np.array([r.label for r in got]), np.array([r.held for r in got])

    return run


def _scored(block: tuple, trees: BoostedTrees) -> np.ndarray:
    """(label, bin of the score): rows, those of class 1, and the least and the greatest score of held-back rows."""
    codes, y, n, label, held = block
    out = _no_scores()
    score = 1 / (1 + np.exp(-trees.coded(codes[held])))
    at = ((label[held] - 4) * SCORE_BINS + np.minimum((score * SCORE_BINS).astype(np.int64), SCORE_BINS - 1))
    flat = out.reshape(-1, 4)
    np.add.at(flat[:, 0], at, n[held])
    np.add.at(flat[:, 1], at, n[held] * y[held])
    np.minimum.at(flat[:, 2], at, score)
    np.maximum.at(flat[:, 3], at, score)
    return out


def _no_scores() -> np.ndarray:
    return np.tile(np.array([0.0, 0.0, 2.0, 0.0]), (2, SCORE_BINS, 1))


def _both_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a[..., :2] + b[..., :2], np.minimum(a[..., 2:3], b[..., 2:3]), np.maximum(a[..., 3:], b[..., 3:])], axis=-1)


def _threshold(bins: np.ndarray) -> float | None:
    """Midway, 0.5 at least, between the least score of the lowest bin from which on the precision is PRECISION and the next lower score; None if there is none. Scores of a bin
    are selected together."""
    own = bins[bins[:, 0] > 0][::-1]
    good = np.flatnonzero(np.cumsum(own[:, 1]) >= PRECISION * np.cumsum(own[:, 0]))
    if not len(good):
        return None
    lower = own[good[-1] + 1, 3] if good[-1] + 1 < len(own) else 0.0
    return max(0.5, float(own[good[-1], 2] + lower) / 2)


def fit_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_candidates: int | None = None) -> PiiModel:
    """Learn from the candidates of all documents with a digit or an at sign. ``most_candidates`` bounds the distinct ones, half of each class, drawn by hash, for a model of a glance;
    None: all."""
    text = F.col(text_col).cast("string")
    rows = df.select(text.alias("text")).where(F.col("text").rlike("[0-9@]"))
    found = rows.mapInArrow(_examples(None if most_candidates is None else MOST_OF_ONE), "x array<double>, y int, label int, held boolean").distinct()
    by = ["x", "label", "held"]
    if most_candidates is not None:
        first = [found.where(F.col("y") == y).orderBy(F.xxhash64(*by), *by).limit(max(1, most_candidates // 2)) for y in (0, 1)]
        found = first[0].union(first[1])
    distinct = materialize(found, "candidates")
    taught = distinct.where("not held")
    own = F.when(~F.col("held"), F.col("y"))
    n_all, n, n_personal = distinct.agg(F.count("*"), F.count(own), F.coalesce(F.sum(own), F.lit(0))).first()
    if not 0 < n_personal < n:
        return PiiModel(None, {})
    cuts = [float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]]
    values = taught.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", cuts, 10_000).alias("e"))
    edges = [np.unique(r.e) for r in values.orderBy("f").collect()]  # BINS - 1 of each feature
    coded = distinct.mapInArrow(_coded(edges), "code binary, y int, label int, held boolean").groupBy("code", "y", "label", "held").agg(F.count("*").alias("n"))
    blocks = coded.coalesce(-(-n_all // TASK_ROWS)).rdd.mapPartitions(_blocks(len(edges))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def counted(trees: BoostedTrees, feature: np.ndarray, at_bin: np.ndarray, level: int) -> np.ndarray:
            add = lambda out, b: out + sums_of((b[0][~b[4]], b[1][~b[4]], b[2][~b[4]]), trees, feature, at_bin, level)
            return blocks.treeAggregate(np.zeros((2**level, len(edges), BINS, 3), np.int64), add, np.add)

        trees = BoostedTrees.grow(edges, n_personal / n, counted)
        bins = blocks.treeAggregate(_no_scores(), lambda out, b: _both_scores(out, _scored(b, trees)), _both_scores)
    finally:
        blocks.unpersist()
    found = {k: _threshold(bins[k - 4]) for k in (4, 5)}
    return PiiModel(trees, {k: t for k, t in found.items() if t is not None})


def _found(model: PiiModel) -> Callable:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"start": s, "stop": e, "kind": LABELS[k], "score": score} for s, k, e, score in model.spans(text)]
                for texts in _texts(batch.column(1)) for text in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    return run


def pii_spans(df: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of start, stop, kind, score) of every row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, spans array<struct<start:long,stop:long,kind:string,score:double>>"
    return rows.mapInArrow(_found(model), schema).withColumnRenamed("id", id_col)


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of pii_spans' rows."""
    is_base = lambda s: s["kind"].isin(*KINDS)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter("spans", is_base)), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, model: PiiModel, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of df, whole, with every span of the text as [KIND]; overlapping spans go together. length_col gets the new length."""
    at = df.columns.index(text_col)
    long_at = df.columns.index(length_col) if length_col else None

    def cleaned(text: str) -> str:
        out, last = [], 0
        for s, k, e, _ in model.spans(text):
            if s >= last:
                out += [text[last:s], f"[{LABELS[k].upper()}]"]
            last = max(last, e)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, null = list(batch.columns), batch.column(at).is_null().to_pylist()
            texts = [cleaned(t) for part in _texts(batch.column(at)) for t in part]
            columns[at] = pa.array([None if n else t for t, n in zip(texts, null)], batch.schema.field(at).type)
            if long_at is not None:
                old = columns[long_at].to_pylist()
                columns[long_at] = pa.array([x if n else len(t) for t, n, x in zip(texts, null, old)], batch.schema.field(long_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
