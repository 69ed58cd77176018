"""Slow, plain versions of the operators, for the tests."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def covered(n):
        seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = set()
        for i in range(len(words) - n + 1):
            if seen[tuple(words[i : i + n])] > 1:
                inside.update(range(i, i + n))
        return inside

    chars = sum(map(len, words))
    first, dup = set(), []
    for x in lines:
        if x in first:
            dup.append(x)
        first.add(x)
    n_repeat = len(covered(8))
    out = {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(dup), "n_repeat_words": n_repeat,
    }
    failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    fine = sum(map(len, dup)) <= 0.2 * max(1, sum(map(len, lines)))
    for n, limit in {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}.items():
        fine &= sum(len(words[i]) for i in covered(n)) / max(chars, 1) <= limit
    return out | {"base_failed": failed, "kept": fine and not failed}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def digest(spans, names):
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def runs(words, least_words=24, least_periods=3):
    """Start, length and smallest period of every run, by trying all periods."""
    out, n = [], len(words)
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if j > i and len(own) >= max(least_words, least_periods * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)
