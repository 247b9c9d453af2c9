"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near(rows, percent=85):
    """rows (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component_id, kept)}."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    both = Counter()
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def repeats(rows, k=100):
    """rows (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            s = b[i : i + k]
            if s in seen:
                gone[i : i + k] = b"\x01" * k
            else:
                seen.add(s)
        runs = re.findall(rb"\x01+", bytes(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(map(len, runs)), len(runs), hashlib.sha256(left).hexdigest())
    return out


def repeat_words(w, k=8):
    c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    hit = set()
    for i in range(len(w) - k + 1):
        if c[tuple(w[i : i + k])] > 1:
            hit.update(range(i, i + k))
    return len(hit)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    r = repeat_words(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, len(w) < 20 or 100 * r > 30 * len(w)
