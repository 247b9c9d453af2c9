"""The same model with dictionaries, over lists of words, of any order."""

import math
import zlib
from collections import Counter
from functools import cache

from brute import words

K = 5
END = "\0end"


def discounts(counts):
    n = Counter(counts.values())
    for k in range(K, 1, -1):
        if all(n[r] for r in range(1, k + 2)) and (rest := 1 - (k + 1) * n[k + 1] / n[1]) > 0:
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - (1 - rest)) / rest for r in range(1, k + 1)}
            if all(0 < x < 1 for x in d.values()):
                return lambda r: r * d.get(r, 1.0)
    minus = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return lambda r: max(r - minus, 0.0)


def model(rows, order):
    """(texts' tokens, held out, P(w | history tuple), unigram counts) for rows (doc_id, text)."""
    texts = {d: [*words(t), END] for d, t in rows}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = {k: Counter() for k in range(1, order + 1)}
    for d, w in texts.items():
        if not held[d]:
            padded = [END] * (order - 1) + w
            for i in range(order - 1, len(padded)):
                for k in counts:
                    counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    disc = {k: discounts(counts[k]) for k in counts}
    one, n = counts[1], sum(counts[1].values())
    left = 1 - sum(disc[1](c) for c in one.values()) / n if n else 1.0
    after = {}
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after.setdefault(g[:-1], []).append((g[-1], c))

    @cache
    def weigh(h):
        """(count, whether nothing is discounted, backoff weight) of a history seen in training."""
        c = sum(x for _, x in after[h])
        rest = 1 - sum(disc[len(h) + 1](x) for _, x in after[h]) / c
        full = rest < 1e-12
        return c, full, (1 / (c + 1) if full else rest) / (1 - sum(p(w, h[1:]) for w, _ in after[h]))

    def p(w, h):
        if not h:
            return (disc[1](one[w,]) / n if one[w,] else left) if n else 1.0
        if h not in after:
            return p(w, h[1:])
        c, full, weight = weigh(h)
        if x := counts[len(h) + 1][(*h, w)]:
            return disc[len(h) + 1](x) / c * (c / (c + 1) if full else 1)
        return weight * p(w, h[1:])

    return texts, held, p, Counter({g[0]: c for g, c in one.items()})


def scores(rows, order):
    texts, held, p, one = model(rows, order)
    n, v = sum(one.values()), len(one)
    out = {}
    for d, w in texts.items():
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        padded = [END] * (order - 1) + w
        score = sum(math.log10(p(x, tuple(padded[i : i + order - 1]))) for i, x in enumerate(w))
        out[d] = (held[d], len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out
