"""Words and word shingles of whole Arrow string columns, as numpy arrays.

Work goes by slices of a few MB of text, so memory does not follow the size
of an Arrow batch; one document is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 2 << 20
#: Where a text becomes some 30 times its bytes in numpy arrays: of half a MB, so a worker needs less than 20 MB for them.
PART = 512 << 10
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A fingerprint of the ordered pairs."""
    z = x * _M1 + (y ^ (y >> U(31))) * _M3
    return z ^ (z >> U(32))


def unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, each value's place among them, the order that sorts ``x``, and where in it each value begins.

    ``np.unique`` sorts stably when asked for places, which takes several times as long.
    """
    order = np.argsort(x)
    s = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], place, order, np.flatnonzero(new)


_BYTE = mix(np.arange(1, 257, dtype=U) * _M1)
_POW = np.multiply.accumulate(np.full(4096, U(0xD6E8FEB86659FD93)))


def powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.multiply.accumulate(np.full(1 << (n - 1).bit_length(), U(0xD6E8FEB86659FD93)))
    return _POW[:n]


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``size`` bytes; null is empty."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words of each document."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs) - 1, np.int64)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, offs))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word, A-Z lower-cased."""
    if not len(s):
        return np.zeros(0, U)
    ln = e - s
    # bytes of the words only, one after another
    at = np.repeat(s - np.concatenate([[0], np.cumsum(ln)[:-1]]), ln) + np.arange(ln.sum())
    first = np.concatenate([[0], np.cumsum(ln)[:-1]])
    inner = np.arange(len(at)) - np.repeat(first, ln)
    total = np.add.reduceat(_BYTE[LOWER[data[at]]] * powers(int(ln.max()))[inner], first)
    return mix(total + ln.astype(U))


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct fingerprints of its k-word shingles (all words as one, if fewer)."""
    s, e, counts = words(data, offs)
    h = word_hashes(data, s, e)
    n = len(h)
    grams = h
    for j in range(1, k):
        grams = pair(grams[: max(0, n - j)], h[j:])
    grams = mix(grams)
    at = 0
    for c in counts.tolist():
        if c >= k:
            yield np.unique(grams[at : at + c - k + 1])
        elif c:
            g = h[at : at + 1]
            for j in range(1, c):
                g = pair(g, h[at + j : at + j + 1])
            yield mix(g + U(c))
        else:
            yield np.zeros(0, U)
        at += c
