"""Decontamination against greedy string tiling by exhaustion."""

import random

import brute

from polescale.llm import decontam

ITEM = " ".join(f"q{i}" for i in range(40))
KINDS = "text string"


def greedy(a, b, least):
    """Tiles of item words a and document words b by exhaustion: lengths, in the order in which they are marked."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < max(1, least):
            return out
        out.append(k)
        used_a |= set(range(i, i + k))
        used_b |= set(range(j, j + k))


def plain(docs, items, threshold=0.5):
    out = []
    for d, t in docs:
        for i, x in items:
            a, b = brute.words(x), brute.words(t)
            if a and (got := greedy(a, b, min(5, len(a)))) and sum(got) >= threshold * len(a):
                out.append((d, i, len(a), sum(got), len(got), max(got), round(sum(got) / len(a), 9)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.leaks(spark, d, b, **more).collect()
    return sorted(((r.doc_id, r.item_id, r.n_words, r.n_covered, r.n_tiles, r.longest_tile, round(r.coverage, 9)) for r in rows), key=str)


def test_leaks(spark):
    w = ITEM.split()
    moved = " ".join(w[20:] + ["x", "y"] + w[:20])
    docs = [(1, f"before {ITEM.upper()} after"), (2, moved), (3, " ".join(w[:18])), (4, None), (5, ""), (6, "clean " * 500), (7, "too short item"), (8, "z r1 r2 r3 r4 r5 r6 r7"), (9, " ".join(w[:21])), (10, " ".join(w[:20])), (None, ITEM)]
    items = [(1, ITEM), (2, None), (3, "too SHORT item"), (4, "r1 r2 r3 r4 r5 r6 r7"), (5, " "), (6, "clean")]
    got = {x[:2]: x[3:5] for x in run(spark, docs, items)}
    assert got == {(1, 1): (40, 1), (2, 1): (40, 2), (8, 4): (7, 1), (9, 1): (21, 1), (10, 1): (20, 1), (None, 1): (40, 1), (7, 3): (3, 1), (6, 6): (1, 1)}
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [], []) == []


def test_against_exhaustion(spark):
    """Words of a small vocabulary, so tiles overlap and tie; also short, equal and null items."""
    rng = random.Random(3)
    make = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 4, 5, 6, 12, 25]), "abC")) for i in range(25)]
    docs = [(i, make(rng.randrange(0, 12), "abc") + " " + " ".join((rng.choice(items)[1] or "").split()[rng.randrange(3) :]) + "\n" + make(rng.randrange(0, 9), "abd")) for i in range(25)]
    items += [(3, "a b a b a b"), (None, "a b a b a b"), (50, None)]
    docs += [(4, docs[5][1]), (None, docs[5][1]), (None, docs[5][1])]
    for threshold in (0.5, 1.0):
        assert run(spark, docs, items, threshold=threshold) == plain(docs, items, threshold)


def test_odd_rows(spark):
    """A very long text, one bit of filter, and clashing names."""
    names = "_uid string, key int, item int, doc int, j int, n_words int, hits int, item_id int"
    docs = spark.createDataFrame([(1, "w " * 300_000 + ITEM, "x", *range(7)), (None, None, "x", *range(7))], f"doc_id long, text string, {names}")
    items = spark.createDataFrame([(1, ITEM, "x", *range(6)), (1, "w w w w w w", "y", *range(6))], "item_id long, text string, _uid string, key int, item int, doc int, j int, n_words int, hits int")
    got = sorted((r.n_words, r.n_covered) for r in decontam.leaks(spark, docs, items).collect())
    assert got == [(6, 6), (40, 40)]


def test_full_bitmap(spark, monkeypatch):
    """A bitmap that tells nothing apart changes nothing."""
    monkeypatch.setattr(decontam, "FILTER_BITS", 64)
    docs = [(1, ITEM), (2, "a b c d e f " * 9)]
    assert run(spark, docs, [(1, ITEM), (2, "a b c d e f")]) == plain(docs, [(1, ITEM), (2, "a b c d e f")])
