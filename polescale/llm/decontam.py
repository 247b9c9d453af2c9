"""Benchmark decontamination by greedy string tiling (Wise 1993).

Test items and documents are word sequences (A-Z lower-cased). A tile is a
run of at least ``SEED`` words that stands in both; greedy tiling marks the
longest runs of unmarked words first, so reordered passages are still covered
piece by piece. An item's coverage is the share of its words under tiles;
from ``threshold`` on, the document leaks the item. An item of fewer words
than ``SEED`` is one seed as a whole: a document leaks it if it holds it.

The running Karp-Rabin step is one pass over items and one over documents:
fingerprints of all ``SEED``-word windows, joined by equality. A bitmap of
fixed size (``FILTER_BITS``) of the items' fingerprints goes to the tasks that
read documents, so only windows that may be an item's are shuffled. Pairs that
share windows on enough words for the threshold are tiled, each by itself:
what a task holds is the shared places of one document and one item. Neither
items nor documents are collected, and a window that stands in very many
documents is split by adaptive execution, as it meets its items in a plain join.

Defined results: null or empty texts leak nothing, and items without a word
are never leaked. Equal tiles: see ``tiles``; coverage of exactly the
threshold leaks. Very long texts are taken whole. Repeated documents or items,
also with null or repeated ids, each give their own rows. Empty tables give an
empty result; extra columns, with whatever names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm import textnp
from polescale.llm.common import Workspace, bitmap, documents_of
from polescale.llm.textnp import U

SEED = 5
THRESHOLD = 0.5
#: Size of the bitmap of the items' windows: 4 MB for any benchmark.
FILTER_BITS = 1 << 25


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the windows of k words."""
    g = h
    for j in range(1, k):
        g = textnp.pair(g[: max(0, len(h) - j)], h[j:])
    return textnp.mix(g[: max(0, len(h) - k + 1)] + U(k))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items: fingerprint, item, number of words of the item, place."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, _, data, offs in textnp.slices(b.column(1), textnp.PART):
            s, e, counts = textnp.words(data, offs)
            h, at = textnp.word_hashes(data, s, e), 0
            for r, c in enumerate(counts.tolist()):
                if c:
                    g = _grams(h[at : at + c], min(c, SEED))
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), ids[i + r])), pa.array(np.full(len(g), c)), pa.array(np.arange(len(g)))], names=["key", "item", "n_words", "i"])
                at += c


def _windows(sizes: list[int], mask):
    """Windows of documents that may be an item's: fingerprint, document, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, data, offs in textnp.slices(b.column(1), textnp.PART):
                s, e, counts = textnp.words(data, offs)
                h = textnp.word_hashes(data, s, e)
                first = np.concatenate([[0], np.cumsum(counts)])
                for k in sizes:
                    g = _grams(h, k).view(np.int64)
                    at = np.flatnonzero(mask.value.hit(g))
                    row = np.searchsorted(first, at, "right") - 1
                    inside = at + k <= first[row + 1]
                    at, row = at[inside], row[inside]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(ids[i + row]), pa.array(at - first[row])], names=["key", "doc", "j"])

    return run


def tiles(hits: list[tuple[int, int]], seed: int = SEED) -> list[tuple[int, int, int]]:
    """(item word, document word, length) of greedy tiles, longest first, from the places (item, document) of equal windows.

    Of tiles of one length the first in the item goes first, then the first in the document.
    """
    runs: list[list[int]] = []
    ends: dict[int, int] = {}
    for i, j in sorted(hits, key=lambda x: (x[0] - x[1], x[0])):
        if runs and ends.get(i - j) == i - 1:
            runs[-1][2] += 1
        else:
            runs.append([i, j, seed])
        ends[i - j] = i
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    used_i: set[int] = set()
    used_j: set[int] = set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [k for k in range(-n) if i + k not in used_i and j + k not in used_j]
        if len(free) == -n:
            out.append((i, j, -n))
            used_i.update(range(i, i - n))
            used_j.update(range(j, j - n))
            continue
        # what is left of it goes back, in its unmarked stretches
        start = 0
        for at in range(1, len(free) + 1):
            if at == len(free) or free[at] != free[at - 1] + 1:
                if at - start >= seed:
                    heapq.heappush(heap, (start - at, i + free[start], j + free[start]))
                start = at
    return out


def _tile(threshold: float):
    """Pairs with the places of their shared windows: those whose tiles cover enough of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, item, n, hits in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                i, j = (x.to_pylist() for x in hits.values.flatten())
                if len({a + d for a in set(i) for d in range(min(n, SEED))}) >= threshold * n:
                    t = tiles(list(zip(i, j, strict=True)), min(n, SEED))
                    covered = sum(x[2] for x in t)
                    if covered >= threshold * n:
                        out.append((doc, item, n, covered, len(t), max(x[2] for x in t), covered / n))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.float64())], names=["doc", "item", "n_words", "n_covered", "n_tiles", "longest_tile", "coverage"])

    return run


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, n_words, n_covered, n_tiles, longest_tile, coverage`` and ``_uid`` for each leaking pair."""
    ws = Workspace(spark, "leaks")
    base, items = documents_of(ws, docs), documents_of(ws, benchmark, key="item_id")
    seeds = ws.save(items.select("_uid", "_text").mapInArrow(_seeds, "key long, item long, n_words long, i long"), "seeds")
    sizes = sorted(r[0] for r in seeds.select(F.least("n_words", F.lit(SEED)).cast("int")).distinct().collect())  # SEED rows at most
    mask = spark.sparkContext.broadcast(bitmap(seeds, "key", FILTER_BITS))
    found = base.select("_uid", "_text").mapInArrow(_windows(sizes, mask), "key long, doc long, j long")
    # places of shared windows by pair; a window of many items or documents isn't gathered
    pairs = ws.save(found.join(seeds, "key").select("doc", "item", "n_words", "i", "j"), "places")
    pairs = pairs.groupBy("doc", "item", "n_words").agg(F.collect_list(F.struct("i", "j")).alias("hits"))
    enough = F.least("n_words", F.lit(SEED)) * F.size(F.array_distinct(F.col("hits.i"))) >= threshold * F.col("n_words")
    kinds = "doc long, item long, n_words long, n_covered long, n_tiles long, longest_tile long, coverage double"
    out = ws.save(pairs.where(enough).mapInArrow(_tile(threshold), kinds), "leaks")
    out = out.join(items.select(F.col("_uid").alias("item"), F.col("_id").alias("item_id")), "item")
    out = out.join(base.select("_uid", F.col("_id").alias("doc_id")), F.col("doc") == F.col("_uid"))
    return out.select("doc_id", "item_id", "n_words", "n_covered", "n_tiles", "longest_tile", "coverage", "_uid")
