"""Removal of repeated byte strings: prefix doubling over sampled positions.

A byte of a document goes if it is covered by a string of ``length`` bytes
(100) that also starts earlier: in a document of smaller doc_id, or earlier
in the same one. Strings never cross documents.

Classical prefix doubling names every position by its first h bytes, sorts
(name at p, name at p + h) pairs to name the first 2h bytes, and goes on
with positions that still share a name, until they differ or h passes the
threshold. With a row for each byte and round, that needs some 40 bytes of
shuffle for each byte of text. Here the same rounds run on few positions:

* Names up to ``length`` bytes are fingerprints, built by doubling inside
  each document (h = 1, 2, 4, ... 64, then 100 from two overlapping 64s), so
  naming needs no sort.
* Round 32: a window of 100 bytes is represented by its smallest 32-byte
  name (its anchor). Equal windows have equal anchors, so neighbouring windows
  with one anchor form a unit, and a unit whose anchor stands nowhere else
  drops out for good.
* Round 100 and more: (anchor, name of the whole unit) pairs. All units but
  the first of each pair are covered entirely.
* Last round: where an anchor has several different units, their windows'
  100-byte names are ranked in order of (document, position); all but the
  first of each name are covered. An anchor with very many units is dealt out
  by a part of the window's name, so no task holds an unbounded group. A unit's
  windows come back as one bitmap a row, so rows out never exceed rows in.

Names are 64-bit; only strings that agree on the anchor as well (another 64
bits) are ever compared, so a false match takes a collision of both.

Defined results: null or empty text gives 0 bytes, 0 removed and the digest of
nothing. Texts shorter than ``length`` are left alone; very long ones are
taken whole, one at a time. Rows that repeat a doc_id, or have none (last),
are taken in order of their texts (nulls last), as documents of their own, so
of equal texts all but one are emptied. An empty table gives an empty result.
Extra columns, with whatever names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm import textnp
from polescale.llm.common import Workspace, documents_of
from polescale.llm.textnp import U

GRAM = 32
#: Units of one anchor that one task handles together.
GROUP = 1000


def _names(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the GRAM-byte and of the ``length``-byte strings at each position."""
    x = textnp.mix(data.astype(U) + U(1))
    h, gram = 1, None
    while True:
        if h == GRAM:
            gram = x
        if 2 * h > length:
            break
        x = textnp.pair(x[:-h], x[h:])
        h *= 2
    n = len(data) - length + 1
    return gram, textnp.pair(x[:n], x[length - h : length - h + n])


def units(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of at least ``length`` bytes: anchor, name, first window and number of windows of each unit.

    The number is negative if windows of the unit may be equal to one
    another, as in a run of one character.
    """
    gram, window = _names(data, length)
    key = (gram * U(0xD6E8FEB86659FD93)) & ~U(127)
    place = np.arange(len(key), dtype=U) & U(127)
    span, n = length - GRAM + 1, len(window)

    def lowest(x: np.ndarray) -> np.ndarray:
        h = 1
        while 2 * h <= span:
            x = np.minimum(x[:-h], x[h:])
            h *= 2
        return np.minimum(x[:n], x[span - h : span - h + n])

    left, right = lowest(key | place), lowest(key | (U(127) - place))
    twice = (left & U(127)) + (right & U(127)) != U(127)  # the anchor stands at two places of the window
    low = left >> U(7)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(start, n))
    inner = np.arange(n) - np.repeat(start, count)
    name = textnp.mix(np.add.reduceat(window * textnp.powers(int(count.max()))[inner], start) + count.astype(U))
    loop = (np.add.reduceat(twice, start, dtype=np.int64) > 0) | (count > span)
    for k in np.flatnonzero(loop).tolist():
        own = window[start[k] : start[k] + count[k]]
        loop[k] = len(np.unique(own)) < len(own)
    return textnp.mix(low[start]), name, start, np.where(loop, -count, count)


def _units(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in textnp.slices(b.column(1)):
                parts = []
                for r, (lo, hi) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
                    if hi - lo >= length:
                        anchor, name, start, count = units(data[lo:hi], length)
                        parts.append((anchor, name, np.full(len(start), ids[i + r]), start, count))
                if parts:
                    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    at = cols[3].astype(np.int64) << 32 | np.abs(cols[4]) << 1 | (cols[4] < 0)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int64)), pa.array(at)], names=["anchor", "unit", "doc", "at"])

    return run


def _windows(length: int):
    """Texts with a list of (anchor, first window, windows, parts): the windows' names, in as many parts as the anchor needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wanted = b.column(0).to_pylist(), b.column(2)
            for i, j, data, offs in textnp.slices(b.column(1)):
                out: list[list] = [[] for _ in range(6)]
                for r in range(i, j):
                    name = _names(data[offs[r - i] : offs[r - i + 1]], length)[1]
                    for u in wanted[r].as_py():
                        at, n = u["at"], u["n"]
                        own = name[at : at + n]
                        part = (own % U(u["parts"])).astype(np.int64) if u["parts"] > 1 else None
                        for k in [0] if part is None else np.unique(part).tolist():
                            if part is None:
                                row = (u["anchor"], 0, ids[r], at, own.tobytes(), None)
                            else:
                                row = (u["anchor"], k, ids[r], at, own[part == k].tobytes(), np.flatnonzero(part == k).astype(np.int32).tobytes())
                            for to, x in zip(out, row, strict=True):
                                to.append(x)
                    if len(out[0]) >= 4096:
                        yield _window_rows(out)
                        out = [[] for _ in range(6)]
                if out[0]:
                    yield _window_rows(out)

    return run


def _window_rows(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())], names=["anchor", "part", "doc", "at", "names", "places"])


def _later(length: int):
    """Rows sorted by (anchor, part, doc, at): for each at most one row, with a bitmap of its windows whose name came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, U)  # the names of the group that goes on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            anchor, part, doc = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            names = [np.frombuffer(x, U) for x in b.column(4).to_pylist()]
            count = np.fromiter(map(len, names), np.int64, len(names))
            inner = [np.arange(n) if x is None else np.frombuffer(x, np.int32) for n, x in zip(count.tolist(), b.column(5).to_pylist(), strict=True)]
            new = np.concatenate([[last is None or (anchor[0], part[0]) != last], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
            group = np.cumsum(new)
            name, g = np.concatenate(names), np.repeat(group, count)
            head = len(seen) if not new[0] else 0
            if head:
                name, g = np.concatenate([seen, name]), np.concatenate([np.full(head, group[0]), g])
            order = np.lexsort((np.arange(len(name)), name, g))
            n_, g_ = name[order], g[order]
            again = np.zeros(len(name), bool)
            again[order[1:]] = (n_[1:] == n_[:-1]) & (g_[1:] == g_[:-1])
            first = ~again & (g == group[-1])
            seen, last = name[first], (anchor[-1], part[-1])
            again = again[head:]
            cut = np.cumsum([0, *count])
            hit = np.flatnonzero(np.add.reduceat(again, cut[:-1], dtype=np.int64)) if len(again) else np.zeros(0, np.int64)
            if len(hit):
                bits = []
                for r in hit.tolist():
                    gone = inner[r][again[cut[r] : cut[r + 1]]]
                    mask = np.zeros(int(gone[-1]) + 1, np.uint8)
                    mask[gone] = 1
                    bits.append(np.packbits(mask, bitorder="little").tobytes())
                at = b.column(3).take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), at, pa.nulls(len(hit), pa.int64()), pa.array(bits, pa.binary())], names=["doc", "at", "n", "bits"])

    return run


def _spans(found: pa.ListArray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes under covered windows: row, start and end, in order. ``found``: for each row n windows from ``at``, or those of a bitmap."""
    counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at, n, bits = found.flatten().flatten()
    row = np.repeat(np.arange(len(counts)), counts)
    at = at.to_numpy(zero_copy_only=False).astype(np.int64)
    whole = n.is_valid().to_numpy(zero_copy_only=False)
    n = n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[whole]
    raw = [b for b in bits.to_pylist() if b is not None]
    here = np.repeat(np.flatnonzero(~whole), [8 * len(b) for b in raw])
    first = np.repeat(np.cumsum([0, *(8 * len(b) for b in raw)])[:-1], [8 * len(b) for b in raw])
    on = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), bitorder="little"))
    lo = np.concatenate([at[whole], at[here[on]] + on - first[on]])
    hi = np.concatenate([at[whole] + n + (length - 1), lo[len(n) :] + length])
    base = np.cumsum([0, *(sizes + 1)])  # rows side by side, a byte apart
    row = np.concatenate([row[whole], row[here[on]]])
    lo, hi = lo + base[row], hi + base[row]
    order = np.argsort(lo, kind="stable")
    lo, top, row = lo[order], np.maximum.accumulate(hi[order]), row[order]
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1]])) if len(lo) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(lo))[: len(new)] - 1
    return row[new], lo[new] - base[row[new]], top[end] - base[row[new]]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in textnp.slices(b.column(2)):
                row, lo, hi = _spans(b.column(1).slice(i, j - i), np.diff(offs), length)
                known = b.column(2).slice(i, j - i).is_valid().to_pylist()
                first = np.searchsorted(row, np.arange(j - i + 1))
                sha, kept = [], []
                for r in range(j - i):
                    text, own = data[offs[r] : offs[r + 1]], slice(first[r], first[r + 1])
                    left = b"".join(text[x:y].tobytes() for x, y in zip([0, *hi[own].tolist()], [*lo[own].tolist(), len(text)], strict=True))
                    sha.append(hashlib.sha256(left).hexdigest())
                    # a cut may fall inside a character: what is left of it goes from the text, not from the digest
                    kept.append(left.decode("utf-8", "ignore") if known[r] else None)
                gone = np.bincount(row, weights=hi - lo, minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offs).astype(np.int64)), pa.array(gone), pa.array(np.diff(first).astype(np.int64)), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["_uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def removed_windows(ws: Workspace, texts: DataFrame, length: int = 100) -> DataFrame:
    """``doc, at, n, bits``: windows of ``texts`` (_uid, _text) that go: n from ``at``, or those of a bitmap from ``at``."""
    found = ws.save(texts.select("_uid", "_text").mapInArrow(_units(length), "anchor long, unit long, doc long, at long"), "found")
    # at: place of the first window, number of windows, whether they may repeat each other; in the order of the place
    place, count, loop = (lambda c: F.shiftright(c, 32)), (lambda c: F.shiftright(c.bitwiseAND((1 << 32) - 1), 1)), (lambda c: c.bitwiseAND(1))
    # round 32: anchors that stand more than once
    again = ws.save(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.max(loop(F.col("at"))).alias("loop")).where("c > 1 or loop = 1").select("anchor"), "anchors")
    left = ws.save(found.join(again, "anchor"), "units")
    ws.drop(again, found)
    # the first of each unit; later ones are covered
    first = left.groupBy("anchor", "unit").agg(F.min(F.struct("doc", "at")).alias("f"), F.count(F.lit(1)).alias("c"))
    first = ws.save(first.select("anchor", "unit", F.col("f.doc").alias("fdoc"), F.col("f.at").alias("fat"), "c"), "firsts")
    copies = left.join(first.where("c > 1").select("anchor", "unit", "fdoc", "fat"), ["anchor", "unit"]).where("doc <> fdoc or at <> fat")
    copies = ws.save(copies.select("doc", place(F.col("at")).alias("at"), count(F.col("at")).alias("n"), F.lit(None).cast("binary").alias("bits")), "copies")
    ws.drop(left)
    # anchors of several units: by window. A table of its own, so that the join stands alone and a hot anchor can be split
    several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("u"), F.max(loop(F.col("fat"))).alias("loop")).where("u > 1 or loop = 1").select("anchor", F.ceil(F.col("u") / GROUP).cast("long").alias("parts"))
    several = ws.save(several, "several")
    wanted = first.join(several, "anchor").select(F.col("fdoc").alias("_uid"), F.struct("anchor", place(F.col("fat")).alias("at"), count(F.col("fat")).alias("n"), "parts").alias("u"))
    wanted = wanted.groupBy("_uid").agg(F.collect_list("u").alias("wanted"))  # at most a text's own units
    rows = texts.join(wanted, "_uid").select("_uid", "_text", "wanted").mapInArrow(_windows(length), "anchor long, part long, doc long, at long, names binary, places binary")
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc", "at")
    later = ws.save(rows.mapInArrow(_later(length), "doc long, at long, n long, bits binary"), "later")
    ws.drop(first, several)
    return copies.union(later)


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` and ``_uid`` for each row of ``docs``."""
    ws = Workspace(spark, "suffix")
    base = documents_of(ws, docs)
    gone = removed_windows(ws, base, length)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "bits")).alias("found"))  # at most a text's own
    joined = base.join(gone, F.col("_uid") == F.col("doc"), "left")
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    done = joined.select(F.struct("_uid", "_id").alias("key"), "found", "_text").mapInArrow(_cut(length), f"_uid struct<_uid:long,_id:long>, {kinds}")
    return done.select(F.col("_uid._id").alias("doc_id"), F.col("_uid._uid").alias("_uid"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
