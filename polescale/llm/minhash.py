"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A document's set holds the 64-bit fingerprints of its distinct 5-word
shingles (A-Z lower-cased; fewer words: all of them as one; no word: empty).
Two documents are linked if their Jaccard similarity is at least
``percent``/100.

1. Documents with equal sets form a class; only classes go on, as numbers.
2. 252 MinHash samples of a class are cut into 42 bands of 6. A pair of
   similarity 0.85 shares no band with probability 2e-9.
3. The samples are folded into a parity bitmap, the odd sketch (Mitzenmacher,
   Pagh and Pham 2014). The population count of the XOR of two bitmaps
   estimates the similarity; candidates far below the threshold stop here.
4. In every bucket each class is compared with one centre only, that member
   which shares most buckets with others, so work is linear in the bucket.
   Sketches first, then full sets.
5. Components of those links are found. Buckets left with two or more
   components are checked for the missing links in blocks: a block's exact
   intersections are one matrix product, and at most a spanning forest of
   its links leaves the task. Equal buckets are checked once.
6. Components of all links give the result.

Full sets are made only of texts that a comparison needs. They are fetched by
an exact join; before it, a bitmap of fixed size (``FILTER_BITS``, whatever
the corpus) lets pass only texts that may be wanted, so others aren't shuffled.

Defined results: null or blank text has an empty set, is linked with nothing
and kept. Repeated rows have equal sets and so share a component; the rows
with the smallest doc_id are kept. A component's id is its smallest non-null
doc_id; a row whose doc_id is null is kept only if its whole component has
none. A similarity of exactly ``percent`` links. Very long texts are taken
whole, one at a time. Empty tables give empty results; extra columns, with
whatever names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm import textnp
from polescale.llm.common import Workspace, bitmap, components, documents_of
from polescale.llm.textnp import U

BANDS, ROWS = 42, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Standard deviation of the similarity from SAMPLES samples and of the sketch is about 0.03 at 0.85; six of them.
MARGIN = 0.18
BLOCK = 512
#: Words that a block's product takes in at once: what it needs beside its sets doesn't follow the length of the texts.
PART_WORDS = 1 << 18
#: Size of the bitmap of wanted documents: 4 MB for any corpus.
FILTER_BITS = 1 << 25

_rng = np.random.default_rng(20140407)
_A = (_rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64) | U(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_SALT = textnp.mix(_rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64))


def minhashes(values: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a non-empty set under as many fixed permutations of 32-bit values."""
    v = (values >> U(32)).astype(np.uint32)
    low = None
    for at in range(0, len(v), 512):
        part = (v[None, at : at + 512] * _A + _B).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def bands_and_sketches(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (documents, SAMPLES) minima: (documents, BANDS) keys, and the bitmaps as (documents, SKETCH_BITS / 64)."""
    x = textnp.mix(samples.astype(U) ^ _SALT)
    n = len(x)
    keys = x.reshape(n, BANDS, ROWS)
    out = np.zeros((n, BANDS), U)
    for j in range(ROWS):
        out = textnp.pair(out, keys[:, :, j])
    bit = (x % U(SKETCH_BITS)).astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = (np.bincount(bit.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return textnp.mix(out), np.packbits(odd, axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in textnp.slices(b.column(2), textnp.PART):
            sizes, node, rows, mins = [], [], [], []
            for r, v in enumerate(textnp.shingle_sets(data, offs)):
                sizes.append(len(v))
                if len(v):
                    node.append(_node(v))
                    mins.append(minhashes(v))
                    rows.append(r)
                else:
                    node.append(None)
            keys = [None] * (j - i)
            marks = [None] * (j - i)
            if rows:
                k, s = bands_and_sketches(np.stack(mins))
                k = k.view(np.int64)
                for at, r in enumerate(rows):
                    keys[r], marks[r] = k[at], s[at]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(node, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                names=["_uid", "_id", "n", "node", "keys", "sketch"],
            )


def signatures(base: DataFrame) -> DataFrame:
    """``_uid, _id, n`` (set size), ``node`` (fingerprint of the set, null if empty), ``keys`` (bands), ``sketch``."""
    return base.select("_uid", "_id", "_text").mapInArrow(_signatures, "_uid long, _id long, n long, node string, keys array<long>, sketch array<long>")


def _node(v: np.ndarray) -> str:
    return f"{int(v.sum(dtype=U)):016x}{int(textnp.mix(v ^ U(len(v))).sum(dtype=U)):016x}"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in textnp.slices(b.column(1), textnp.PART):
            sets = list(textnp.shingle_sets(data, offs))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
            own = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i)]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64))], names=["cid", "hub", "words", "n"])


def _filtered(spark: SparkSession, base: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """``base`` without most rows whose ``_uid`` is not among ``wanted.first``: those that a bitmap of ``bits`` hashes tells apart."""
    hashed = lambda c: F.xxhash64(c)
    sent = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("first").alias("h")), "h", bits))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(sent.value.hit(h.to_numpy()))

    return base.where(may(F.xxhash64("_uid")))


def similarity(x: Column, y: Column) -> Column:
    """Estimated Jaccard similarity of two odd sketches; 0 where the bitmaps differ too much to tell."""
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    share = F.lit(1.0) - F.lit(2.0 / SKETCH_BITS) * apart
    return F.when(share > 0.01, 1.0 + F.log(share) * (SKETCH_BITS / (4.0 * SAMPLES))).otherwise(0.0)


def _links(percent: int):
    """Exact links across components within a block of classes, as a spanning forest."""
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        names, comps = pdf["cid"].to_numpy(), pdf["comp"].to_numpy()
        sets = [np.asarray(x, np.int64).view(U) for x in pdf["words"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        n = len(names)
        both = np.zeros((n, n), np.float32)
        step = max(1, (1 << 22) // max(1, n))
        # sets are sorted: part by part of the range of fingerprints
        parts = max(1, -(-int(sizes.sum()) // PART_WORDS))
        inner = np.array([k * (1 << 64) // parts for k in range(1, parts)], U)
        cuts = [[0, *np.searchsorted(x, inner).tolist(), len(x)] for x in sets]
        for k in range(parts):
            own = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)]
            each = np.repeat(np.arange(n), [len(x) for x in own])
            _, inverse, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            shared = times > 1
            column = np.cumsum(shared) - 1
            use = shared[inverse]
            each, cols = each[use], column[inverse[use]]
            order = np.argsort(cols, kind="stable")
            each, cols = each[order], cols[order]
            for at in range(0, int(shared.sum()), step):
                lo, hi = np.searchsorted(cols, [at, at + step])
                m = np.zeros((n, min(step, int(shared.sum()) - at)), np.float32)
                m[each[lo:hi], cols[lo:hi] - at] = 1
                both += m @ m.T
        both = both.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        a, b = np.nonzero(np.triu(100 * both >= percent * union, 1))
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if (x := root(comps[i])) != (y := root(comps[j])):
                parent[x] = y
                out.append((names[i], names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``; see the module's text."""
    ws = Workspace(spark, "minhash")
    base = documents_of(ws, docs)
    sig = ws.save(signatures(base), "signatures")
    classes = sig.where("n > 0").groupBy("node").agg(F.min("_uid").alias("first"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    # a class is a number from here on; it is written with the class, so every reader sees the same
    classes = ws.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # buckets of two or more classes, equal ones once
    banded = classes.select("cid", F.posexplode("keys").alias("band", "key")).select("cid", F.xxhash64("band", "key").alias("key"))
    again = ws.save(banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "repeated")
    shared = ws.save(banded.join(again, "key"), "shared")
    ws.drop(again)
    buckets = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "cid")).alias("y"))
    once = ws.save(buckets.groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).select("key", "size", "times"), "buckets")
    members = ws.save(shared.join(once, "key"), "members")
    ws.drop(shared)

    # one centre for each bucket
    weight = members.groupBy("cid").agg(F.sum(F.col("size") * F.col("times")).alias("weight"))
    members_ = ws.save(members.select("key", "cid").join(ws.save(weight, "weights"), "cid"), "weighed")
    centre = ws.save(members_.groupBy("key").agg(F.max(F.struct("weight", "cid")).getField("cid").alias("centre")), "centres")
    star = members.select("key", "cid").join(centre, "key").where("cid <> centre").select("cid", "centre").distinct()
    mark = classes.select("cid", "sketch")
    star = star.join(mark, "cid").join(mark.select(F.col("cid").alias("centre"), F.col("sketch").alias("other")), "centre")
    star = ws.save(star.where(similarity(F.col("sketch"), F.col("other")) >= percent / 100 - MARGIN).select("cid", "centre"), "star")
    ws.drop(members_, centre)

    # full sets of the classes that are compared: with a centre (hub: as one), or later within a bucket
    needed = star.select("cid", F.lit(0).alias("hub")).union(star.select("centre", F.lit(1))).union(members.where("size > 2").select("cid", F.lit(0)))
    wanted = needed.groupBy("cid").agg(F.max("hub").alias("hub")).join(classes.select("cid", "first"), "cid")
    wanted = ws.save(wanted.select("cid", F.col("hub") == 1, "first").toDF("cid", "hub", "first"), "wanted")
    texts = _filtered(spark, base, wanted, FILTER_BITS)
    texts = texts.hint("merge").join(wanted.hint("merge"), F.col("_uid") == F.col("first")).select("cid", "_text", "hub")
    sets = ws.save(texts.mapInArrow(_sets, "cid long, hub boolean, words array<long>, n long"), "sets")

    y = sets.where("hub").select(F.col("cid").alias("centre"), F.col("words").alias("others"), F.col("n").alias("m"))
    both = F.size(F.array_intersect("words", "others"))
    linked = star.join(sets.select("cid", "words", "n"), "cid").join(y, "centre").where(100 * both >= percent * (F.col("n") + F.col("m") - both))
    edges = ws.save(linked.select(F.col("cid").alias("a"), F.col("centre").alias("b")), "edges")
    comp = ws.save(components(ws, edges), "components")

    # buckets whose links aren't all known yet; in one of two classes the star was the only pair
    named = members.where("size > 2").select("key", "cid", "size").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = ws.save(named, "named")
    open_ = ws.save(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "open")
    rest = named.join(open_, "key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("own", own)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "cid", "comp")
    more = rest.join(sets.select("cid", "words"), "cid").groupBy("key", "p", "q").applyInPandas(_links(percent), "a long, b long")
    edges = ws.save(edges.union(more), "links")
    ws.drop(sets, named, open_)
    comp = components(ws, edges)

    # class -> smallest doc_id of its component; _uid rises with doc_id, nulls last
    named = classes.select("node", "cid", "first").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    low = ws.save(named.groupBy("comp").agg(F.min("first").alias("least")), "least")
    place = named.join(low, "comp").select("node", "least")
    place = ws.save(place.join(sig.select(F.col("_uid").alias("least"), F.col("_id").alias("component_id")), "least").select("node", "component_id"), "places")
    out = sig.select("_id", F.col("n").alias("n_shingles"), "node").join(place, "node", "left")
    own_id = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", own_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
