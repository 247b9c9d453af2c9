"""Katz backoff scores of whole texts from an n-gram model (trigrams by default) of the training texts.

Tokens of a text are its words (A-Z lower-cased) and one end; ends are also
what stands before a text's first token. Counts are of training texts only.

* Discounts are Good-Turing's for counts up to K (Katz 1987), from the counts
  of counts; K is for each order the largest up to 5 that gives ratios between
  0 and 1 (groups of equal copies raise single counts of counts). Where none
  from 2 does, as on tiny corpora, an absolute discount D = n1 / (n1 + 2 n2)
  is taken instead.
* Unigrams leave the discounted mass to one unknown type.
* P(w | h) = disc(c(h, w)) / c(h) if the n-gram was seen, else a(h) P(w | h'),
  h' being h without its first word, and so on down to unigrams, with
  a(h) = (1 - seen mass of h) / (1 - sum of P(w | h') over words seen after h),
  so that each history's probabilities sum to 1 exactly. A history whose counts
  are all too large to be discounted leaves 1 / (c(h) + 1). An unseen history
  backs off with weight 1.

Tables are partitioned by ranges of a 64-bit fingerprint of the n-gram and
never broadcast. Texts are taken in blocks of about ``BLOCK`` tokens, formed
as they are read. A block asks for each of its distinct n-grams once: its
sorted fingerprints go to the tables' partitions with the block's own counts,
which are added up there and answered in the same order. So what is shuffled
is a few bytes for each distinct n-gram of a block, never a row for a token,
and a frequent word is one entry a block. A round for each order gives counts,
then one for each length of history the backoff weights; the last pass
evaluates the recursion for each distinct n-gram of a block, from unigrams up.

Only held-out texts back off, as training texts have seen their n-grams; so
blocks are of one kind or the other. A weight is asked for, and its sums are
sent, only for histories from which some held-out token backs off (a bitmap of
``FILTER_BITS`` bits tells most others apart; where it is full, all are sent)
and for those seen more often than counts are discounted, which alone may have
nothing discounted.

The number of partitions follows the measured bytes of the blocks
(``BUCKET_BYTES`` of them a partition, but two for each core at least), so what
a task holds does not grow with the corpus. There is a row for each block and
partition, so their number grows with the square of the corpus: for very large
ones raise ``block`` and ``bucket_bytes`` as far as executors' memory allows.

Defined results: null text is a text of no words (one end). A text trains
unless crc32 of its doc_id mod 5 is 1; null doc_ids train. Repeated rows
count and are scored each. Very long texts are a block of their own. Without
training texts every token has probability 1 of the unknown type. An empty
table gives an empty result; extra columns, with whatever names, are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm import textnp
from polescale.llm.common import Bitmap, Workspace, documents_of, place_of
from polescale.llm.textnp import U

K = 5
ORDER = 3
BLOCK = 600_000
BUCKET_BYTES = 8 << 20
#: Shares in which a round's rows are shuffled.
PARTS = 3
#: Size of the bitmap of histories that are backed off from: 8 MB for any corpus.
FILTER_BITS = 1 << 26
END = textnp.mix(np.array([0x656E64], U))
SCHEMA = "dest long, block long, kind int, bucket int, data binary"
#: Kinds of rows; counts of k-grams and weights of histories of k words are COUNTS + k and WEIGHTS + k.
STREAM, STATS, COUNTS, WEIGHTS = 0, 1, 100, 200


# --- packed arrays --------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """An array as compressed planes of bytes, so that high zero bytes cost nothing."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else np.zeros((x.dtype.itemsize, 0), np.uint8)
    return x.dtype.str.encode().ljust(4) + struct.pack("<q", len(x)) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:4].decode().strip()), struct.unpack("<q", b[4:12])[0]
    raw = np.frombuffer(zstandard.decompress(b[12:], max(1, n * kind.itemsize)), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=U)


def join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def split(b: bytes) -> list[bytes]:
    n = struct.unpack_from("<q", b)[0]
    at, out = 8 * (n + 1), []
    for k in struct.unpack_from(f"<{n}q", b, 8):
        out.append(b[at : at + k])
        at += k
    return out


def borders(buckets: int) -> np.ndarray:
    """First fingerprint of each bucket but the first."""
    return np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], U)


def rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dest", "block", "kind", "bucket", "data"])


def table(out: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows(out)])


# --- blocks -----------------------------------------------------------------------


def asks(block: int, kind: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """A row for each bucket: the block's sorted keys in its range, and what it has to add to them."""
    cut = [0, *np.searchsorted(keys, borders(buckets)).tolist(), len(keys)]
    return [(b, block, kind, b, join(pack_sorted(keys[i:j]), *(pack(v[i:j]) for v in values))) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]


def answers(data: pa.Table, kind: int) -> list[np.ndarray]:
    """A block's answers of one kind, in the order of its keys."""
    mine = sorted((b, d) for k, b, d in zip(data["kind"].to_pylist(), data["bucket"].to_pylist(), data["data"].to_pylist(), strict=True) if k == kind)
    parts = [[unpack(x) for x in split(d)] for _, d in mine]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def block_id(uid: np.int64, held: bool) -> int:
    """Of a block that begins with this text: odd if its texts are held out."""
    z = int(textnp.mix(np.array([uid], np.int64).view(U))[0]) & ~1 | int(held)
    return z - (1 << 64) if z >> 63 else z


class Block:
    """Documents of one block, and its distinct n-grams of lengths up to ``order``, once numbered.

    ``keys[k]`` are the sorted fingerprints of the distinct k-grams, ``gram[k]``
    each token's place among them, ``last[k]`` a token that ends each of them.
    Before a text's first token there are ends only.
    """

    def __init__(self, data: bytes, order: int):
        words, *more = split(data)
        frequent, rare = split(words)
        words = np.concatenate([unpack(frequent), unpack_sorted(rare)])
        self.uids, self.lengths, self.train, tokens = map(unpack, more)
        self.held = not self.train[0]
        self.block = block_id(self.uids[0], self.held)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        order_ = np.argsort(words)
        vocabulary, place = words[order_], np.empty(len(words), np.int64)
        place[order_] = np.arange(len(words))
        tokens = place[tokens]
        self.keys, self.gram, self.last = {1: vocabulary}, {1: tokens}, {1: np.zeros(len(vocabulary), np.int64)}
        self.last[1][tokens] = np.arange(len(tokens))
        #: fingerprints of the grams that end at each token, and of as many ends
        self.here, self.ends = {1: vocabulary[tokens]}, {1: END[0]}
        for k in range(1, order):
            before = np.empty_like(self.here[k])  # the k words before each token
            before[1:] = self.here[k][:-1]
            before[self.first] = self.ends[k]
            self.here[k + 1] = textnp.mix(textnp.pair(before, self.here[1]))
            self.ends[k + 1] = textnp.mix(textnp.pair(np.array([self.ends[k]], U), END))[0]

    def number(self, k: int) -> None:
        """Fill ``keys``, ``gram`` and ``last`` for grams of k words."""
        if k not in self.keys:
            self.keys[k], self.gram[k], order, first = textnp.unique(self.here[k])
            self.last[k] = order[first]

    def histories(self, k: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
        """Sorted fingerprints of the grams of k words and of k ends, each token's history among them, the place of the ends, and whether they are added."""
        self.number(k)
        keys = self.keys[k]
        at = int(np.searchsorted(keys, self.ends[k]))
        added = at == len(keys) or keys[at] != self.ends[k]
        place = np.empty_like(self.gram[k])
        place[1:] = self.gram[k][:-1]
        if added:
            keys = np.insert(keys, at, self.ends[k])
            place += place >= at
        place[self.first] = at
        return keys, place, at, added

    def seen(self, k: int, c: dict[int, np.ndarray]) -> np.ndarray:
        """How often each of ``histories(k)`` stands in training texts, from the counts of this block's grams.

        A history is a gram of its text, but for the ends before its first
        token, which stand there once for each training text.
        """
        _, _, at, added = self.histories(k)
        out = np.insert(c[k], at, 0) if added else c[k].copy()
        out[at] = c[1][np.searchsorted(self.keys[1], END[0])]
        return out

    def add(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=len(self.lengths))


def emit(parts: list[tuple]) -> pa.RecordBatch:
    """A block of texts (words' fingerprints, ids, lengths, whether they train); its bucket is its number of tokens."""
    hashes = np.concatenate([x[0] for x in parts])
    uids, lengths, train = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3))
    vocabulary, tokens, times = np.unique(hashes, return_inverse=True, return_counts=True)
    # numbers in order of frequency take the fewest bytes, and rare words' fingerprints do in their own order
    rare = times < 4
    often = np.concatenate([np.flatnonzero(~rare)[np.argsort(-times[~rare], kind="stable")], np.flatnonzero(rare)])
    rank = np.empty(len(often), np.uint32)
    rank[often] = np.arange(len(often), dtype=np.uint32)
    block = block_id(uids[0], not train[0])
    words = join(pack(vocabulary[often[: np.count_nonzero(~rare)]]), pack_sorted(vocabulary[rare]))
    stream = join(words, pack(uids), pack(lengths.astype(np.int64)), pack(train), pack(rank[tokens]))
    return rows([(block, block, STREAM, len(tokens), stream)])


def _merged_blocks(data: pa.Table) -> pa.Table:
    """Small blocks of one kind as one."""
    parts = []
    for d in data["data"].to_pylist():
        words, *more = split(d)
        frequent, rare = split(words)
        uids, lengths, train, tokens = map(unpack, more)
        parts.append((np.concatenate([unpack(frequent), unpack_sorted(rare)])[tokens], uids, lengths, train))
    return pa.Table.from_batches([emit(parts)])


def _blocks(size: int):
    """Documents to streams of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = ([], []), [0, 0]  # of held-out and of training texts
        for b in batches:
            uid, train = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(b.column(1).to_pylist(), np.uint8)
            for i, j, data, offs in textnp.slices(b.column(2)):
                s, e, counts = textnp.words(data, offs)
                h = np.insert(textnp.word_hashes(data, s, e), np.cumsum(counts), END[0])
                doc = np.repeat(train[i:j], counts + 1)
                for kind in (0, 1):
                    mine = train[i:j] == kind
                    if mine.any():
                        parts[kind].append((h[doc == kind], uid[i:j][mine], counts[mine] + 1, train[i:j][mine]))
                        held[kind] += len(parts[kind][-1][0])
                        if held[kind] >= size:
                            yield emit(parts[kind])
                            parts[kind].clear()
                            held[kind] = 0
        for own in parts:
            if own:
                yield emit(own)

    return run


# --- tables -----------------------------------------------------------------------


def _merged(data: pa.Table) -> tuple[list[int], list[int], np.ndarray, list[list[bytes]]]:
    """A bucket's questions: blocks, sizes, all keys, and what else each row has."""
    got = sorted(zip(data["block"].to_pylist(), data["data"].to_pylist(), strict=True))
    parts = [split(d) for _, d in got]
    keys = [unpack_sorted(p[0]) for p in parts]
    return [b for b, _ in got], [len(k) for k in keys], np.concatenate(keys), [p[1:] for p in parts]


def _count(kind: int):
    """Adds up counts; answers ``2 * total``, plus 1 for one training block that has the key; and counts of counts."""

    def run(data: pa.Table) -> pa.Table:
        bucket = data["bucket"][0].as_py()
        blocks, sizes, keys, more = _merged(data)
        counts = np.concatenate([unpack(m[0]) for m in more])
        _, inverse, order, begins = textnp.unique(keys)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        value = total[inverse] * 2
        if len(keys):
            one = np.maximum.reduceat(np.where(counts[order] > 0, order, -1), begins)
            value[one[one >= 0]] += 1
        cut = np.cumsum([0, *sizes])
        out = [(b, b, kind, bucket, join(pack(value[i:j]))) for b, i, j in zip(blocks, cut[:-1], cut[1:], strict=True)]
        seen = total[total > 0]
        stat = np.array([len(seen), seen.sum(), *(np.count_nonzero(seen == r) for r in range(1, K + 2))], np.int64)
        return table([*out, (-1, -1, STATS, bucket, join(pack(stat)))])

    return run


class Discount:
    """disc(r): the discounted count of r, and what the discounts leave."""

    def __init__(self, stat: np.ndarray):
        self.types, self.tokens = int(stat[0]), int(stat[1])
        n = np.concatenate([[0], stat[2:]]).astype(float)
        self.ratio, self.minus = np.ones(K + 1), None
        self.top = np.iinfo(np.int64).max  # the largest count that is discounted
        for k in range(K, 1, -1):  # K = 1 gives a ratio of 0 always
            if (n[1 : k + 2] > 0).all() and (rest := 1 - (k + 1) * n[k + 1] / n[1]) > 0:
                r = np.arange(1, k + 1)
                d = ((r + 1) * n[r + 1] / (r * n[r]) - (1 - rest)) / rest
                if ((d > 0) & (d < 1)).all():
                    self.ratio[1 : k + 1], self.top = d, k
                    low = float((r * n[r]).sum())
                    self.mass = (self.tokens - low + float((d * r * n[r]).sum())) / self.tokens
                    return
        self.minus = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        self.mass = (self.tokens - self.minus * self.types) / max(1, self.tokens)

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return np.maximum(r - self.minus, 0.0) if self.minus is not None else r * self.ratio[np.where(r <= K, r, 0)]


def unigram(c: np.ndarray, d: Discount) -> np.ndarray:
    """P(w) of counts; 0 counts have the unknown type's share."""
    if not d.tokens:
        return np.ones(len(c))
    return np.where(c > 0, d(c) / d.tokens, 1.0 - d.mass)


def _of_block(data: pa.Table, order: int) -> Block:
    return Block(next(d for k, d in zip(data["kind"].to_pylist(), data["data"].to_pylist(), strict=True) if k == STREAM), order)


def _ask_counts(k: int, buckets: int):
    """Streams to a block's questions for counts of k-grams, with its own counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(4).to_pylist():
                b = Block(data, k)
                b.number(k)
                own = np.zeros(len(b.keys[k]), np.int64) if b.held else np.bincount(b.gram[k], minlength=len(b.keys[k]))
                yield rows(asks(b.block, COUNTS + k, buckets, b.keys[k], own))

    return run


def _probabilities(b: Block, data: pa.Table, order: int, discounts: list[Discount], needed: dict) -> np.ndarray:
    """P(last word | words before) of the block's distinct grams of ``order`` words, from unigrams up."""
    c = {k: answers(data, COUNTS + k)[0] >> 1 for k in range(1, order + 1)}
    p = unigram(c[1], discounts[0])
    for k in range(2, order + 1):
        place = b.histories(k - 1)[1]
        b.number(k)
        h, weight = b.seen(k - 1, c), np.zeros(len(b.histories(k - 1)[0]))
        if (asked := _asked(b, k - 1, h, c[k], discounts[k - 1], needed[k - 1])).any():
            weight[asked] = answers(data, WEIGHTS + k - 1)[0]
        mine = place[b.last[k]]  # each gram's history
        room = np.where(weight[mine] < 0, h[mine] / (h[mine] + 1.0), 1.0)
        own = room * discounts[k - 1](c[k]) / np.maximum(h[mine], 1)
        p = np.where(c[k] > 0, own, np.abs(weight[mine]) * p[b.gram[k - 1][b.last[k]]])
    return p


def _backed_off(b: Block, k: int, c: np.ndarray) -> np.ndarray:
    """Which of ``histories(k)`` some token of the block backs off from; c: counts of the grams behind them."""
    keys, place, *_ = b.histories(k)
    out = np.zeros(len(keys), bool)
    out[place[b.last[k + 1]][c == 0]] = True
    return out


def _asked(b: Block, k: int, h: np.ndarray, c: np.ndarray, d: Discount, needed) -> np.ndarray:
    """Histories whose weight the block asks for, or has to send sums for; h: how often they are seen."""
    if b.held:
        return (h > d.top) | _backed_off(b, k, c)
    return (h > d.top) | needed.value.hit(b.histories(k)[0].view(np.int64))


def _needs(k: int, d: Discount):
    """The bitmap's words and bits of those histories of k words, not asked for in any case, that a held-out block backs off from."""

    def run(data: pa.Table) -> pa.Table:
        b = _of_block(data, k + 1)
        b.number(k + 1)
        c = {j: answers(data, COUNTS + j)[0] >> 1 for j in (1, k, k + 1)}
        at = np.unique(place_of(b.histories(k)[0].view(np.int64)[_backed_off(b, k, c[k + 1]) & (b.seen(k, c) <= d.top)], FILTER_BITS))
        word, first = np.unique(at >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.int64(1) << (at & 63), first) if len(at) else at
        return pa.table({"word": pa.array(word), "bits": pa.array(bits)})

    return run


def _ask_weights(k: int, buckets: int, discounts: list[Discount], needed: dict):
    """For histories of k words that are asked for: their count in the block; how many grams behind them, that are this
    block's to report, have each count up to K, and the sum of larger counts; and the sum of those grams' P(w | h')."""

    def run(data: pa.Table) -> pa.Table:
        b = _of_block(data, k + 1)
        b.number(k + 1)
        keys, place, *_ = b.histories(k)
        r = answers(data, COUNTS + k + 1)[0]
        c = {j: answers(data, COUNTS + j)[0] >> 1 for j in range(1, k + 1)}
        asked = _asked(b, k, b.seen(k, c), r >> 1, discounts[k], needed[k])
        size, mine = len(keys), place[b.last[k + 1]]
        if b.held:
            none = np.zeros(int(asked.sum()), np.int64)
            return table(asks(b.block, WEIGHTS + k, buckets, keys[asked], none, *[none] * (K + 1), none.astype(float)))
        own = ((r & 1) == 1) & (r > 1) & asked[mine]
        lower = _probabilities(b, data, k, discounts, needed)[b.gram[k][b.last[k + 1]]]
        count = np.bincount(place, minlength=size)
        times = [np.bincount(mine[own & (r >> 1 == x)], minlength=size)[asked] for x in range(1, K + 1)]
        more = own & (r >> 1 > K)
        high = np.bincount(mine[more], weights=r[more] >> 1, minlength=size).astype(np.int64)
        low = np.bincount(mine[own], weights=lower[own], minlength=size)
        return table(asks(b.block, WEIGHTS + k, buckets, keys[asked], count[asked], *times, high[asked], low[asked]))

    return run


def _weigh(k: int, d: Discount):
    """Backoff weights, negative where the seen mass has to make room; 1 for an unseen history."""

    def run(data: pa.Table) -> pa.Table:
        bucket = data["bucket"][0].as_py()
        blocks, sizes, keys, more = _merged(data)
        inverse = textnp.unique(keys)[1]
        c, *times, high, low = (np.bincount(inverse, weights=np.concatenate([unpack(m[i]) for m in more])) for i in range(K + 3))
        # discounts of large counts are those of their sum, as there are none, or one for each gram
        mass = sum((t * d(np.array([r]))[0] for r, t in enumerate(times, 1)), high)
        left = np.where(c > 0, 1 - mass / np.maximum(c, 1), 1.0)
        full = left < 1e-12
        left = np.where(full, 1 / (c + 1), left)
        weight = np.where(c > 0, left / np.maximum(1 - low, 1e-300), 1.0)
        value = np.where(full, -weight, weight)[inverse]
        # a block of training texts only has to know where seen mass makes room
        held = np.repeat(np.array(blocks, np.int64) & 1 == 1, sizes)
        value = np.where(held, value, np.sign(value))
        cut = np.cumsum([0, *sizes])
        return table([(b, b, WEIGHTS + k, bucket, join(pack(value[i:j]))) for b, i, j in zip(blocks, cut[:-1], cut[1:], strict=True)])

    return run


def _score(order: int, discounts: list[Discount], needed: dict):
    def run(data: pa.Table) -> pa.Table:
        b = _of_block(data, order)
        c = answers(data, COUNTS + 1)[0] >> 1
        p = _probabilities(b, data, order, discounts, needed)
        one = discounts[0]
        base = np.log10((c + 0.5) / (one.tokens + 0.5 * (one.types + 1)))
        n, word = len(b.uids), b.gram[1]
        return pa.table({"_uid": pa.array(b.uids), "held_out": pa.array(b.train == 0), "n_tokens": pa.array(b.lengths), "n_known": pa.array(b.add((c > 0)[word]).astype(np.int64)), "train_tokens": pa.array(np.full(n, one.tokens)), "base_score": pa.array(b.add(base[word])), "score": pa.array(b.add(np.log10(p)[b.gram[order]]))})

    return run


def score_texts(spark: SparkSession, docs: DataFrame, order: int = ORDER, block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``."""
    ws = Workspace(spark, "katz")
    base = documents_of(ws, docs)
    train = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 1, F.lit(True)).cast("int")
    stream = ws.save(base.select("_uid", train.alias("t"), "_text").mapInArrow(_blocks(block), SCHEMA), "blocks")
    # what each task of reading left over is put together, by kind
    kind, rest = F.pmod("dest", F.lit(2)).alias("held"), F.col("bucket") < block / 2
    size, left = stream.agg(F.sum(F.length("data")), F.sum(F.when(rest, F.col("bucket")))).first()
    group = F.pmod(F.xxhash64("dest"), F.lit(-(-(left or 0) // block) or 1)).alias("group")
    merged = ws.save(stream.where(rest).groupBy(kind, group).applyInArrow(_merged_blocks, SCHEMA), "merged")
    stream = stream.where(~rest).union(merged)
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // bucket_bytes))
    by = lambda df, f: df.groupBy("dest").applyInArrow(f, SCHEMA)

    def stat(df: DataFrame) -> Discount:
        # nine numbers a bucket, of which there is one for BUCKET_BYTES of text
        got = [unpack(split(r["data"])[0]) for r in df.where(F.col("kind") == STATS).select("data").toLocalIterator()]
        return Discount(np.sum(got, axis=0) if got else np.zeros(K + 3, np.int64))

    saved: dict[str, list[DataFrame]] = {}

    def in_parts(df: DataFrame, key: str, f, schema: str, name: str) -> DataFrame:
        """Groups by ``dest``, a share of the blocks or buckets at a time, so that only that share's rows lie shuffled on disk."""
        part = F.pmod(F.shiftright(key, 1), F.lit(PARTS))
        saved[name] = [ws.save(df.where(part == i).groupBy("dest").applyInArrow(f, schema), f"{name}-{i}") for i in range(PARTS)]
        return reduce(DataFrame.union, saved[name])

    known, discounts = stream, []
    for k in range(1, order + 1):
        counts = ws.save(by(stream.mapInArrow(_ask_counts(k, buckets), SCHEMA), _count(COUNTS + k)), f"counts-{k}")
        discounts.append(stat(counts))
        known = known.union(counts.where(F.col("kind") == COUNTS + k))
    needed = {}
    for k in range(1, order):
        # a round needs the counts of up to k + 1 words and the weights before
        here = known.where((F.col("kind") <= COUNTS + k + 1) | (F.col("kind") >= WEIGHTS))
        held = here.where(F.pmod("dest", F.lit(2)) == 1).where(f"kind in ({STREAM}, {COUNTS + 1}, {COUNTS + k}, {COUNTS + k + 1})")
        words = held.groupBy("dest").applyInArrow(_needs(k, discounts[k]), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        needed[k] = spark.sparkContext.broadcast(Bitmap.of(ws.save(words, f"needed-{k}").toArrow(), FILTER_BITS))  # of fixed size
        questions = in_parts(here, "dest", _ask_weights(k, buckets, discounts, needed), SCHEMA, f"questions-{k}")
        known = known.union(in_parts(questions, "bucket", _weigh(k, discounts[k]), SCHEMA, f"weights-{k}"))
        ws.drop(*saved.pop(f"questions-{k}"))
    kinds = "_uid long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = in_parts(known, "dest", _score(order, discounts, needed), kinds, "scores")
    return base.select("_uid", F.col("_id").alias("doc_id")).join(scored, "_uid").drop("_uid")
