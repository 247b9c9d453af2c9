"""Bootstrap intervals: words (documents resampled within poles), texts (token occurrences), accuracies.

Two kinds of draws: hashed ones, which any SQL engine repeats and which run
wholly as joins and aggregates; and NumPy ones, equal to those of a seeded
``default_rng``, for parity with published intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polescale.config import CI_PERCENTILES, TEXT_CI_DRAWS, TEXT_CI_SEED, WORD_CI_DOCS, WORD_CI_DRAWS, WORD_CI_SEED
from polescale.functions.draws import draw
from polescale.operators.wordscores import KEY
from polescale.sources.files import work_table

LO, HI = (p / 100 for p in CI_PERCENTILES)


def _interval(x: str):
    ends = F.percentile(x, F.array(F.lit(LO), F.lit(HI)))
    return ends[0], ends[1]


# --- accuracies ---------------------------------------------------------------


def accuracy_draws(spark: SparkSession, places: DataFrame, draws: int, seed: int) -> DataFrame:
    """``b, _i``: the places drawn, a row for each slot of a draw; slots come in steps, so no row holds an array as long as the texts."""
    n = places.agg(F.count(F.lit(1)).alias("n"))
    steps = spark.range(draws).withColumnRenamed("id", "b").join(F.broadcast(n)).where("n > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STEP).cast("long"))))
    slots = steps.withColumn("slot", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + (STEP - 1), F.col("n") - 1))))
    return slots.select("b", draw(F.col("b"), F.col("slot"), seed, F.col("n")).alias("_i"))


#: Slots whose draws a worker hashes at once.
SLOTS_AT_ONCE = 1 << 16


def hashed_raw(b: int | str, seed: int, at: int, end: int) -> bytes:
    """Four bytes a slot of draw ``b``, before the modulo."""
    from hashlib import md5

    head, tail = f"{b}-".encode(), f"-{seed}".encode()
    return b"".join([md5(head + b"%d" % i + tail).digest()[:4] for i in range(at, end)])


def hashed_places(b: int | str, seed: int, n: int, at: int, end: int) -> np.ndarray:
    """``functions.draws.draw`` of draw ``b`` for the slots from ``at`` to before ``end``, of ``n`` places."""
    return np.frombuffer(hashed_raw(b, seed, at, end), ">u4").astype(np.int64) % n


def _in_order(rows: DataFrame, order: str, *values: str) -> list[np.ndarray]:
    """The values in order. Graded texts are a benchmark's hold-out, not the corpus: a number for each comes to the driver, once."""
    got = rows.select(F.col(order).alias("_o"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    got = got.repartition(1).sortWithinPartitions("_o").drop("_o").toArrow()  # a sort over ranges would compute the rows twice
    return [got.column(i).to_numpy() for i in range(len(values))]


def drawn_means(spark: SparkSession, values: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Means of the hashed resamples of ``values``, a draw each: a worker holds the values and sums a draw's slots, so no slot is a row."""
    if not len(values):
        return np.zeros(0)
    known, n = ~np.isnan(values), len(values)  # null values don't count
    held = spark.sparkContext.broadcast((np.where(known, values, 0), None if known.all() else known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, counts = held.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                total, k = 0.0, 0
                for at in range(0, n, SLOTS_AT_ONCE):
                    i = hashed_places(b, seed, n, at, min(at + SLOTS_AT_ONCE, n))
                    total, k = total + float(x[i].sum()), k + (len(i) if counts is None else int(counts[i].sum()))
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([total / k], pa.float64())], names=["b", "a"])

    tasks = min(draws, max(8, 4 * spark.sparkContext.defaultParallelism))
    got = spark.range(0, draws, 1, tasks).mapInArrow(run, "b long, a double").toArrow()
    held.unpersist()
    return got["a"].to_numpy()[np.argsort(got["b"].to_numpy())]


def _summary(v: np.ndarray, means: np.ndarray) -> list[float]:
    if not len(means):
        return [0.0] * 4
    return [float(np.nanmean(v)), float(means.mean()), *map(float, np.percentile(means, CI_PERCENTILES))]


def accuracy_ci(spark: SparkSession, rows: DataFrame, order: str = "slug", value: str = "correct", draws: int = TEXT_CI_DRAWS, seed: int = TEXT_CI_SEED) -> DataFrame:
    """One row ``point, mean, ci_lo, ci_hi, n, n_iter, seed``; zeros without rows. The rows are computed once."""
    [v] = _in_order(rows, order, value)
    return spark.createDataFrame([(*_summary(v, drawn_means(spark, v, draws, seed)), len(v), draws, seed)], "point double, mean double, ci_lo double, ci_hi double, n long, n_iter long, seed long")


def paired_diff_ci(spark: SparkSession, rows: DataFrame, a: str, b: str, order: str = "slug", draws: int = TEXT_CI_DRAWS, seed: int = TEXT_CI_SEED) -> DataFrame:
    """One row for the accuracies of a and b on the same texts and their difference a - b; inconclusive if the interval holds 0."""
    x, y = _in_order(rows, order, a, b)
    v = x - y
    means = drawn_means(spark, v, draws, seed)
    point, mean, lo, hi = _summary(v, means)
    own = [float(np.nanmean(u)) if len(means) else 0.0 for u in (x, y)]
    kinds = "point_a double, point_b double, diff double, mean double, ci_lo double, ci_hi double, n long, n_iter long, seed long, inconclusive boolean"
    return spark.createDataFrame([(*own, point, mean, lo, hi, len(v), draws, seed, lo <= 0 <= hi)], kinds)


def numpy_means(values: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Means of resamples by a seeded generator; one call for all draws gives the stream of one call a draw."""
    rng = np.random.default_rng(seed)
    step = max(1, (1 << 22) // max(1, len(values)))
    return np.concatenate([values[rng.integers(0, len(values), (min(step, draws - at), len(values)))].mean(axis=1) for at in range(0, draws, step)])


def accuracy_ci_numpy(values: list, draws: int = TEXT_CI_DRAWS, seed: int = TEXT_CI_SEED) -> dict:
    v = np.asarray([_truth(x) for x in values], float)
    if not len(v):
        return {"point": 0.0, "mean": 0.0, "ci_lo": 0.0, "ci_hi": 0.0, "n": 0, "n_iter": draws, "seed": seed}
    m = numpy_means(v, draws, seed)
    lo, hi = np.percentile(m, CI_PERCENTILES)
    return {"point": float(v.mean()), "mean": float(m.mean()), "ci_lo": float(lo), "ci_hi": float(hi), "n": len(v), "n_iter": draws, "seed": seed}


def paired_diff_ci_numpy(a: list, b: list, draws: int = TEXT_CI_DRAWS, seed: int = TEXT_CI_SEED) -> dict:
    if len(a) != len(b):
        raise ValueError("both methods must be graded on the same texts")
    v = np.asarray([_truth(x) - _truth(y) for x, y in zip(a, b, strict=True)], float)
    if not len(v):
        return {"point_a": 0.0, "point_b": 0.0, "diff": 0.0, "mean": 0.0, "ci_lo": 0.0, "ci_hi": 0.0, "n": 0, "n_iter": draws, "seed": seed, "inconclusive": True}
    m = numpy_means(v, draws, seed)
    lo, hi = np.percentile(m, CI_PERCENTILES)
    own = [float(np.mean([_truth(x) for x in xs])) for xs in (a, b)]
    return {"point_a": own[0], "point_b": own[1], "diff": float(v.mean()), "mean": float(m.mean()), "ci_lo": float(lo), "ci_hi": float(hi), "n": len(v), "n_iter": draws, "seed": seed, "inconclusive": bool(lo <= 0 <= hi)}


def _truth(x) -> float:
    return float(x.strip().lower() == "true") if isinstance(x, str) else float(bool(x))


# --- texts --------------------------------------------------------------------


#: Draws' hashes that a worker keeps: so many columns (slots), over blocks of columns.
SLOTS, STEP = 1 << 14, 1 << 10
_kept: dict[tuple[int, int], list[np.ndarray]] = {}


def _hashes(draws: int, seed: int, at: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """(draws from ``lo`` to ``hi``, STEP) numbers of ``functions.draws.draw`` before the modulo, for slots from ``at``; the same for every text.

    Beyond ``SLOTS`` they are not kept, and only the draws asked for are hashed.
    """
    kept = _kept.setdefault((draws, seed), [])
    k = at // STEP
    if k < len(kept):
        return kept[k][lo:hi]
    keep = k == len(kept) and at < SLOTS
    span = range(draws) if keep else range(draws)[lo:hi]
    raw = b"".join([hashed_raw(b, seed, at, at + STEP) for b in span])
    out = np.frombuffer(raw, ">u4").astype(np.uint32).reshape(len(span), STEP)
    if keep:
        kept.append(out)
        return out[lo:hi]
    return out


def _hashed_draws(n: int, draws: int, seed: int) -> Iterator[np.ndarray]:
    """Rows of ``n`` places, a row for each draw, in blocks of about ``CELLS`` places."""
    step = max(1, CELLS // n)
    for b in range(0, draws, step):
        yield np.concatenate([_hashes(draws, seed, at, b, b + step)[:, : n - at] % np.uint32(n) for at in range(0, n, STEP)], axis=1).astype(np.int64)


def _numpy_draws(n: int, draws: int, seed: int) -> Iterator[np.ndarray]:
    """The same from one seeded stream, as ``numpy_means`` takes them."""
    rng, step = np.random.default_rng(seed), max(1, CELLS // n)
    for b in range(0, draws, step):
        yield rng.integers(0, n, (min(step, draws - b), n))


#: Places that a worker holds at once, and texts from which it counts how often each place is drawn.
CELLS, SHARED = 1 << 20, 3


def shared_means(values: np.ndarray, blocks: Iterator[np.ndarray]) -> np.ndarray:
    """Means of resamples, (texts, draws), of ``values``, (texts, n): a draw's places depend on n alone, so texts of one length share them.

    For several texts a draw's places are counted and the means are one product of matrices.
    """
    texts, n = values.shape
    out = []
    for places in blocks:
        if texts < SHARED:
            out.append(np.stack([v[places].mean(axis=1) for v in values]))
            continue
        k = len(places)
        places += np.arange(0, k * n, n)[:, None]  # own counts for each draw
        out.append(values @ np.bincount(places.ravel(), minlength=k * n).reshape(k, n).T.astype(float) / n)
    return np.concatenate(out, axis=1)


def hashed_means(values: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Means of the hashed resamples of ``values``, a draw each."""
    return shared_means(np.asarray(values, float)[None, :], _hashed_draws(len(values), draws, seed))[0]


def text_ci(spark: SparkSession, hits: DataFrame, draws: int = TEXT_CI_DRAWS, seed: int = TEXT_CI_SEED) -> DataFrame:
    """``slug, ci_low, ci_high`` from ordered in-lexicon scores ``slug, tok_id, score``, with hashed draws."""
    return array_ci(_arrays(hits), draws, seed)


def text_ci_numpy(hits: DataFrame, draws: int = TEXT_CI_DRAWS, seed: int = TEXT_CI_SEED) -> DataFrame:
    """As above with NumPy's draws: every text starts the same seeded stream."""
    return array_ci(_arrays(hits), draws, seed, exact=True)


def _arrays(hits: DataFrame) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("tok_id", "score"))), lambda x: x["score"])
    return hits.groupBy("slug").agg(rows.alias("s"))


#: Texts of one length below which they are dealt over ``PARTS`` tasks, as their draws are cheap to repeat; values that a task multiplies at once.
SHORT, PARTS, VALUES = 256, 8, 1 << 20


def array_ci(texts: DataFrame, draws: int = TEXT_CI_DRAWS, seed: int = TEXT_CI_SEED, exact: bool = False) -> DataFrame:
    """``slug, ci_low, ci_high`` of ``slug, s``: each text's scores in order, one array (bounded by the text). ``exact`` takes NumPy's draws.

    Texts are dealt by their length, so those of one length meet in a task
    that makes their draws once: the draws that are made follow the lengths
    that occur and not the texts.
    """
    take = _numpy_draws if exact else _hashed_draws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            low, high = np.empty(len(length)), np.empty(len(length))
            cuts = np.r_[0, np.flatnonzero(np.diff(length)) + 1, len(length)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                n = int(length[at])
                step = max(1, min(VALUES // n, 4 * VALUES // draws))
                for i in range(at, end, step):
                    j = min(i + step, end)
                    own = b.column(1).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    low[i:j], high[i:j] = np.percentile(shared_means(own, take(n, draws, seed)), CI_PERCENTILES, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low), pa.array(high)], names=["slug", "ci_low", "ci_high"])

    kind = next(f.dataType.simpleString() for f in texts.schema.fields if f.name == "slug")
    part = F.when(F.size("s") < SHORT, F.pmod(F.xxhash64("slug"), F.lit(PARTS))).otherwise(0)
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.where(F.size("s") > 0).select("slug", "s", F.size("s").alias("_n"), part.alias("_part")).repartition(tasks, "_n", "_part").sortWithinPartitions("_n")
    return dealt.select("slug", "s").mapInArrow(run, f"slug {kind}, ci_low double, ci_high double")


# --- words --------------------------------------------------------------------


#: Texts of a calibration corpus whose draws can be NumPy's.
MOST_NUMPY_DOCS = 20_000


def hashed_document_draws(spark: SparkSession, docs: DataFrame, draws: int = WORD_CI_DRAWS, seed: int = WORD_CI_SEED) -> DataFrame:
    """``b, pole, slug, times`` for ``docs`` (slug, pole): documents drawn within poles, numbered by slug."""
    placed = docs.select("slug", "pole").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("pole").orderBy("slug")) - 1)
    sizes = placed.groupBy("pole").agg(F.count(F.lit(1)).alias("_n"))
    slot = placed.join(F.broadcast(sizes), "pole").select("pole", F.col("_i").alias("slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    taken = slot.select("b", "pole", draw(F.concat_ws("/", "pole", F.col("b").cast("string")), F.col("slot"), seed, F.col("_n")).alias("_i"))
    times = taken.groupBy("b", "pole", "_i").agg(F.count(F.lit(1)).alias("times"))
    return times.join(placed, ["pole", "_i"]).select("b", "pole", "slug", "times")


def numpy_document_draws(spark: SparkSession, docs: DataFrame, poles: tuple[str, str], draws: int = WORD_CI_DRAWS, seed: int = WORD_CI_SEED) -> DataFrame:
    """The same from one seeded stream: draw by draw, pole by pole in axis order, over documents in order of ``path``.

    One stream of random numbers has to be drawn in one place; it raises for
    more than ``MOST_NUMPY_DOCS`` texts, which take ``hashed_document_draws``.
    """
    import pandas as pd

    few = docs.select("pole", "path", "slug").limit(MOST_NUMPY_DOCS + 1)
    if few.count() > MOST_NUMPY_DOCS:
        raise ValueError(f"more than {MOST_NUMPY_DOCS} texts: take hashed draws")
    slugs = few.orderBy("path").toPandas()
    own = {p: slugs.loc[slugs["pole"] == p, "slug"].to_numpy() for p in poles}
    rng = np.random.default_rng(seed)
    parts = []
    for b in range(draws):
        for p in poles:
            if n := len(own[p]):
                i, times = np.unique(rng.integers(0, n, size=n), return_counts=True)
                parts.append(pd.DataFrame({"b": b, "pole": p, "slug": own[p][i], "times": times}))
    return spark.createDataFrame(pd.concat(parts) if parts else [], "b long, pole string, slug string, times long")


#: Documents of a block of draws, and groups into which words are dealt.
BLOCK, GROUPS = 4096, 64


@dataclass
class DrawnBlocks:
    """How often each document is drawn: ``placed`` (pole, slug, _i) and ``blocks`` (pole, k, block), documents by draws as bytes."""

    placed: DataFrame
    blocks: DataFrame
    draws: int


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select("slug", "pole").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("pole").orderBy("slug")) - 1)


def _packed(times: np.ndarray) -> bytes:
    """One byte a number if all fit, else four; the first byte says which."""
    wide = bool(times.max(initial=0) > 255)
    return bytes([wide]) + times.astype("<u4" if wide else np.uint8).tobytes()


def _unpacked(raw) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] else np.uint8, offset=1)


def hashed_blocks(spark: SparkSession, docs: DataFrame, draws: int = WORD_CI_DRAWS, seed: int = WORD_CI_SEED) -> DrawnBlocks:
    """The draws of ``hashed_document_draws``: each is made in one place and summed there, so no drawn document is a row."""
    placed = work_table(_placed(docs), "placed")
    sizes = [(r["pole"], r["n"]) for r in placed.groupBy("pole").agg(F.count(F.lit(1)).alias("n")).where("pole is not null").collect()]  # the poles
    width = BLOCK

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                (pole, n), b = sizes[x // draws], x % draws
                times = np.zeros(n, np.int64)
                for at in range(0, n, SLOTS_AT_ONCE):
                    times += np.bincount(hashed_places(f"{pole}/{b}", seed, n, at, min(at + SLOTS_AT_ONCE, n)), minlength=n)
                cuts = range(0, n, width)
                yield pa.RecordBatch.from_arrays([pa.array([pole] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([b] * len(cuts), pa.int32()), pa.array([_packed(times[i : i + width]) for i in cuts], pa.binary())], names=["pole", "k", "b", "times"])

    def turned(table: pa.Table) -> pa.Table:
        docs_of = min(width, dict(sizes)[table["pole"][0].as_py()] - table["k"][0].as_py() * width)
        out = np.zeros((docs_of, draws), np.uint32)
        for b, raw in zip(table["b"].to_pylist(), table["times"].to_pylist(), strict=True):
            out[:, b] = _unpacked(raw)
        return pa.table({"pole": table["pole"][:1], "k": table["k"][:1], "block": pa.array([_packed(out)], pa.binary())})

    units = len(sizes) * draws
    rows = spark.range(0, units, 1, max(1, min(units, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(drawn, "pole string, k int, b int, times binary")
    return DrawnBlocks(placed, work_table(rows.groupBy("pole", "k").applyInArrow(turned, "pole string, k int, block binary"), "draws"), draws)


def row_blocks(rows: DataFrame) -> DrawnBlocks:
    """From rows ``b, pole, slug, times``."""
    rows = rows.select(F.col("b").cast("int").alias("b"), "pole", "slug", F.col("times").cast("long").alias("times"))
    placed = work_table(_placed(rows), "placed")
    draws, width = (rows.agg(F.max("b")).first()[0] or 0) + 1, BLOCK
    sizes = {r["pole"]: r["n"] for r in placed.groupBy("pole").agg(F.count(F.lit(1)).alias("n")).collect()}  # the poles

    def turned(table: pa.Table) -> pa.Table:
        out = np.zeros((min(width, sizes[table["pole"][0].as_py()] - table["k"][0].as_py() * width), draws), np.uint32)
        np.add.at(out, (table["at"].to_numpy(), table["b"].to_numpy()), table["times"].to_numpy().astype(np.uint32))
        return pa.table({"pole": table["pole"][:1], "k": table["k"][:1], "block": pa.array([_packed(out)], pa.binary())})

    own = rows.join(placed, ["pole", "slug"]).select("pole", _block("_i"), _row("_i"), "b", "times")
    return DrawnBlocks(placed, work_table(own.groupBy("pole", "k").applyInArrow(turned, "pole string, k int, block binary"), "draws"), draws)


def _block(i: str):
    return F.floor(F.col(i) / BLOCK).cast("int").alias("k")


def _row(i: str):
    return (F.col(i) % BLOCK).cast("int").alias("at")


def _totals(lengths: DataFrame, drawn: DrawnBlocks, minus: str, plus: str) -> np.ndarray:
    """Words drawn, (2, draws): a row for each block comes to the driver."""
    draws = drawn.draws
    own = lengths.join(drawn.placed, ["slug", "pole"]).select("pole", _block("_i"), _row("_i"), "len")
    own = own.groupBy("pole", "k").agg(F.collect_list(F.struct("at", "len")).alias("own")).join(drawn.blocks, ["pole", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for own, raw in zip(b.column(1), b.column(2), strict=True):
                at, n = own.values.flatten()
                block = _unpacked(raw.as_buffer()).reshape(-1, draws)
                length = np.zeros(len(block), np.int64)
                length[at.to_numpy()] = n.to_numpy()
                sums.append(sum(length[i] @ block[i].astype(np.int64) for i in (slice(j, j + 512) for j in range(0, len(block), 512))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.binary())], names=["side", "sums"])

    out = np.zeros((2, draws), np.int64)
    for r in own.select((F.col("pole") == plus).alias("side"), "own", "block").mapInArrow(run, "side boolean, sums binary").toLocalIterator():
        out[int(r["side"])] += np.frombuffer(r["sums"], np.int64)
    return out


def _ends(score: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    """Percentiles of each row over the seen entries, of which there is one at least; as ``np.nanpercentile``, without a call for each row."""
    x, m = np.sort(np.where(seen, score, np.nan), axis=1), seen.sum(axis=1)
    out = []
    for p in CI_PERCENTILES:
        place = (m - 1) * (p / 100)
        at = np.floor(place).astype(np.int64)
        t, row = place - at, np.arange(len(x))
        a, b = x[row, at], x[row, np.minimum(at + 1, m - 1)]
        out.append(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))
    return out


def word_ci(counts: DataFrame, draws: DataFrame | DrawnBlocks, minus: str, plus: str, min_docs: int = WORD_CI_DOCS) -> DataFrame:
    """``word, pos, ci_low, ci_high`` over the draws in which a word occurs; words of fewer documents have none.

    ``counts`` is read three times. The gate is the whole corpus's document
    frequency and comes first; a draw's totals come from document lengths, as
    they count all words. Words are dealt over groups; a group's task reads its
    (document, word) counts beside the blocks of draws, one block after the
    other, and adds up its words' sums in place. So a pair is one small row,
    sums never leave the task, and the draws are read once by each group.
    """
    counts = counts.where(F.col("pole").isin(minus, plus))
    drawn = draws if isinstance(draws, DrawnBlocks) else row_blocks(draws)
    size = drawn.draws
    totals = _totals(counts.groupBy("slug", "pole").agg(F.sum("n").alias("len")), drawn, minus, plus)
    kind = np.int32 if totals.max(initial=0) < 1 << 31 else np.int64  # no sum passes its draw's total

    frequent = counts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= min_docs).select(*KEY)
    group = F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)).cast("int").alias("g")
    none = lambda t: F.lit(None).cast(t)
    side = (F.col("pole") == plus).alias("side")
    pairs = counts.join(frequent, KEY).join(drawn.placed, ["slug", "pole"]).select(group, side, _block("_i"), _row("_i"), *KEY, F.col("n").cast("long").alias("n"), none("binary").alias("block"))
    blocks = drawn.blocks.where(F.col("pole").isin(minus, plus)).select(F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("g"), side, "k", F.lit(-1).alias("at"), none("string").alias("word"), none("string").alias("pos"), none("long").alias("n"), "block")
    rows = pairs.union(blocks).repartitionById(GROUPS, F.col("g")).sortWithinPartitions("g", "side", "k", "at")  # a block before its pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        sums = np.zeros((2, 256, size), kind)
        block, s = None, 0

        def add(b: pa.RecordBatch) -> None:
            """Of pairs of one block."""
            nonlocal sums
            word, pos = (b.column(c).dictionary_encode() for c in ("word", "pos"))
            kinds = len(pos.dictionary)
            key, w = np.unique(word.indices.to_numpy().astype(np.int64) * kinds + pos.indices.to_numpy(), return_inverse=True)
            names = zip(word.dictionary.take(pa.array(key // kinds)).to_pylist(), pos.dictionary.take(pa.array(key % kinds)).to_pylist(), strict=True)
            w = np.array([place.setdefault(x, len(place)) for x in names])[w]
            if len(place) > sums.shape[1]:
                more = np.zeros((2, max(len(place), sums.shape[1] * 3 // 2), size), kind)
                more[:, : sums.shape[1]] = sums
                sums = more
            order = np.argsort(w, kind="stable")
            w, at, n = w[order], b.column("at").to_numpy()[order], b.column("n").to_numpy()[order].astype(kind)
            for i in range(0, len(w), 2048):
                own = w[i : i + 2048]
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                sums[s, own[start]] += np.add.reduceat(block[at[i : i + 2048]] * n[i : i + 2048, None], start, axis=0, dtype=kind)

        def ended() -> Iterator[pa.RecordBatch]:
            names = list(place)
            for i in range(0, len(names), 1024):
                both = sums[:, i : min(i + 1024, len(names))].astype(float)
                rate = [np.divide(x, t, out=np.zeros(x.shape), where=t > 0) for x, t in zip(both, totals.astype(float), strict=True)]
                seen = rate[0] + rate[1] > 0
                any_ = seen.any(axis=1)
                score = np.divide(rate[1] - rate[0], rate[0] + rate[1], out=np.full(seen.shape, np.nan), where=seen)
                lo, hi = _ends(score[any_], seen[any_])
                kept = [x for x, y in zip(names[i : i + 1024], any_.tolist(), strict=True) if y]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([x for _, x in kept], pa.string()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64())], names=["word", "pos", "ci_low", "ci_high"])

        for b in batches:
            heads = np.flatnonzero(b.column("at").to_numpy() < 0)
            cuts = np.r_[0, heads, b.num_rows]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i in heads:
                    block, s = _unpacked(b.column("block")[i].as_buffer()).reshape(-1, size), int(b.column("side")[i].as_py())
                    i += 1
                if i < j:
                    add(b.slice(i, j - i))
        yield from ended()

    return rows.drop("g", "k").mapInArrow(run, "word string, pos string, ci_low double, ci_high double")
