import random

import brute
import numpy as np
import pytest

from polescale.llm import minhash


def vary(rng, words, share):
    return " ".join(rng.choice(["new", "other", "x" + str(rng.randrange(99))]) if rng.random() < share else w for w in words)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 40, 300]))] for _ in range(12)]
    rows = [(i, vary(rng, rng.choice(base), rng.choice([0, 0.005, 0.01, 0.03]))) for i in range(n)]
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "A b C d E f"), (904, "a B c D e F"), (905, "one two"), (906, "ONE two")]


def check(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_against_all_pairs(spark):
    check(spark, rows_of(1))


def test_hub_and_blocks(spark, monkeypatch):
    """Copies of one text that are alike only through it, in buckets larger than a block."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(7)
    hub = [f"h{i}" for i in range(250)]
    rows = [(i + 1, vary(rng, hub, 0.012)) for i in range(30)] + [(500, " ".join(hub))]
    check(spark, rows)


def test_odd_rows(spark):
    assert minhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f", "n1", "k"), (1, "a b c d e f", "n2", "k"), (None, "a b c d e f", "n3", "k"), (2, "p q r s t u", "n4", "k"), (1, "v w x y z q", "n5", "k"), (None, None, "n6", "k")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, node string, keys string")).collect())
    assert got == sorted([("1", 2, "1", True), ("1", 2, "1", True), ("None", 2, "1", False), ("2", 2, "2", True), ("1", 2, "1", True), ("None", 0, "None", True)])


@pytest.mark.parametrize("similarity", [0.95, 0.85])
def test_sketch_estimates(spark, similarity):
    rng = np.random.default_rng(3)
    n = 2000
    shared = int(2 * n * similarity / (1 + similarity))
    x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
    a, b = x[:n], x[n - shared :]
    keys, marks = minhash.bands_and_sketches(np.stack([minhash.minhashes(a), minhash.minhashes(b)]))
    assert (keys[0] == keys[1]).any()
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(marks[0].tolist(), marks[1].tolist())], "x array<long>, y array<long>").select(minhash.similarity(F.col("x"), F.col("y"))).first()[0]
    assert abs(got - similarity) < 0.1
