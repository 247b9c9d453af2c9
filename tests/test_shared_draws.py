"""Texts of one length share their draws; words' sums stay in the task of their group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polescale.operators import bootstrap


@pytest.mark.parametrize("exact", [False, True])
def test_draws_are_made_once_for_a_length(spark, monkeypatch, exact):
    made = spark.sparkContext.accumulator(0)
    name = "_numpy_draws" if exact else "_hashed_draws"
    take = getattr(bootstrap, name)

    def counted(n, draws, seed):
        for x in take(n, draws, seed):
            made.add(x.size)
            yield x

    monkeypatch.setattr(bootstrap, name, counted)
    rng = random.Random(2)
    own = {f"t{i}": [rng.uniform(-1, 1) for _ in range(300 + i % 2)] for i in range(12)} | {"short": [0.5], "few": [1.0, -1.0]}
    got = {r.slug: (r.ci_low, r.ci_high) for r in bootstrap.array_ci(spark.createDataFrame([*own.items(), ("none", [])], "slug string, s array<double>"), 50, 42, exact).collect()}
    assert got.keys() == own.keys()
    for k, v in own.items():
        places = np.concatenate(list(take(len(v), 50, 42)))
        assert got[k] == pytest.approx(tuple(np.percentile(np.array(v)[places].mean(axis=1), [2.5, 97.5])))
    assert made.value == 50 * (300 + 301 + 1 + 2)


def test_word_intervals_over_blocks_and_groups(spark, monkeypatch):
    """Against row draws by hand, with small blocks, and with as many words as make a group's table grow."""
    monkeypatch.setattr(bootstrap, "BLOCK", 4)
    monkeypatch.setattr(bootstrap, "GROUPS", 2)
    rng = random.Random(4)
    rows = [(i, "mp"[i % 2], f"w{w}", "X", rng.randrange(1, 5)) for i in range(22) for w in rng.sample(range(700), 400)]
    counts = spark.createDataFrame(rows, "slug long, pole string, word string, pos string, n long")
    docs = counts.select("slug", "pole").distinct()
    draws = bootstrap.hashed_document_draws(spark, docs, 30, 7)
    drawn = {(r.b, r.pole, r.slug): r.times for r in draws.collect()}
    total, sums, df = {}, {}, {}
    for slug, pole, word, _, n in rows:
        df[word] = df.get(word, 0) + 1
        for b in range(30):
            k = drawn.get((b, pole, slug), 0) * n
            total[b, pole] = total.get((b, pole), 0) + k
            sums[word, b, pole] = sums.get((word, b, pole), 0) + k
    want = {}
    for w in (w for w, k in df.items() if k >= 3):
        rates = [[sums.get((w, b, p), 0) / total[b, p] for p in "mp"] for b in range(30)]
        if seen := [(p - m) / (p + m) for m, p in rates if m + p]:
            want[w] = tuple(np.percentile(seen, [2.5, 97.5]))
    for d in (draws, bootstrap.hashed_blocks(spark, docs, 30, 7)):
        got = {r.word: (r.ci_low, r.ci_high) for r in bootstrap.word_ci(counts, d, "m", "p").collect()}
        assert got.keys() == want.keys() and len(got) > 600 and all(got[w] == pytest.approx(want[w]) for w in want)
    assert bootstrap.hashed_blocks(spark, docs, 30, 7).blocks.agg(F.count("k")).first()[0] == 6


def test_times_beyond_a_byte():
    for x in (np.array([0, 255]), np.array([0, 256, 70000]), np.zeros(0, np.int64)):
        assert bootstrap._unpacked(bootstrap._packed(x)).tolist() == x.tolist()


def test_hashes_beyond_those_kept_are_made_once(monkeypatch):
    """A long text takes its draws in parts, and each part hashes its own draws only."""
    made = []
    raw = bootstrap.hashed_raw
    monkeypatch.setattr(bootstrap, "hashed_raw", lambda b, seed, at, end: made.append((b, at)) or raw(b, seed, at, end))
    monkeypatch.setattr(bootstrap, "_kept", {})
    for name, x in (("STEP", 8), ("SLOTS", 16), ("CELLS", 60)):
        monkeypatch.setattr(bootstrap, name, x)
    got = np.concatenate(list(bootstrap._hashed_draws(30, 5, 42)))
    assert got.tolist() == [bootstrap.hashed_places(b, 42, 30, 0, 30).tolist() for b in range(5)]
    assert len(made[:20]) == len(set(made[:20])) == 20  # 5 draws of 4 blocks
