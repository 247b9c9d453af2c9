"""The pipeline's near-dedup stage against all pairs at similarity 0.8; op3 keeps 0.85."""

import random

import brute
import pytest

from polescale.llm import minhash


def kept(rows, percent):
    """Smallest doc_ids of the components of pairs with that similarity."""
    sets = {d: brute.shingles(t) for d, t in rows}
    low = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((low[a], low[b]))
                low = {d: x if c == y else c for d, c in low.items()}
    return {d for d in sets if low[d] == d}


def rows_at(*shared):
    """Pairs of documents whose first shingles, so many of 200 in all, are common."""
    rng = random.Random(4)
    rows = []
    for k, n in enumerate(shared):
        words = [f"p{k}w{rng.randrange(10**6)}" for _ in range(n + 4)]
        more = [[f"p{k}{side}{i}" for i in range((200 - n) // 2)] for side in "ab"]
        rows += [(2 * k, " ".join(words + more[0])), (2 * k + 1, " ".join(words + more[1]))]
    return rows


def test_stage_takes_four_fifths(spark, tmp_path):
    import corpus_pipeline

    rows = rows_at(190, 172, 168, 164, 160, 158, 140)  # of 200: 0.95, 0.86, 0.84, 0.82, 0.80, 0.79, 0.70
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert got == kept(rows, 80) == set(range(14)) - {1, 3, 5, 7, 9}
    op3 = {r.doc_id for r in minhash.near_duplicates(spark, docs).where("kept").collect()}
    assert op3 == kept(rows, 85) == set(range(14)) - {1, 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_against_all_pairs(spark, tmp_path, seed):
    import corpus_pipeline

    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 40, 300]))] for _ in range(8)]
    rows = [(i, " ".join(f"x{rng.randrange(99)}" if rng.random() < share else w for w in rng.choice(base))) for i, share in enumerate(rng.choice([0, 0.01, 0.02, 0.03]) for _ in range(50))]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == kept(rows, 80)
