"""Registered bootstraps against plain loops on small tables: all draws, all texts."""

import random
from collections import Counter
from hashlib import md5

import numpy as np
import pytest

from polescale import queries
from polescale.config import TEXT_CI_DRAWS, WORD_CI_DRAWS
from polescale.operators import bootstrap

WORDS = ["sol", "terre", "marche", "lune", "air", "eau", "bois", "fer"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(3), tmp_path_factory.mktemp("tables")
    docs = [(i, " ".join(rng.choice(WORDS[(i % 2) * 2 :]) for _ in range(rng.randrange(4, 30)))) for i in range(30)] + [(30, "zzz"), (31, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(d, d % 2) for d, _ in docs], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    return str(out), docs


def index(b, slot, seed, n):
    return int(md5(f"{b}-{slot}-{seed}".encode()).hexdigest()[:8], 16) % n


def test_text_ci_of_all_texts(spark, folder):
    d, docs = folder
    lex = {r.word: r.score for r in queries.lbg(spark, d).collect()}
    want = {}
    for k, t in docs:
        if s := [lex[w] for w in (t or "").split() if w in lex]:
            m = [np.mean([s[index(b, i, 42, len(s))] for i in range(len(s))]) for b in range(TEXT_CI_DRAWS)]
            want[k] = tuple(np.percentile(m, [2.5, 97.5]))
    got = {r.slug: (r.ci_low, r.ci_high) for r in queries.text_ci(spark, d).collect()}
    assert got.keys() == want.keys() and {k % 5 for k in got} == set(range(5))
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    assert {r.slug for r in queries.text_ci_numpy(spark, d).collect()} == want.keys()


def test_word_ci_of_all_draws(spark, folder):
    d, docs = folder
    seeds = [(k, k % 2, Counter((t or "").split())) for k, t in docs if k % 5 > 1]
    own = [[c for _, p, c in seeds if p == q] for q in (0, 1)]
    frequent = {w for w in WORDS if sum(w in c for _, _, c in seeds) >= 3}
    names, seen = (queries.MINUS, queries.PLUS), {w: [] for w in frequent}
    for b in range(WORD_CI_DRAWS):
        drawn = [[own[q][index(f"{names[q]}/{b}", i, 12345, len(own[q]))] for i in range(len(own[q]))] for q in (0, 1)]
        total = [sum(sum(c.values()) for c in x) for x in drawn]
        for w in frequent:
            m, p = (sum(c[w] for c in drawn[q]) / total[q] for q in (0, 1))
            if m + p:
                seen[w].append((p - m) / (p + m))
    want = {w: tuple(np.percentile(x, [2.5, 97.5])) for w, x in seen.items()}
    got = {r.word: (r.ci_low, r.ci_high) for r in queries.word_ci(spark, d).collect()}
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w], abs=2e-6) for w in want)


@pytest.mark.parametrize("n", [1, 7, bootstrap.STEP + 3])
def test_hashed_means(n):
    v = np.random.default_rng(n).normal(size=n)
    assert bootstrap.hashed_means(v, 3, 42) == pytest.approx([np.mean([v[index(b, i, 42, n)] for i in range(n)]) for b in range(3)])
