"""The registered comparison table has intervals and sign robustness of every scored text."""

import random

import numpy as np
import pytest

from polescale import queries
from polescale.config import TEXT_CI_DRAWS


def test_intervals_and_robustness(spark, tmp_path):
    rng = random.Random(5)
    words = ["sol", "terre", "marche", "lune", "air", "eau"]
    docs = [(i, " ".join(rng.choice(words[(i % 2) * 2 : (i % 2) * 2 + 4]) for _ in range(25))) for i in range(20)] + [(20, "zzz"), (21, "sol sol sol air air air marche lune")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2) for d, _ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    lex = {r.word: r.score for r in queries.lbg(spark, str(tmp_path)).collect()}
    got = {r.slug: r for r in queries.comparison_table(spark, str(tmp_path)).collect()}
    assert got.keys() == {d for d, _ in docs}
    robust = set()
    for d, t in docs:
        v, r = np.array([lex[w] for w in t.split() if w in lex]), got[d]
        if not len(v):
            assert (r.axis_score_ci_low, r.axis_score_ci_high, r.sign_robust) == ("", "", "False")
            continue
        lo, hi = np.percentile(v[np.random.default_rng(42).integers(0, len(v), (TEXT_CI_DRAWS, len(v)))].mean(axis=1), [2.5, 97.5])
        assert (float(r.axis_score_ci_low), float(r.axis_score_ci_high)) == pytest.approx((lo, hi), abs=2e-6)
        assert r.sign_robust == str(bool(lo > 0 or hi < 0))
        robust.add(r.sign_robust)
    assert robust == {"True", "False"}
