"""Accuracy intervals compute their rows once and make no row of a slot."""

from hashlib import md5

import numpy as np
import pytest

from polescale.operators import bootstrap

N, DRAWS = 37, 50


@pytest.fixture
def graded(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(f"t{i:02}", i % 3 > 0, i % 4 > 0) for i in range(N)], "slug string, correct boolean, other boolean")
    return df.mapInArrow(run, df.schema), seen


def means(v):
    return [np.mean([v[int(md5(f"{b}-{i}-42".encode()).hexdigest()[:8], 16) % len(v)] for i in range(len(v))]) for b in range(DRAWS)]


def test_accuracy(spark, graded, monkeypatch):
    monkeypatch.setattr(bootstrap, "SLOTS_AT_ONCE", 8)
    r = bootstrap.accuracy_ci(spark, graded[0], draws=DRAWS).first()
    v = np.array([float(i % 3 > 0) for i in range(N)])
    assert (r.point, r.mean, r.ci_lo, r.ci_hi) == pytest.approx((v.mean(), np.mean(means(v)), *np.percentile(means(v), [2.5, 97.5]))) and (r.n, r.n_iter, r.seed) == (N, DRAWS, 42)
    assert graded[1].value == N


def test_paired_difference(spark, graded):
    r = bootstrap.paired_diff_ci(spark, graded[0], "correct", "other", draws=DRAWS).first()
    a, b = (np.array([float(i % k > 0) for i in range(N)]) for k in (3, 4))
    assert (r.point_a, r.point_b, r.diff, r.ci_lo, r.ci_hi) == pytest.approx((a.mean(), b.mean(), (a - b).mean(), *np.percentile(means(a - b), [2.5, 97.5])))
    assert graded[1].value == N


def test_null_values_do_not_count(spark):
    v = [1.0, None, 0.0, 1.0]
    r = bootstrap.accuracy_ci(spark, spark.createDataFrame(list(enumerate(v)), "slug int, correct double"), draws=DRAWS).first()
    drawn = [[v[int(md5(f"{b}-{i}-42".encode()).hexdigest()[:8], 16) % 4] for i in range(4)] for b in range(DRAWS)]
    want = [np.mean([x for x in d if x is not None]) for d in drawn if any(x is not None for x in d)]
    assert r.n == 4 and (r.point, r.mean) == pytest.approx((2 / 3, np.mean(want)))
