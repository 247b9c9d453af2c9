import math
import random

import brute_katz
import numpy as np
import pytest

from polescale.llm import katz


def check(spark, rows, order=3, **more):
    want = brute_katz.scores(rows, order)
    got = {r.doc_id: r for r in katz.score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), order=order, **more).collect()}
    assert got.keys() == want.keys()
    for d, (held, n, known, train, base, score) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def text(rng, n, alpha=0.7):
    return " ".join("w" + str(int(rng.paretovariate(alpha)) % 400) for _ in range(n))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_dictionaries(spark, order):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randrange(0, 120))) for i in range(150)] + [(900, None), (901, "  "), (902, "Only ONCE only")]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 150, 3)]  # copies: histories whose only word is seen often
    rows += [(2000 + i, "again and again the same line") for i in range(12)]
    check(spark, rows, order, block=50)
    if order == 3:
        check(spark, rows, order, block=50, bucket_bytes=64)
        check(spark, rows, order)


def test_tiny_and_empty(spark):
    check(spark, [(0, "a b a b"), (1, "a b c"), (2, None)])
    check(spark, [(0, "a b"), (5, "")])
    assert katz.score_texts(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = "kind int, dest int, block int, bucket int, data int, _uid string, score string"
    rows = spark.createDataFrame([(1, "a b", *range(7)), (1, "a b", *range(7)), (None, "b", *range(7)), (None, None, *range(7))], f"doc_id long, text string, {names}")
    assert katz.score_texts(spark, rows).count() == 4


def test_very_long_text(spark):
    rows = [(0, "a b c " * 100_000), (2, "a b d"), (5, "x")]
    got = {r.doc_id: r for r in katz.score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), block=1000).collect()}
    want = brute_katz.scores(rows, 3)
    assert all(got[d].n_tokens == w[1] and got[d].score == pytest.approx(w[5], rel=1e-9) for d, w in want.items())


@pytest.mark.parametrize("order", [2, 3])
def test_histories_are_normalised(order):
    rng = random.Random(2)
    _, _, p, one = brute_katz.model([(i, text(rng, 80)) for i in range(60)], order)
    vocabulary = [*one, "never seen"]
    some = list(one)[:12]
    for h in [("never seen",), *((w,) for w in some), *((v, w) for v in some for w in some[:4])]:
        h = ((brute_katz.END,) * 2 + h)[-(order - 1) :]
        assert math.isclose(sum(p(w, h) for w in vocabulary), 1.0, rel_tol=1e-9)


#: types, tokens and n1 to n6 of training texts: unigrams and bigrams of sf0.1, unigrams of check_l
COPIES = [[358256, 3182880, 200420, 57120, 23804, 13644, 12859, 6775], [1834136, 3182880, 1482341, 227973, 46941, 19718, 17404, 6993], [3236403, 108330370, 1762934, 457941, 197987, 119318, 95971, 63993]]


@pytest.mark.parametrize("stat", COPIES)
def test_copies_lower_k_only(stat):
    """One count of counts that copies raise leaves Good-Turing on, for counts up to 3."""
    d, n = katz.Discount(np.array(stat)), [0, *stat[2:]]
    x = 4 * n[4] / n[1]
    want = [((r + 1) * n[r + 1] / (r * n[r]) - x) / (1 - x) for r in (1, 2, 3)]
    assert d.minus is None and d.ratio.tolist() == pytest.approx([1, *want, 1, 1]) and all(0 < w < 1 for w in want)
    assert d(np.array([0, 1, 3, 4, 9])).tolist() == pytest.approx([0, want[0], 3 * want[2], 4, 9])
    # Katz: what the discounts leave is n1, the Good-Turing estimate of the unseen
    assert 1 - d.mass == pytest.approx(n[1] / stat[1])


def test_absolute_only_where_degenerate():
    d = katz.Discount(np.array([3, 9, 0, 1, 1, 1, 0, 0]))
    assert d.minus == 0.5 and katz.Discount(np.array([10, 30, 4, 3, 0, 1, 1, 1])).minus == 0.4
