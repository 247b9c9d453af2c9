import random

import brute
import pytest

from polescale.llm import suffix

ROWS = "doc_id long, text string"


def run(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return suffix.remove_repeats(spark, df)


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(0, 400))) for _ in range(12)]
    rows = []
    for i in range(40):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randrange(0, 200)
        rows.append((i * 3, a[cut:] + rng.choice(["", "x", "yz"]) + b[: rng.randrange(0, 300)]))
    rows += [(500, None), (501, ""), (502, "a" * 99), (503, "a" * 100), (504, "a" * 350), (505, "ab" * 300), (506, "q" * 20 + "ab" * 70), (507, ("0123456789" * 7)[:69] * 9)]
    want = brute.repeats(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, rows).collect()}
    assert got == want


def test_group_dealt_out(spark, monkeypatch):
    """An anchor of more units than one task takes gives the same result."""
    monkeypatch.setattr(suffix, "GROUP", 1)
    rng = random.Random(5)
    core = "the passage that many documents share, " * 4
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 120))) + core + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 120)))) for i in range(30)]
    want = brute.repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, rows).collect()} == want


def test_odd_rows(spark):
    assert run(spark, []).count() == 0
    text = "".join(chr(97 + i % 23) + str(i) for i in range(80))
    df = spark.createDataFrame([(1, text, "x", 1), (1, text, "y", 2), (None, text, "z", 3), (2, None, "w", 4)], "doc_id long, text string, anchor string, _n int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix.remove_repeats(spark, df).collect())
    n = len(text.encode())
    assert got == [(False, 1, 0), (False, 1, n), (False, 2, 0), (True, 0, n)]


@pytest.mark.parametrize("length", [100, 64])
def test_units_cover_all_windows(length):
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(1000), np.uint8)
    _, _, start, count = suffix.units(data, length)
    assert start[0] == 0 and (np.abs(count)).sum() == len(data) - length + 1
