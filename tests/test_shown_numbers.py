"""Numbers of the stored comparison are written as Python and SQL write them."""

import random

from polescale.sources import tables


def test_small_and_negative_zero(spark):
    rng = random.Random(1)
    v = [0.0, -4e-7, 4e-7, 1e-6, -1e-6, 1e-5, 1.2e-5, -9.9e-5, 1e-4, 9.99999e-5, 0.0005, -0.25, 1.0, 12.5, None] + [rng.uniform(-2e-4, 2e-4) for _ in range(200)] + [rng.uniform(-1, 1) for _ in range(50)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(v)), "i int, x double").orderBy("i").select(tables.shown("x")).collect()]
    assert got == [None if x is None else repr(round(x, 6)) for x in v]
