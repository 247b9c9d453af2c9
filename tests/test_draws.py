"""Bounds of the bootstraps' draws."""

import pytest

from polescale.operators import bootstrap
from polescale.plans import calibrate


def test_many_texts_take_hashed_draws(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bootstrap, "MOST_NUMPY_DOCS", 3)
    docs = spark.createDataFrame([(f"s{i}", "a", f"p{i}") for i in range(4)], "slug string, pole string, path string")
    with pytest.raises(ValueError, match="hashed draws"):
        bootstrap.numpy_document_draws(spark, docs, ("a", "b"), 2)
    assert bootstrap.numpy_document_draws(spark, docs.limit(3), ("a", "b"), 2).count() > 0
    (tmp_path / "corpus").mkdir()
    for i in range(6):
        pole, words = (("terrestre", "haie mare"), ("horssol", "orbite fusée"))[i % 2]
        (tmp_path / "corpus" / f"t{i}.md").write_text(f"---\nattracteur: {pole}\naudit: {{role: SEED, use_for_seeds: true}}\n---\n{words} commun", encoding="utf-8")
    assert calibrate.calibrate(spark, str(tmp_path), "hors-sol-terrestre", bootstrap_n=30) == 0
    got = {r.word: (r.ci_low, r.ci_high) for r in spark.read.parquet(f"{tmp_path}/axes/hors-sol-terrestre/lexicon.parquet").collect()}
    assert got["haie"] == (1, 1) and got["orbite"] == (-1, -1) and got["commun"] == (0, 0)


def test_slots_in_steps(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "STEP", 4)
    for n in (0, 1, 4, 9):
        places = spark.range(n).withColumnRenamed("id", "_i")
        drawn = bootstrap.accuracy_draws(spark, places, 3, 1).collect()
        assert sorted(r.b for r in drawn) == sorted([0, 1, 2] * n) and all(0 <= r._i < n for r in drawn)
