"""A comparison reads and parses each file once, for scores, intervals, report and table."""

from polescale.plans import calibrate, compare
from polescale.sources import corpus


def test_files_are_parsed_once(spark, tmp_path, monkeypatch):
    (tmp_path / "corpus").mkdir()
    for i in range(6):
        pole, words = (("terrestre", "haie mare"), ("horssol", "orbite fusée"))[i % 2]
        (tmp_path / "corpus" / f"t{i}.md").write_text(f"---\nattracteur: {pole}\naudit: {{role: SEED, use_for_seeds: true}}\n---\n{words} commun", encoding="utf-8")
    parsed, parse = spark.sparkContext.accumulator(0), corpus._parse

    def counted(batches):
        for b in parse(batches):
            parsed.add(b.num_rows)
            yield b

    monkeypatch.setattr(corpus, "_parse", counted)
    assert calibrate.calibrate(spark, str(tmp_path), "hors-sol-terrestre") == 0
    before = parsed.value
    assert compare.compare(spark, str(tmp_path), "hors-sol-terrestre") == 0
    assert parsed.value - before == 6
