import random

import brute

from polescale.llm import decontam


def documents(rng):
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))) for _ in range(40)]
    item = " ".join(f"q{i}" for i in range(30))
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [*base, base[0], base[1] + " end", base[2].replace("w1", "w1x", 1), "short", None, "", "a b c d e f g h " * 8, " ".join(f"u{i}" for i in range(80)) + "\n" + item, base[4] + "\n" + shared, base[5] + "\n" + shared]
    return [(i, t, "en", f"src{i % 4}", len(t or ""), i % 5) for i, t in enumerate(texts)], item


def test_against_plain_version(spark, tmp_path):
    import corpus_pipeline

    rows, item = documents(random.Random(11))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _uid int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [r for r in rows if not brute.quality(r[1])[-1]]
    near = brute.near([(r[0], r[1]) for r in docs])
    docs = [r for r in docs if near[r[0]][2]]
    cut = brute.repeats([(r[0], r[1]) for r in docs])
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        left = stage(spark, left, str(tmp_path))
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "_uid"]
        left.write.parquet(f"{tmp_path}/stage{k}")
        left = spark.read.parquet(f"{tmp_path}/stage{k}")
    got = {r.doc_id: r for r in left.collect()}
    assert got.keys() == {r[0] for r in docs}
    import hashlib

    for d, (_, _, _, sha) in cut.items():
        assert hashlib.sha256(got[d].text.encode()).hexdigest() == sha and got[d].n_chars == len(got[d].text)
    clean = corpus_pipeline.decontaminate(spark, left, str(tmp_path))
    leaking = {d for d, r in got.items() if item in r.text}
    assert leaking and {r.doc_id for r in clean.collect()} == got.keys() - leaking
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*left.columns, "copy"]
    n = {d: 0 for d in got}
    for r in out.collect():
        n[r.doc_id] += 1
    assert set(n) == set(got) and max(n.values()) <= 3
    assert decontam.THRESHOLD == 0.5
