"""The pipeline, and each stage, over null and repeated ids, repeated rows, odd texts and clashing column names."""

import random

import brute
import pytest
from test_decontam import plain

#: Further columns; some have names that the code uses itself, one has a backtick and one a dot.
NAMES = ["tag", "copy", "_uid", "_row", "_part", "_at", "_rank", "key", "node", "cid", "n", "odd`name", "dotted.name"]


def documents(rng):
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 120))) for _ in range(24)]
    item = " ".join(f"q{i}" for i in range(30))
    shared = " ".join(f"s{i}" for i in range(60))
    w = base[6].split()
    near = " ".join([*w[: len(w) - 4], "x1", "x2", "x3", "x4"])
    texts = [*base, base[0], base[0], base[1] + " end", near, "short", None, None, "", " \n\t", "a b c d e f g h " * 8, " ".join(f"u{i}" for i in range(80)) + "\n" + item, base[4] + "\n" + shared, base[5] + "\n" + shared, " ".join(f"v{i}" for i in range(30_000))]
    ids = [None if k % 7 == 3 else k // 2 for k in range(len(texts))]
    rows = [(i, t, "en", None if k % 5 == 4 else f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[0], rows[0], rows[2], rows[3]]  # repeated rows
    return [(*r, k, *[f"x{k}"] * (len(NAMES) - 1)) for k, r in enumerate(rows)], item


def frame(spark, rows):
    from pyspark.sql import types as T

    kinds = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("tag", T.LongType()), *((n, T.StringType()) for n in NAMES[1:])]
    return spark.createDataFrame(rows, T.StructType([T.StructField(*k) for k in kinds]))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows, item = documents(random.Random(11))
    spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows, item


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def first_of_groups(rows, percent):
    """Rows that stay, as (id, text) in order: which of several equal rows stays is open."""
    ordered = in_order(rows)
    near = brute.near([(k, r[1]) for k, r in enumerate(ordered)], percent)
    return [r[:2] for k, r in enumerate(ordered) if near[k][2]]


def test_stages(spark, tables):
    import corpus_pipeline as p

    folder, rows, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_tag = {r[5]: r for r in rows}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")

    got = p.quality_rules(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted(r.tag for r in got.collect()) == [k for k, r in by_tag.items() if not brute.quality(r[1])[-1]]

    got = p.near_dedup(spark, docs, folder).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(first_of_groups(rows, 80), key=key)
    assert all(tuple(r) == by_tag[r.tag] for r in got), "columns pass through"

    got = p.suffix_dedup(spark, docs, folder).collect()
    assert {r.tag for r in got} == set(by_tag) and all(tuple(r)[5:] == by_tag[r.tag][5:] for r in got)
    want = brute.repeats([(k, r[1]) for k, r in enumerate(in_order(rows))])
    import hashlib

    # equal rows may stand in either order
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in got) == sorted(x[3] for x in want.values())
    assert all((r.text is None) == (by_tag[r.tag][1] is None) and r.n_chars == (None if r.text is None else len(r.text)) for r in got)

    got = p.decontaminate(spark, docs, folder).collect()
    leaking = {d for d, *_ in plain([(k, r[1]) for k, r in by_tag.items() if len(r[1] or "") < 5000], [(1, item)])}
    assert leaking and {r.tag for r in got} == set(by_tag) - leaking

    got = p.mix_sources(spark, docs, folder)
    assert got.columns == [*docs.columns, "copy_"]
    n = {}
    for r in got.collect():
        n.setdefault(r.tag, []).append(r.copy_)
    assert all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 3 for x in n.values())


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, tables, k):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("false")
    assert p.STAGES[k][1](spark, docs, tables[0]).count() == 0


def test_whole(spark, tables):
    """Against plain versions in turn; the mix against its own operator on what is left."""
    import corpus_pipeline as p

    folder, rows, item = tables
    left = [r for r in rows if not brute.quality(r[1])[-1]]
    left = first_of_groups(left, 80)
    sha = {k: v for k, v in brute.repeats([(k, r[1]) for k, r in enumerate(left)]).items()}
    texts = [t for (_, t), v in zip(left, sha.values(), strict=True) if not v[1]]
    out = p.run(spark, folder)
    got = out.collect()
    clean = [t for t in texts if len(t) > 5000 or not plain([(1, t)], [(1, item)])]
    kept = {r.text for r in got}
    assert kept and {t for t in kept if t in texts} <= set(clean)
    from pyspark.sql import functions as F

    from polescale.llm import mixing

    # each copy is numbered from 1, and sizes taken are those of the mix
    uncut = out.where("copy_ = 1").drop("copy_")
    assert uncut.count() == len({r.tag for r in got})
    taken = sum(len(brute.words(r.text)) for r in got)
    total = mixing.n_words(F.col("text"))
    assert taken == out.select(F.sum(total)).first()[0]
