"""Words counted in their rows: the same numbers, and no token row in a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polescale import queries
from polescale.operators import axis, counting
from polescale.operators import wordscores as ws

TEXTS = [("a", "m", "sol sol terre Sol"), ("b", "m", None), ("b", "p", "terre eau"), ("c", "p", ""), ("d", "p", "eau air eau x air eau")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "slug string, pole string, body string")


def key(df):
    return sorted(map(tuple, df.select("slug", "pole", "word", "pos", "n").collect()))


@pytest.mark.parametrize("most", [1, 3, 1 << 20])
def test_counts_of_rows_are_counts_of_documents(spark, texts, monkeypatch, most):
    monkeypatch.setattr(counting, "TOKENS", most)
    monkeypatch.setattr(counting, "ROWS", 2)
    assert ws.single_documents(texts)
    assert key(ws.row_counts(texts)) == key(ws.document_counts(texts)) != []
    twice = texts.union(texts)
    assert not ws.single_documents(twice) and key(ws.row_counts(twice)) == key(ws.document_counts(twice))


def test_places_and_tags(spark):
    tagged = lambda c: F.transform(F.split(c, " "), lambda w: F.struct(F.substring(w, 1, 1).alias("pos"), F.substring(w, 2, 9).alias("word")))
    rows = spark.createDataFrame([(7, "Nsol Vsol Nsol Neau")], "slug long, body string")
    got = counting.row_words(rows, "slug", tokenize=tagged, places=True).collect()
    assert sorted((r.slug, r.word, r.pos, r.n, r["at"]) for r in got) == [(7, "eau", "N", 1, [3]), (7, "sol", "N", 2, [0, 2]), (7, "sol", "V", 1, [1])]


def test_scores_of_repeated_texts_and_text_order(spark, texts):
    lex = spark.createDataFrame([("sol", "X", 0.5), ("terre", "X", -0.25), ("eau", "X", 1.0)], "word string, pos string, score double")
    want = {}
    for s, _, t in TEXTS:
        want.setdefault(s, []).extend((i, {"sol": 0.5, "terre": -0.25, "eau": 1.0}[w]) for i, w in enumerate((t or "").lower().replace(" x", "").split()) if w != "air")
    got = {r.slug: (r.axis_score, r.n_hits) for r in axis.axis_scores(texts, lex).collect()}
    assert got == {s: (pytest.approx(np.mean([x for _, x in v]) if v else 0), len(v)) for s, v in want.items()}
    hits = axis.text_hits(texts, lex)
    assert {r.slug: r.s for r in hits.collect()} == {s: [x for _, x in sorted(v)] for s, v in want.items() if v}
    assert sorted(map(tuple, axis.hit_scores(texts, hits).collect())) == sorted(map(tuple, axis.axis_scores(texts, lex).collect()))


def test_no_shuffle_of_tokens(spark, texts, tmp_path):
    """Before, each (text, word) was a shuffled row of a text's counts, then of the join, in lexicon and in scores."""
    lex = spark.createDataFrame([("sol", "X", 0.5)], "word string, pos string, score double")
    plan = axis.axis_scores(texts, lex)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate [slug") == 1
    spark.createDataFrame([(i, "sol terre eau") for i in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for q in (queries.axis_score_lbg, queries.axis_score_lowe, queries.graded_texts, queries.accuracy_by_category, queries.head_to_head, queries.divergences, queries.inversion_outcomes, queries.inversion_counts, queries.pole_confusion):
        assert "Generate" not in q(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString(), q.__name__
