"""Hand-computed cases of the text-scaling operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polescale.config import AXES, DEFAULT_POLES, Pole, axis_poles
from polescale.functions import labels, text, vector
from polescale.operators import axis, blend, bootstrap, geometry, stance
from polescale.operators import wordscores as ws

M, P = "hors_sol", "terrestre"


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def counts(spark, *docs):
    rows = [(f"{pole}{i}", pole, w, "NOUN", n) for i, (pole, words) in enumerate(docs) for w, n in words.items()]
    return spark.createDataFrame(rows, "slug string, pole string, word string, pos string, n long")


def lexicon(spark, *docs):
    return {r.word: r for r in ws.wordscores(ws.frequencies(counts(spark, *docs), M, P)).collect()}


# --- text ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "strategy", "n"),
    [
        ("un\n\ndeux\n \t\ntrois", "paragraphs", 3),
        ("un\n\ndeux", "short", 1),
        ("mot " * 500 + "\nb\nc", "single_newline", 3),
        ("mot " * 500 + "\nb", "short", 1),
        ("A. B. C. D. E.", "sentence_window", 3),
        ("A. B. C.", "short", 1),
        ("", "short", 1),
        (None, "short", 1),
    ],
)
def test_segments(spark, raw, strategy, n):
    g = column(spark, raw, text.segment)
    assert (g.strategy, len(g.segments)) == (strategy, n)


def test_windows_share_sentences(spark):
    g = column(spark, "A. B. C. D. E.", text.segment)
    assert g.segments == [["A.", "B.", "C."], ["B.", "C.", "D."], ["C.", "D.", "E."]]


@pytest.mark.parametrize(("sizes", "want"), [([200, 100, 300, 10], [200, 100, 300, 10]), ([100, 100, 56, 1, 400], [256, 1, 400]), ([], []), ([256], [256]), ([1, 1], [2])])
def test_packing(spark, sizes, want):
    parts = [" ".join(["w"] * n) for n in sizes]
    got = column(spark, [*parts, " "], text.pack, "array<string>")
    assert [len(c.split()) for c in got] == want


def test_word_slices(spark):
    assert [len(c.split()) for c in column(spark, "w " * 600, text.word_slices)] == [256, 256, 88]
    assert column(spark, " ", text.word_slices) == []


def test_strip_as_python(spark):
    raw = "   a \x1c b 　\n"
    assert column(spark, raw, text.strip) == raw.strip()
    assert column(spark, raw, text.n_words, "string") == 2


def test_tokens_and_lemmas(spark):
    assert [t.word for t in column(spark, "L'Été, à 3 km du SOL", text.tokens)] == ["été", "km", "du", "sol"]
    tagged = [("Sols", "NOUN", False, False, False), ("le", "DET", True, False, False), ("x", "NOUN", False, False, False), ("aller", "VERB", False, False, False), ("aller", "VERB", False, False, False)]
    kind = "array<struct<lemma:string,pos:string,is_stop:boolean,is_punct:boolean,is_space:boolean>>"
    got = column(spark, tagged, lambda c: text.keep_lemmas(c, ("NOUN", "VERB", "ADJ", "PROPN")), kind)
    assert [(t.word, t.pos) for t in got] == [("sols", "NOUN"), ("aller", "VERB"), ("aller", "VERB")]


def test_format_ci(spark):
    r = spark.range(1).select(text.format_ci(F.lit(0.4375), F.lit(-0.25), F.lit(2.0)).alias("a")).first()
    assert r.a == "0.438 [-0.250, 2.000]"


# --- labels -------------------------------------------------------------------


@pytest.mark.parametrize(("raw", "pole"), [(" Local+ ", "local"), ("HORS-SOL", "hors_sol"), ("horssol", "hors_sol"), ("terrestre", "terrestre"), ("cross:a/b", None), (None, None)])
def test_fold(spark, raw, pole):
    assert column(spark, raw, labels.fold_pole_or_none) == pole
    if pole:
        assert column(spark, raw, labels.fold_pole) == pole
    else:
        with pytest.raises(Exception, match="no pole is named"):
            column(spark, raw, labels.fold_pole)


def test_truth(spark):
    assert [column(spark, x, lambda c: labels.as_correct(c, "string")) for x in ("True", " true ", "1", "False", None)] == [1, 1, 0, 0, 0]
    assert [column(spark, x, lambda c: labels.as_correct(c, "int"), "int") for x in (2, 0, None)] == [1, 0, 0]


# --- lexicons -----------------------------------------------------------------


def test_word_scores_by_formula(spark):
    """Words of one pole, of both in unequal texts, and of both alike, against the formula."""
    docs = [(M, {"orbite": 7, "fusée": 2, "route": 9}), (M, {"orbite": 1, "prix": 4}), (P, {"haie": 6, "route": 3, "prix": 2}), (P, {"haie": 1, "mare": 5})]
    got = lexicon(spark, *docs)
    total = {p: sum(n for q, d in docs if q == p for n in d.values()) for p in (M, P)}
    of = {w: {p: sum(d.get(w, 0) for q, d in docs if q == p) for p in (M, P)} for w in got}
    for w, r in got.items():
        a, b = (of[w][p] / total[p] for p in (M, P))
        assert r.score == pytest.approx((b - a) / (a + b)) and (r.freq_minus, r.freq_plus) == (of[w][M], of[w][P])
        assert r.n_docs == sum(w in d for _, d in docs)
    assert {w for w, r in got.items() if r.score == -1} == {"orbite", "fusée"} and {w for w, r in got.items() if r.score == 1} == {"haie", "mare"}


@pytest.mark.parametrize("factor", [1, 3, 40])
def test_length_of_a_pole_does_not_count(spark, factor):
    """A word that both poles use for the same share of their words scores 0, however long their texts are."""
    got = lexicon(spark, (M, {"chemin": 6 * factor, "autre": 18 * factor}), (P, {"chemin": 2, "reste": 6}))
    assert got["chemin"].score == pytest.approx(0)


def test_lowe_by_formula(spark):
    freqs = {"orbite": (9, 0), "prix": (5, 2), "haie": (0, 7), "mare": (1, 3)}
    df = spark.createDataFrame([(w, *n) for w, n in freqs.items()], "word string, freq_minus long, freq_plus long").withColumn("pos", F.lit("NOUN"))
    got = {r.word: r.score for r in ws.lowe(df).collect()}
    total = [sum(n[i] for n in freqs.values()) + 0.5 * len(freqs) for i in (0, 1)]
    assert got == pytest.approx({w: np.log((p + 0.5) / total[1]) - np.log((m + 0.5) / total[0]) for w, (m, p) in freqs.items()})


# --- scores and grades --------------------------------------------------------


def scored(spark, bodies, lex):
    texts = spark.createDataFrame(bodies, "slug string, body string")
    return {r.slug: r for r in axis.axis_scores(texts, spark.createDataFrame([(w, "X", s) for w, s in lex.items()], "word string, pos string, score double")).collect()}


def test_axis_scores(spark):
    lex = {"orbite": -0.7, "haie": 0.4, "mare": 1.0}
    bodies = {"both": "Orbite, haie; Zut", "out": "zut zut alors", "none": None, "twice": "mare orbite mare haie mare", "case": "HAIE"}
    got = scored(spark, list(bodies.items()), lex)
    for slug, body in bodies.items():
        words = [w.strip(",;").lower() for w in (body or "").split()]
        found = [lex[w] for w in words if w in lex]
        assert (got[slug].n_hits, got[slug].n_tokens) == (len(found), len(words))
        assert got[slug].axis_score == pytest.approx(sum(found) / len(found) if found else 0.0)


def rows(spark, *r):
    return spark.createDataFrame(r, "slug string, category string, gold_pole string, axis_score double, n_hits long")


def test_grading(spark):
    df = axis.graded(rows(spark, ("a", "seed", P, 0.4, 5), ("b", "seed", P, -0.4, 5), ("c", "seed", M, 0.0, 5), ("d", "seed", "local", 0.4, 5), ("e", "seed", None, 0.4, 0), ("f", "holdout", M, -0.1, 1)), M, P)
    got = {r.slug: (r.predicted_pole, r.correct, r.on_axis) for r in df.collect()}
    assert got == {"a": (P, True, True), "b": (M, False, True), "c": (None, False, True), "d": (P, None, False), "e": (None, None, False), "f": (M, True, True)}
    assert {r.category: (r.n_correct, r.n_graded) for r in axis.accuracy_by_category(df).collect()} == {"seed": (1, 3), "holdout": (1, 1)}
    assert {r.gold_pole: (r.n, r.n_correct, r.n_undecided) for r in axis.confusion(df).collect()} == {P: (2, 1, 0), M: (1, 0, 1)}


def test_inversions(spark):
    df = axis.graded(rows(spark, ("a", "inversion", P, -0.4, 5), ("b", "inversion", M, 0.4, 5), ("c", "inversion", "local", 0.4, 5)), M, P)
    r = axis.inversion_counts(df).first()
    assert (r.n_misclassified, r.n_gradable) == (2, 2)
    assert {x.slug: x.outcome for x in axis.inversion_outcomes(df).collect()} == {"a": "misclassified", "b": "misclassified", "c": "off_axis"}


def test_head_to_head(spark):
    df = axis.graded(rows(spark, ("a", "holdout", P, 0.4, 5), ("b", "holdout", M, -0.4, 5), ("c", "holdout", "local", 0.1, 2)), M, P)
    pred = spark.createDataFrame([("a", M), ("b", M), ("c", "local")], "slug string, predicted_pole string")
    r = axis.head_to_head(df, pred, M, P).first()
    assert (r.ws_ok, r.ws_tot, r.lat_ok, r.lat_tot, r.n_div) == (2, 2, 2, 3, 1)
    assert [x.slug for x in axis.divergences(df, pred, M, P).collect()] == ["a"]


# --- geometry, stance, blending -----------------------------------------------


def test_softmax_mean_against_numpy(spark):
    rng = np.random.default_rng(1)
    pole, chunk = rng.normal(size=(4, 8)), rng.normal(size=(5, 8))
    chunk[2] = 0
    p = spark.createDataFrame([(i, k.key, v.tolist()) for i, (k, v) in enumerate(zip(DEFAULT_POLES, pole, strict=True))], "pole_ord int, pole string, vec array<double>")
    c = spark.createDataFrame([(i // 3, i, v.tolist()) for i, v in enumerate(chunk)], "doc_id long, chunk_id int, embedding array<double>")
    got = geometry.pole_scores(spark.range(3).withColumnRenamed("id", "doc_id"), c, p, 0.03)
    norm = lambda x: np.where((n := np.linalg.norm(x, axis=1)) == 0, 1, n)
    z = chunk @ pole.T / (norm(chunk)[:, None] * norm(pole)) / 0.03
    e = np.exp(z - z.max(1, keepdims=True))
    prob = e / e.sum(1, keepdims=True)
    want = {0: prob[:3].mean(0), 1: prob[3:].mean(0), 2: np.zeros(4)}
    for r in got.collect():
        assert r.score == pytest.approx(want[r.doc_id][r.pole_ord])
    assert {r.doc_id: r.dominant_pole for r in geometry.dominant(got).collect()}[2] == DEFAULT_POLES[0].key


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2**-0.5), 0.0]


def blended(spark, cos, st, error=None, **more):
    c = spark.createDataFrame([(1, i, f"p{i}", v) for i, v in enumerate(cos)], "doc_id long, pole_ord int, pole string, score double")
    s = spark.createDataFrame([(1, f"p{i}", v, error) for i, v in enumerate(st)], "doc_id long, pole string, stance double, error string")
    return [r.score for r in blend.blend(c, s, **more).orderBy("pole_ord").collect()]


def test_blending(spark):
    assert blended(spark, [0.6, 0.4], [-1.0, 0.0], gamma=1.0) == [0, 1]
    assert blended(spark, [0.5, 0.5], [-1.0, -1.0], gamma=1.0) == [0.5, 0.5]
    assert blended(spark, [0.6], [0.0], alpha=0.4) == [pytest.approx(0.54)]
    assert blended(spark, [0.6, 0.4], [-1.0, 0.0], gamma=0.0) == [pytest.approx(0.6), pytest.approx(0.4)]
    assert blended(spark, [0.6, 0.4], [-1.0, 0.0], error="empty_text", gamma=1.0) == [0.6, 0.4]
    assert blended(spark, [0.6, 0.4], [-1.0], gamma=1.0) == [0, 1]
    assert blended(spark, [0.6, 0.4], [-1.0, 1.0]) == [0.6, 0.4]


def test_stance(spark):
    hyp = spark.createDataFrame([(0, "a", "pro", 0, "h1"), (0, "a", "pro", 1, "h2"), (0, "a", "contra", 0, "h3"), (1, "b", "pro", 0, "h4")], "pole_ord int, pole string, polarity string, idx int, hypothesis string")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (3, 0)], "doc_id long, chunk_id int")
    ent = spark.createDataFrame([(1, 0, "h1", 0.2), (1, 0, "h2", 0.8), (1, 0, "h3", 0.1), (1, 1, "h1", 0.4), (1, 2, "h1", None), (3, 0, "h1", None)], "doc_id long, chunk_id int, hypothesis string, p double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = {(r.doc_id, r.pole): r for r in stance.stance(docs, chunks, ent, hyp).collect()}
    a = got[1, "a"]
    assert (a.pro_mean, a.contra_mean, a.stance, a.n_chunks, a.error) == (pytest.approx(0.6), pytest.approx(0.05), pytest.approx(0.55), 3, None)
    assert got[1, "b"].stance == 0 and (got[2, "a"].stance, got[2, "a"].error) == (0, "empty_text")
    assert (got[3, "a"].stance, got[3, "a"].error, got[3, "a"].n_chunks) == (0, None, 1), "all chunks failed: no error"
    details = {(r.doc_id, r.hypothesis): r.mean_p for r in stance.stance_details(chunks, ent, hyp).collect()}
    assert details[1, "h1"] == pytest.approx(0.3) and details[1, "h2"] == pytest.approx(0.4)
    with pytest.raises(ValueError, match="unknown error"):
        stance.error_payload(docs, hyp, "x")


# --- bootstraps ---------------------------------------------------------------


def test_accuracy_numpy():
    for values in ([1] * 7, [0] * 3):
        r = bootstrap.accuracy_ci_numpy(values)
        assert r["ci_lo"] == r["ci_hi"] == r["point"] == values[0]
    v = np.array([1.0] * 23 + [0.0] * 4)
    r = bootstrap.accuracy_ci_numpy(v.tolist())
    rng = np.random.default_rng(42)
    means = [v[rng.integers(0, len(v), len(v))].mean() for _ in range(1000)]
    assert (r["point"], r["mean"]) == pytest.approx((v.mean(), np.mean(means))) and (r["ci_lo"], r["ci_hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    assert bootstrap.accuracy_ci_numpy([" TRUE", "no", "true ", "False", "1"])["point"] == 0.4
    assert bootstrap.accuracy_ci_numpy([]) == {"point": 0.0, "mean": 0.0, "ci_lo": 0.0, "ci_hi": 0.0, "n": 0, "n_iter": 1000, "seed": 42}


def test_paired_numpy():
    a, b = [1] * 16 + [0] * 4, [0] * 2 + [1] * 13 + [0] * 5
    r = bootstrap.paired_diff_ci_numpy(a, b)
    rng, v = np.random.default_rng(42), np.array(a) - np.array(b)
    means = [v[rng.integers(0, 20, 20)].mean() for _ in range(1000)]
    assert (r["point_a"], r["point_b"], r["diff"]) == pytest.approx((0.8, 0.65, 0.15)) and (r["ci_lo"], r["ci_hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    assert r["inconclusive"] == bool(r["ci_lo"] <= 0 <= r["ci_hi"])
    clear = bootstrap.paired_diff_ci_numpy([1] * 9, [0] * 9)
    assert clear["diff"] == 1 and not clear["inconclusive"] and bootstrap.paired_diff_ci_numpy(a, a)["inconclusive"] and bootstrap.paired_diff_ci_numpy([], [])["inconclusive"]
    with pytest.raises(ValueError, match="same texts"):
        bootstrap.paired_diff_ci_numpy([1, 0], [1])


def test_accuracy_hashed(spark):
    df = spark.createDataFrame([(f"t{i}", i < 23, i < 22) for i in range(27)], "slug string, correct boolean, other boolean")
    r = bootstrap.accuracy_ci(spark, df, draws=300).first()
    assert r.point == pytest.approx(23 / 27) and r.ci_lo < r.point <= r.ci_hi and r.n == 27
    pair = bootstrap.paired_diff_ci(spark, df, "correct", "other", draws=300).first()
    assert pair.inconclusive and (pair.point_a, pair.point_b) == pytest.approx((23 / 27, 22 / 27))
    none = bootstrap.accuracy_ci(spark, df.where("false"), draws=10).first()
    assert (none.point, none.n, none.ci_hi) == (0, 0, 0)


AGREED, SPLIT = [0.35, 0.6, 0.41, 0.52, 0.47, 0.58], [-0.5, 0.62, 0.1, -0.33, 0.21]


def test_text_intervals(spark):
    hits = spark.createDataFrame([("a", i, s) for i, s in enumerate(AGREED)] + [("b", i, s) for i, s in enumerate(SPLIT)], "slug string, tok_id int, score double")
    exact = {r.slug: (r.ci_low, r.ci_high) for r in bootstrap.text_ci_numpy(hits).collect()}
    v = np.array(AGREED)
    want = np.percentile(v[np.random.default_rng(42).integers(0, len(v), (1000, len(v)))].mean(1), [2.5, 97.5])
    assert exact["a"] == pytest.approx(tuple(want)) and exact["b"][0] < 0 < exact["b"][1]
    near = {r.slug: (r.ci_low, r.ci_high) for r in bootstrap.text_ci(spark, hits, 200).collect()}
    assert near["a"] == pytest.approx(exact["a"], abs=0.05)
    df = rows(spark, ("a", "seed", P, 0.49, 6), ("b", "seed", P, 0.02, 5), ("c", "seed", P, 0.0, 0))
    got = {r.slug: (r.sign_robust, r.ci_low) for r in axis.graded(df, M, P, bootstrap.text_ci_numpy(hits)).collect()}
    assert got["a"][0] and not got["b"][0] and got["c"] == (False, None)


def test_word_intervals(spark):
    docs = [(M, {"orbite": 5, "prix": 2}), (M, {"orbite": 1, "prix": 3}), (M, {"fusée": 2}), (P, {"haie": 2, "prix": 1}), (P, {"haie": 6, "prix": 2}), (P, {"haie": 1, "prix": 4})]
    c = counts(spark, *docs)
    t = c.select("slug", "pole", F.col("slug").alias("path")).distinct()
    got = {r.word: (r.ci_low, r.ci_high) for r in bootstrap.word_ci(c, bootstrap.numpy_document_draws(spark, t, (M, P), 200), M, P).collect()}
    assert got.keys() == {"prix", "haie"} and got["haie"] == (1, 1) and -1 <= got["prix"][0] < got["prix"][1] <= 1
    # the same by hand
    by = {M: [w for p, w in docs if p == M], P: [w for p, w in docs if p == P]}
    rng, seen = np.random.default_rng(12345), []
    for _ in range(200):
        tot, n = {}, {}
        for p in (M, P):
            own = [by[p][i] for i in rng.integers(0, 3, size=3)]
            n[p], tot[p] = sum(d.get("prix", 0) for d in own), sum(sum(d.values()) for d in own)
        a, b = n[M] / tot[M], n[P] / tot[P]
        if a + b:
            seen.append((b - a) / (a + b))
    assert got["prix"] == pytest.approx(tuple(np.percentile(seen, [2.5, 97.5])))
    hashed = bootstrap.word_ci(c, bootstrap.hashed_document_draws(spark, t, 100), M, P)
    assert {r.word for r in hashed.collect()} == {"prix", "haie"}


def test_axes():
    assert axis_poles("local-global") == ("local", "global") and set(AXES) == {"hors-sol-terrestre", "local-global"}
    with pytest.raises(ValueError, match="unknown axis"):
        axis_poles("x")
    assert Pole("a", "A").seeds == ()
