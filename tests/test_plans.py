"""Corpora on disk, calibration, comparison, scoring, streaming, the command line, and the registry."""

import importlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from polescale import cli, config
from polescale.plans import calibrate, compare, providers, score
from polescale.sources import corpus, tables

ROOT = Path(__file__).resolve().parents[1]
M, P = "hors_sol", "terrestre"
MARKET = "marché croissance fusée algorithme marché "
LAND = "terre vivant sol forêt terre "


def page(label, role, seed, body):
    return f"---\ntitle: T\nattracteur: {label}\naudit:\n  role: {role}\n  use_for_seeds: {seed}\n---\n\n{body}\n"


@pytest.fixture
def root(tmp_path):
    c = tmp_path / "corpus"
    (c / "tests").mkdir(parents=True)
    for i in range(3):
        (c / f"hs{i}.md").write_text(page("hors-sol", "SEED", "true", MARKET * (i + 1) + "commun"), encoding="utf-8")
        (c / f"te{i}.md").write_text("﻿" + page("Terrestre", "seed ", "true", LAND * (i + 1) + "commun"), encoding="utf-8")
        (c / f"lo{i}.md").write_text(page("local+", "SEED", "true", "patrie frontière"), encoding="utf-8")
    (c / "inv.md").write_text(page("terrestre", "INVERSION-HOLD", "false", MARKET), encoding="utf-8")
    (c / "quoted.md").write_text(page("terrestre", "TEST", '"true"', LAND), encoding="utf-8")
    (c / "old.md").write_text("source: x\nattracteur: hors_sol\n\ndate: 1\nauteur: N\n\nVieux corps\n", encoding="utf-8")
    (c / "skip.en.md").write_text(page("nonsense", "SEED", "true", "x"), encoding="utf-8")
    (c / "._junk.md").write_text("junk", encoding="utf-8")
    (c / "tests" / "good.md").write_text(page("hors_sol", "TEST", "false", MARKET), encoding="utf-8")
    (c / "tests" / "both.md").write_text(page("cross:local/global", "SANITY", "false", LAND), encoding="utf-8")
    (c / "tests" / "none.md").write_text(page("null", "TEST", "false", "rien"), encoding="utf-8")
    return tmp_path


def test_reading(spark, root):
    got = {r.slug: r for r in corpus.read_corpus(spark, f"{root}/corpus").collect()}
    assert len(got) == 12 and got["te0"].expected_pole == P and got["te0"].role == "SEED" and got["old"].legacy
    assert got["old"].body.strip() == "Vieux corps" and got["quoted"].use_for_seeds is None
    assert json.loads(got["hs0"].header)["title"] == "T"
    seeds, out = corpus.axis_corpus(corpus.read_corpus(spark, f"{root}/corpus"), M, P)
    assert {r.slug for r in seeds.collect()} == {f"{a}{i}" for a in ("hs", "te") for i in range(3)} and [r.slug for r in out.collect()] == ["inv"]
    hold = corpus.read_holdout(spark, f"{root}/corpus/tests")
    assert {r.slug: r.expected_pole for r in hold.collect()} == {"good": M, "both": None, "none": None}
    assert corpus.read_holdout(spark, f"{root}/nowhere") is None
    assert {r.slug for r in corpus.eval_pool(hold, corpus.read_corpus(spark, f"{root}/corpus")).collect()} == {"good", "both", "none", "inv"}
    with pytest.raises(Exception, match="no pole is named"):
        corpus.read_corpus(spark, f"{root}/corpus/tests").collect()


def test_legacy_header():
    assert corpus.split_legacy("a: 1\n\nauteur: B: C\nx\n\nbody\n\nmore") == ({"a": "1", "auteur": "B: C"}, "body\n\nmore")
    assert corpus.split_legacy("A: 1\n\n\nbody") == ({"a": "1"}, "body")
    with pytest.raises(RuntimeError):
        corpus.split_legacy("a: 1\nb: 2")
    assert corpus.split_frontmatter("---\nno end") == ({}, "---\nno end")


def test_book(spark, tmp_path):
    b = tmp_path / "book"
    (b / "x").mkdir(parents=True)
    (b / "a.txt").write_bytes("été".encode("latin-1"))
    (b / "x" / "b.MD").write_text("deux", encoding="utf-8")
    (b / "c.pdf").write_text("no", encoding="utf-8")
    assert corpus.read_book(spark, str(b)).first().body == "été\ndeux"
    assert corpus.read_book(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("scoring", ["lbg", "lowe"])
def test_calibrate_and_compare(spark, root, scoring):
    assert calibrate.calibrate(spark, str(root), "hors-sol-terrestre", bootstrap_n=20) == 0
    folder = root / "axes" / "hors-sol-terrestre"
    lex = spark.read.parquet(f"{folder}/lexicon.parquet")
    assert lex.columns == ["word", "pos", "score", f"freq_{M}", f"freq_{P}", "n_docs", "ci_low", "ci_high"]
    got = {r.word: r for r in lex.collect()}
    assert got["marché"].score == -1 and got["terre"].score == 1 and (got["terre"].ci_low, got["terre"].ci_high) == (1, 1)
    assert {r.word: r.score for r in tables.read_lexicon(spark, f"{folder}/lexicon.csv").collect()} == {w: r.score for w, r in got.items()}
    assert {r.word: (r.freq_minus, r.freq_plus) for r in tables.read_pole_counts(spark, f"{folder}/lexicon.csv").collect()}["marché"] == (12, 0)
    preds = root / "preds"
    preds.mkdir()
    (preds / "good.prediction.json").write_text(json.dumps({"predicted_pole": P, "scores": {}}))
    (preds / "none.prediction.json").write_text(json.dumps({"slug": "none", "predicted_pole": None}))
    assert [(r.slug, r.predicted_pole) for r in tables.read_predictions(spark, str(preds)).collect()] == [("good", P)]
    (root / "book.txt").write_text(LAND, encoding="utf-8")
    assert compare.compare(spark, str(root), "hors-sol-terrestre", scoring=scoring, predictions_dir=str(preds), book_path=f"{root}/book.txt") == 0
    suffix = "" if scoring == "lbg" else "_lowe"
    rows = {(r.slug, r.category): r for r in spark.read.option("header", True).csv(f"{folder}/comparison{suffix}.csv").collect()}
    assert len(rows) == 6 + 1 + 3 + 1 and rows["inv", "inversion"].on_axis_correct == "0" and rows["good", "holdout"].on_axis_correct == "1"
    assert rows["book.txt", "oracle"].predicted_pole == P and rows["none", "holdout"].sign_robust == "False" and rows["hs0", "seed"].scoring == scoring
    assert {p.name for p in folder.iterdir() if not p.name.startswith(".")} == {"lexicon.csv", "lexicon.parquet", f"comparison{suffix}.csv", f"comparison-report{suffix}.md"}
    assert all(p.is_file() for p in folder.iterdir())
    said = (folder / f"comparison-report{suffix}.md").read_text(encoding="utf-8")
    assert compare.SCORINGS[scoring] in said and "book.txt lies on the Terrestre half" in said
    assert "Misclassified: 1 of 1" in said and "good: gold Hors-Sol, lexical Hors-Sol, other Terrestre" in said


def test_repeated_lexicon_rows(spark, tmp_path):
    (tmp_path / "l.csv").write_text("word,pos,score,freq_a,freq_b,n_docs,ci_low,ci_high\nterre,NOUN,0.9,1,12,8,0.7,1.0\nmarché,NOUN,-0.8,9,1,6,,\nterre,NOUN,0.5,2,3,8,,\n", encoding="utf-8")
    assert {r.word: r.score for r in tables.read_lexicon(spark, f"{tmp_path}/l.csv").collect()} == {"terre": 0.5, "marché": -0.8}
    assert {r.word: (r.freq_minus, r.freq_plus) for r in tables.read_pole_counts(spark, f"{tmp_path}/l.csv").collect()} == {"terre": (2, 3), "marché": (9, 1)}


def test_exit_codes(spark, root):
    assert calibrate.calibrate(spark, str(root), "x") == 1 and compare.compare(spark, str(root), "x") == 1
    assert compare.compare(spark, str(root), "local-global") == 1, "no lexicon yet"
    assert calibrate.calibrate(spark, str(root), "hors-sol-terrestre", dry_run=True) == 0 and not (root / "axes").exists()


def test_score(spark):
    docs = spark.createDataFrame([(1, "Nous dépendons des sols. " * 5), (2, None), (3, "Ce texte défend les milieux vivants.")], "doc_id long, text string")
    got = {r.doc_id: r for r in score.score(spark, docs, providers.hashed_embedder(), providers.overlap_entailment()).collect()}
    assert sum(got[1].scores.values()) == pytest.approx(1) and got[3].stance[P] > 0
    assert set(got[2].scores.values()) == {0.0} and got[2].dominant_pole == config.POLES[0]
    off = score.score(spark, docs, providers.hashed_embedder(), use_stance=False).first()
    assert off.stance is None and off.scores
    for more, error in (({"entailment": None}, "nli_model_unavailable"), ({"entailment": 1, "language": "en"}, "language_not_supported"), ({"entailment": 1, "hypotheses": ()}, "hypotheses_missing"), ({"entailment": 1, "hypotheses": (config.Hypotheses("a", "A"),)}, "hypotheses_empty")):
        args = {"hypotheses": config.DEFAULT_HYPOTHESES, "poles": config.DEFAULT_POLES} | more
        assert score.stance_rows(spark, docs, **args).first().error == error


def test_themes_and_yaml(spark, tmp_path):
    f = tmp_path / "t.yml"
    f.write_text("themes:\n  b: {label: B, seeds: [un deux]}\n  a: {}\npoles:\n  x: {label: X, hypotheses_pro: [p], hypotheses_contra: [c]}\n")
    themes = config.load_poles(f, "themes")
    assert [(t.key, t.label, t.seeds) for t in themes] == [("b", "B", ("un deux",)), ("a", "a", ())]
    assert config.load_hypotheses(f)[0].contra == ("c",)
    docs = spark.createDataFrame([(1, "un deux un deux")], "doc_id long, text string")
    got = score.theme_scores(spark, docs, themes, providers.hashed_embedder()).collect()
    assert {r.pole for r in got} == {"a", "b"} and max(got, key=lambda r: r.score).pole == "b"


def test_failing_model(spark):
    def broken():
        def model(text, hypotheses):
            if "bad" in text:
                raise RuntimeError("no")
            return {hypotheses[0]: 1.0}

        return model

    rows = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad"), (1, 2, " ")], "doc_id long, chunk_id int, text string")
    got = {(r.chunk_id, r.hypothesis): r.p for r in providers.entail(rows, ["h", "i"], broken).collect()}
    assert got == {(0, "h"): 1.0, (1, "h"): None}


def test_devices():
    assert [providers.device(x, True) for x in (None, "", "-1", "cpu", "1", "mps")] == ["cpu", "cpu", "cpu", "cpu", "cuda:1", "mps"]
    assert providers.device("0") == "cpu"


def test_stream_equals_batch(spark, tmp_path):
    from polescale.streaming import row_local_scores, windowed_means

    lex = spark.createDataFrame([("terre", "X", 0.9), ("marché", "X", -0.9)], "word string, pos string, score double")
    rows = spark.createDataFrame([("a", "terre terre marché", "2024-01-01 00:00:01"), ("b", "rien", "2024-01-01 00:07:00"), ("c", "marché", "2024-01-01 02:00:00")], "slug string, body string, t string").withColumn("ts", F.to_timestamp("t"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = row_local_scores(stream, lex).select("slug", "axis_score", "n_hits").writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.slug: (r.axis_score, r.n_hits) for r in row_local_scores(rows, lex).collect()}
    assert {r.slug: (r.axis_score, r.n_hits) for r in spark.table("scored").collect()} == batch
    assert batch["a"] == (pytest.approx(0.3), 3) and batch["b"] == (0.0, 0)
    w = windowed_means(row_local_scores(rows, lex), "ts", "5 minutes", "10 minutes").collect()
    assert len(w) == 3 and sum(r.n_texts for r in w) == 3


def test_command_line(spark, root, capsys):
    assert cli.main(["score", "  "]) == 2
    (root / "x.txt").write_text("Nous dépendons des sols.", encoding="utf-8")
    assert cli.main(["score", "other", "--file", f"{root}/x.txt", "--json"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert abs(sum(said["scores"].values()) - 1) < 1e-6 and said["pole_order"] == list(config.POLES) and said["blend_gamma"] == 1 and said["stance"]["n_chunks"] == 1
    assert cli.main(["score", "un mot", "--no-stance"]) == 0 and "←" in capsys.readouterr().out
    assert cli.main(["calibrate", "--axis", "x"]) == 1
    assert cli.main(["calibrate", "--axis", "hors-sol-terrestre", "--root", str(root), "--bootstrap-n", "0"]) == 0
    assert cli.main(["compare", "--axis", "hors-sol-terrestre", "--root", str(root), "--dry-run"]) == 0


def test_root_from_the_environment(monkeypatch):
    monkeypatch.setenv("POLESCALE_ROOT", "/some/where")
    assert cli.parser().parse_args(["calibrate", "--axis", "x"]).root == "/some/where"
    monkeypatch.delenv("POLESCALE_ROOT")
    assert cli.parser().parse_args(["compare", "--axis", "x"]).root == "/data/corpus"


def test_light_import():
    """Importing the package starts no Spark and loads no model library."""
    code = "import sys, polescale.config, polescale.queries, polescale.plans.score; bad = {'torch', 'spacy', 'transformers', 'redis', 'psycopg'} & set(sys.modules); sys.exit(bool(bad))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin"}).returncode == 0


def test_registry():
    e = importlib.import_module("__spark_entry__")
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(o) > 60


@pytest.mark.parametrize("name", ["wordscores_lexicon", "graded_texts", "segment_strategy", "chunk_pack", "semaxis_scores", "blend_gamma", "stance_scores", "eval_pool", "document_chunks", "word_ci", "corpus_files", "axis_corpus_files", "reference_book", "comparison_files", "compared_files", "report_figures", "scored_texts", "prediction_files"])
def test_queries_match_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    if not folder.is_dir():
        pytest.skip("no test tables here")
    e = importlib.import_module("__spark_entry__")
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    want = c.sql(e.oracle_sql()[name])
    got = e.queries()[name](spark, str(folder))
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(r[x] for x in cols) for r in got.collect()), key=key)
    b = sorted(want.select(*cols).fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y) if all(isinstance(v, float) for v in x) else [v if not isinstance(v, float) else round(v, 6) for v in x] == [v if not isinstance(v, float) else round(v, 6) for v in y]
