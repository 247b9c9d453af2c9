"""Comparison of texts with a lexicon: scores, grades, tables and a report."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.config import AXES, LABELS, TEXT_CI_DRAWS
from polescale.functions.text import tokens
from polescale.operators import axis as ax
from polescale.operators import bootstrap, wordscores
from polescale.sources import corpus, tables
from polescale.sources.files import work_table

log = logging.getLogger(__name__)
#: Where a text's score comes from, by scoring.
SCORINGS = {
    "lbg": "lbg: mean of the lexicon's stored word scores in [-1, 1], reference scores weighted by relative frequency",
    "lowe": "lowe: mean of smoothed log-odds of each word between the poles, computed anew from the lexicon's counts; not bounded",
}


def category_texts(root: DataFrame, holdout: DataFrame | None, minus: str, plus: str, book: DataFrame | None = None, book_pole: str | None = None) -> DataFrame:
    """``slug, category, gold_pole, body``: on-axis seeds, all inversions, all hold-out texts, the reference book.

    A text that is a seed and an inversion stands twice.
    """
    pick = lambda df, name: df.select("slug", F.lit(name).alias("category"), F.col("expected_pole").alias("gold_pole"), "body")
    out = pick(corpus.seed_pool(root).where(F.col("expected_pole").isin(minus, plus)), "seed").unionByName(pick(corpus.inversions(root), "inversion"))
    if holdout is not None:
        out = out.unionByName(pick(holdout, "holdout"))
    if book is not None:
        out = out.unionByName(book.select("slug", F.lit("oracle").alias("category"), F.lit(book_pole).alias("gold_pole"), "body"))
    return out


def score_texts(spark: SparkSession, texts: DataFrame, lexicon: DataFrame, minus: str, plus: str, draws: int = TEXT_CI_DRAWS, exact: bool = True, tokenize=tokens) -> DataFrame:
    """Graded rows with intervals; ``exact`` takes NumPy's draws. The texts' hits are written once, for scores and intervals."""
    keyed = texts.withColumn("_key", F.concat_ws("\x01", "category", "slug"))
    bare = keyed.select(F.col("_key").alias("slug"), "body")
    hits = work_table(ax.text_hits(bare, lexicon, tokenize), "hits")
    scored = ax.hit_scores(bare, hits, tokenize)
    ci = bootstrap.array_ci(hits, draws, exact=exact)
    names = keyed.select("_key", F.col("slug").alias("_slug"), "category", "gold_pole")
    j = scored.join(names, F.col("slug") == F.col("_key"))
    return ax.graded(j, minus, plus, ci).drop("_key", "slug").withColumnRenamed("_slug", "slug")


def share(ok: int, total: int) -> str:
    return f"{ok}/{total} ({100 * ok / total:.1f}%)" if total else f"{ok}/{total} (n/a)"


def report(rows: DataFrame, axis: str, scoring: str, predictions: DataFrame | None = None) -> str:
    """A Markdown report of measured numbers. Only its tables' rows come to the driver: a benchmark's texts, not a corpus."""
    minus, plus = AXES[axis]
    name = lambda p: LABELS.get(p, p) if p else "—"
    rows = rows.select("slug", "category", "gold_pole", "predicted_pole", "axis_score", "n_hits", "on_axis", "correct").persist()
    acc = {r["category"]: (r["n_correct"], r["n_graded"]) for r in ax.accuracy_by_category(rows).collect()}
    out = [f"# Axis {name(minus)} – {name(plus)}", "", f"Scoring: {SCORINGS[scoring]}.", "", "| Texts | Correct of gradable |", "|---|---|"]
    out += [f"| {c} | {share(*acc.get(c, (0, 0)))} |" for c in ("seed", "holdout", "inversion", "oracle") if c in acc or c in ("seed", "holdout")]
    out += ["", "## Seeds by pole", "", "| Pole | Texts | Correct | Undecided |", "|---|---|---|---|"]
    by = {r["gold_pole"]: r for r in ax.confusion(rows).collect()}
    out += [f"| {name(p)} | {by[p]['n']} | {by[p]['n_correct']} | {by[p]['n_undecided']} |" if p in by else f"| {name(p)} | 0 | 0 | 0 |" for p in (minus, plus)]
    bad = ax.inversion_counts(rows).first()
    out += ["", "## Inversions", "", f"Misclassified: {bad['n_misclassified']} of {bad['n_gradable']}.", "", "| Text | Gold | Predicted | Score | Hits | Outcome |", "|---|---|---|---|---|---|"]
    out += [f"| {r['slug']} | {name(r['gold_pole'])} | {name(r['predicted_pole'])} | {r['axis_score']:+.3f} | {r['n_hits']} | {r['outcome']} |" for r in ax.inversion_outcomes(rows).orderBy("slug").toLocalIterator()]
    holdout = rows.where("category = 'holdout'")
    if predictions is not None:
        h = ax.head_to_head(holdout, predictions, minus, plus).first()
        out += ["", "## Two methods on the hold-out", "", f"Lexical: {share(h['ws_ok'], h['ws_tot'])}. Other: {share(h['lat_ok'], h['lat_tot'])}.", "", "Exactly one is right:", ""]
        found = [f"- {r['slug']}: gold {name(r['gold_pole'])}, lexical {name(r['predicted_pole'])}, other {name(r['other_pole'])}" for r in ax.divergences(holdout, predictions, minus, plus).orderBy("slug").toLocalIterator()]
        out += found or ["- none"]
    out += ["", "## Hold-out", "", "| Text | Gold | Predicted | " + ("Other | " if predictions is not None else "") + "Score | Hits |", "|---|---|---|" + ("---|" if predictions is not None else "") + "---|---|"]
    shown = holdout if predictions is None else ax.with_predictions(holdout, predictions)
    for r in shown.orderBy("slug").toLocalIterator():
        other = f"{name(r['other_pole'])} | " if predictions is not None else ""
        out.append(f"| {r['slug']} | {name(r['gold_pole'])} | {name(r['predicted_pole'])} | {other}{r['axis_score']:+.3f} | {r['n_hits']} |")
    for r in rows.where("category = 'oracle'").toLocalIterator():
        # a book without a sign does not lie on the expected side, so it counts as the other
        side = r["predicted_pole"] or (minus if r["gold_pole"] == plus else plus)
        out += ["", "## Reference book", "", f"{r['slug']} lies on the {name(side)} half at {r['axis_score']:+.3f} ({r['n_hits']} hits); expected {name(r['gold_pole'])}: {'as it should' if side == r['gold_pole'] else 'not as it should'}."]
    rows.unpersist()
    return "\n".join(out) + "\n"


def compare(spark: SparkSession, root: str, axis: str, dry_run: bool = False, lexicon_path: str | None = None, holdout_dir: str | None = None, book_path: str | None = None, predictions_dir: str | None = None, scoring: str = "lbg", tokenize=tokens) -> int:
    """Score and grade ``root``'s texts; write CSV and report beside the lexicon. 0, or 1 if axis, scoring or lexicon is wrong."""
    if axis not in AXES or scoring not in SCORINGS:
        log.error("unknown axis %s or scoring %s", axis, scoring)
        return 1
    minus, plus = AXES[axis]
    path = lexicon_path or f"{root}/axes/{axis}/lexicon.csv"
    if not corpus._exists(spark, path):
        log.error("no lexicon at %s; calibrate first", path)
        return 1
    lex = tables.read_lexicon(spark, path) if scoring == "lbg" else wordscores.lowe(tables.read_pole_counts(spark, path))
    holdout = corpus.read_holdout(spark, holdout_dir or f"{root}/corpus/tests")
    book = corpus.read_book(spark, book_path) if book_path and axis == "hors-sol-terrestre" else None
    read = work_table(corpus.read_corpus(spark, f"{root}/corpus").select("slug", "expected_pole", "role", "use_for_seeds", "body"), "corpus")
    texts = work_table(category_texts(read, holdout, minus, plus, book, plus), "texts")  # files are read and parsed once
    rows = work_table(score_texts(spark, texts, lex, minus, plus, tokenize=tokenize), "rows")  # report and table read it
    predictions = tables.read_predictions(spark, predictions_dir) if predictions_dir and corpus._exists(spark, predictions_dir) else None
    said = report(rows, axis, scoring, predictions)
    if not dry_run:
        suffix = "" if scoring == "lbg" else f"_{scoring}"
        tables.write_comparison(rows, f"{root}/axes/{axis}/comparison{suffix}.csv", scoring)
        tables.write_one(spark.createDataFrame([(said.rstrip("\n"),)], "value string"), f"{root}/axes/{axis}/comparison-report{suffix}.md", "text")
    print(said)
    return 0
