"""Calibration of a lexicon from a labelled corpus."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.config import AXES, MIN_DOCS_PER_POLE
from polescale.functions.text import tokens
from polescale.operators import bootstrap, wordscores
from polescale.sources import corpus, tables
from polescale.sources.files import work_table

log = logging.getLogger(__name__)


def lexicon(spark: SparkSession, texts: DataFrame, minus: str, plus: str, draws: DataFrame | bootstrap.DrawnBlocks | None = None, tokenize=tokens) -> DataFrame:
    """Stored lexicon rows of ``texts`` (slug, pole, body); intervals if document draws are given."""
    counts = wordscores.row_counts(texts, tokenize)
    if draws is not None:  # read by scores and intervals
        counts = work_table(counts, "counts")
    scored = wordscores.wordscores(work_table(wordscores.frequencies(counts, minus, plus), "freqs"))
    return wordscores.lexicon_rows(scored, None if draws is None else bootstrap.word_ci(counts, draws, minus, plus))


def calibrate(spark: SparkSession, root: str, axis: str, dry_run: bool = False, min_docs_per_pole: int = MIN_DOCS_PER_POLE, bootstrap_n: int = 0, tokenize=tokens) -> int:
    """Read ``root``/corpus, write ``root``/axes/``axis``; 0, or 1 for an unknown axis or an empty corpus."""
    if axis not in AXES:
        log.error("unknown axis %s", axis)
        return 1
    minus, plus = AXES[axis]
    kept, excluded = corpus.axis_corpus(corpus.read_corpus(spark, f"{root}/corpus"), minus, plus)
    texts = work_table(kept.select("path", "slug", F.col("expected_pole").alias("pole"), "body"), "texts")  # files are read and parsed once
    sizes = {r["pole"]: r["n"] for r in texts.groupBy("pole").agg(F.count(F.lit(1)).alias("n")).collect()}  # two poles
    if not sizes:
        log.error("no seed text on axis %s", axis)
        return 1
    for p in (minus, plus):
        if sizes.get(p, 0) < min_docs_per_pole:
            log.warning("only %d texts for pole %s", sizes.get(p, 0), p)
    draws = None
    if bootstrap_n and not dry_run:
        # published intervals have NumPy's draws, which only a small corpus can have
        exact = sum(sizes.values()) <= bootstrap.MOST_NUMPY_DOCS
        draws = bootstrap.numpy_document_draws(spark, texts, (minus, plus), bootstrap_n) if exact else bootstrap.hashed_blocks(spark, texts, bootstrap_n)
    rows = work_table(lexicon(spark, texts.drop("path"), minus, plus, draws, tokenize), "lexicon")  # two files, each in order, come of it
    log.info("%d texts, %d inversions left out", sum(sizes.values()), excluded.count())
    if not dry_run:
        tables.write_lexicon(rows, f"{root}/axes/{axis}", minus, plus)
    return 0
