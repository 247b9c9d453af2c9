"""Axis scores of texts from a lexicon, their grading, and comparisons of methods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polescale.functions.labels import correct, predict, sign_robust
from polescale.functions.text import tokens
from polescale.operators.counting import ROWS, n_tokens, parts, row_words
from polescale.operators.wordscores import KEY, explode_tokens


def hits(texts: DataFrame, lexicon: DataFrame, tokenize=tokens) -> DataFrame:
    """In-lexicon token occurrences with their scores, in text order; adaptive execution broadcasts a small lexicon."""
    return explode_tokens(texts, tokenize=tokenize).join(lexicon.select(*KEY, "score"), KEY).select("slug", "tok_id", *KEY, "score")


def axis_scores(texts: DataFrame, lexicon: DataFrame, tokenize=tokens) -> DataFrame:
    """``slug, axis_score, n_hits, n_tokens``; a text without hits scores 0.

    A text's words are counted in its row, so just its distinct words meet
    the lexicon, and neither tokens nor bodies are shuffled.
    """
    found = row_words(texts, "slug", tokenize=tokenize).join(_looked_up(lexicon), KEY)
    found = found.groupBy("slug").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("s"), F.sum("n").alias("h"))
    return _scored(texts, found, tokenize)


def _looked_up(lexicon: DataFrame) -> DataFrame:
    """A part of the lexicon is small beside the words of texts that meet it: it is hashed, and they need not be sorted."""
    return lexicon.select(*KEY, "score").hint("shuffle_hash")


def _scored(texts: DataFrame, found: DataFrame, tokenize) -> DataFrame:
    base = texts.select("slug", n_tokens(tokenize).alias("n_tokens"))
    return base.join(found, "slug", "left").select("slug", F.coalesce("s", F.lit(0.0)).alias("axis_score"), F.coalesce("h", F.lit(0)).cast("long").alias("n_hits"), "n_tokens")


def text_hits(texts: DataFrame, lexicon: DataFrame, tokenize=tokens) -> DataFrame:
    """``slug, s``: a text's in-lexicon scores as one array in text order (bounded by the text); texts without hits are left out.

    Texts of one slug are interleaved by place, then score, as ``hits`` in order would be.
    """
    found = row_words(texts, "slug", tokenize=tokenize, places=True).join(_looked_up(lexicon), KEY)
    return in_text_order(found.groupBy("slug").agg(F.collect_list(F.struct("score", "at")).alias("own")))


def in_text_order(gathered: DataFrame) -> DataFrame:
    """``slug, s`` from ``slug, own array<struct<score, at array<int>>>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in parts(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), ROWS):
                part = b.slice(at, end - at)
                score, places = part.column(1).flatten().flatten()
                words, k = part.column(1).value_lengths().to_numpy(zero_copy_only=False), places.value_lengths().to_numpy(zero_copy_only=False)
                s = np.repeat(score.to_numpy(zero_copy_only=False), k)
                text = np.repeat(np.repeat(np.arange(len(words)), words), k)
                s = s[np.lexsort((s, places.flatten().to_numpy(), text))]
                ends = np.r_[0, np.cumsum(np.bincount(text, minlength=len(words)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(s))], names=["slug", "s"])

    return gathered.mapInArrow(run, f"slug {gathered.schema['slug'].dataType.simpleString()}, s array<double>")


def hit_scores(texts: DataFrame, hits: DataFrame, tokenize=tokens) -> DataFrame:
    """``axis_scores`` from ``text_hits``."""
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    return _scored(texts, hits.select("slug", mean.alias("s"), F.size("s").cast("long").alias("h")), tokenize)


def graded(scored: DataFrame, minus: str, plus: str, cis: DataFrame | None = None) -> DataFrame:
    """Adds ``predicted_pole, on_axis, correct`` and, with intervals, ``ci_low, ci_high, sign_robust``."""
    p = predict(F.col("axis_score"), F.col("n_hits"), minus, plus)
    out = scored.withColumn("predicted_pole", p).withColumn("on_axis", F.coalesce(F.col("gold_pole").isin(minus, plus), F.lit(False)))
    out = out.withColumn("correct", correct(F.col("predicted_pole"), F.col("gold_pole"), minus, plus))
    if cis is None:
        return out
    return out.join(cis, "slug", "left").withColumn("sign_robust", sign_robust(F.col("axis_score"), F.col("ci_low"), F.col("ci_high")))


def accuracy_by_category(rows: DataFrame) -> DataFrame:
    """``category, n_correct, n_graded`` over gradable rows."""
    return rows.groupBy("category").agg(F.count_if("correct").alias("n_correct"), F.count("correct").alias("n_graded"))


def confusion(rows: DataFrame) -> DataFrame:
    """Per gold pole of the on-axis seeds: texts, correct ones, undecided ones."""
    seeds = rows.where("category = 'seed' and on_axis")
    return seeds.groupBy("gold_pole").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("predicted_pole").isNull()).alias("n_undecided"))


def inversion_outcomes(rows: DataFrame) -> DataFrame:
    """Inversion texts with ``outcome``: off_axis, correct or misclassified."""
    outcome = F.when(F.col("correct").isNull(), "off_axis").when(F.col("correct"), "correct").otherwise("misclassified")
    return rows.where("category = 'inversion'").select("slug", "gold_pole", "predicted_pole", "axis_score", "n_hits", outcome.alias("outcome"))


def inversion_counts(rows: DataFrame) -> DataFrame:
    return rows.where("category = 'inversion'").agg(F.count_if(~F.col("correct")).alias("n_misclassified"), F.count("correct").alias("n_gradable"))


def with_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    return rows.join(predictions.select("slug", F.col("predicted_pole").alias("other_pole")), "slug", "left")


def head_to_head(holdout: DataFrame, predictions: DataFrame, minus: str, plus: str) -> DataFrame:
    """One row: the lexical method on this axis's golds, the other on every gold it predicts, and how often just one is right."""
    j = with_predictions(holdout, predictions)
    on = F.coalesce(F.col("gold_pole").isin(minus, plus), F.lit(False))
    mine = F.coalesce(F.col("predicted_pole") == F.col("gold_pole"), F.lit(False))
    theirs = F.coalesce(F.col("other_pole") == F.col("gold_pole"), F.lit(False))
    both = F.col("gold_pole").isNotNull() & F.col("other_pole").isNotNull()
    count = lambda c, n: F.count_if(c).alias(n)
    return j.agg(count(on & mine, "ws_ok"), count(on, "ws_tot"), count(both & theirs, "lat_ok"), count(both, "lat_tot"), count(on & F.col("other_pole").isNotNull() & (mine != theirs), "n_div"))


def divergences(holdout: DataFrame, predictions: DataFrame, minus: str, plus: str) -> DataFrame:
    """On-axis texts where exactly one method is right."""
    j = with_predictions(holdout, predictions).where(F.col("gold_pole").isin(minus, plus) & F.col("other_pole").isNotNull())
    mine = F.coalesce(F.col("predicted_pole") == F.col("gold_pole"), F.lit(False))
    return j.where(mine != (F.col("other_pole") == F.col("gold_pole"))).select("slug", "gold_pole", "predicted_pole", "other_pole")
