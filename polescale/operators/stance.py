"""Stance of texts towards poles from entailment probabilities of pro and contra hypotheses.

``entailments`` has a row (doc_id, chunk_id, hypothesis, p) for each answer
of a model; a chunk on which the model failed has one row with null p. A
hypothesis missing from an answer counts 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Error codes of a text without stance.
ERRORS = ("hypotheses_missing", "hypotheses_empty", "language_not_supported", "nli_model_unavailable", "empty_text")


def _by_side(chunks: DataFrame, entailments: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``doc_id, pole_ord, pole, polarity, mean``: per chunk the best hypothesis, then the mean over chunks that did not fail."""
    failed = entailments.groupBy("doc_id", "chunk_id").agg(F.max(F.col("p").isNull()).alias("failed"))
    good = chunks.select("doc_id", "chunk_id").join(failed, ["doc_id", "chunk_id"]).where("not failed").select("doc_id", "chunk_id")
    sides = hypotheses.select("pole_ord", "pole", "polarity").distinct()
    best = entailments.join(F.broadcast(hypotheses), "hypothesis").groupBy("doc_id", "chunk_id", "pole_ord", "polarity").agg(F.max("p").alias("p"))
    grid = good.join(F.broadcast(sides))  # chunks times the few sides of the configuration
    full = grid.join(best, ["doc_id", "chunk_id", "pole_ord", "polarity"], "left")
    return full.groupBy("doc_id", "pole_ord", "pole", "polarity").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("mean"))


def stance(docs: DataFrame, chunks: DataFrame, entailments: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``doc_id, pole_ord, pole, pro_mean, contra_mean, stance, n_chunks, error``.

    ``stance`` is pro minus contra, within -1 and 1. If all chunks fail it is
    0 without an error; a text without chunks has the error empty_text.
    """
    side = _by_side(chunks, entailments, hypotheses)
    of = lambda s: F.max(F.when(F.col("polarity") == s, F.col("mean")))
    both = side.groupBy("doc_id", "pole_ord").agg(of("pro").alias("a"), of("contra").alias("b"))
    count = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    grid = docs.select("doc_id").join(F.broadcast(hypotheses.select("pole_ord", "pole").distinct()))
    j = grid.join(both, ["doc_id", "pole_ord"], "left").join(count, "doc_id", "left")
    pro, contra = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return j.select("doc_id", "pole_ord", "pole", pro.alias("pro_mean"), contra.alias("contra_mean"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pro - contra)).alias("stance"), F.coalesce("c", F.lit(0)).cast("long").alias("n_chunks"), F.when(F.col("c").isNull(), "empty_text").alias("error"))


def stance_details(chunks: DataFrame, entailments: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``doc_id, pole, polarity, idx, hypothesis, mean_p``: each hypothesis's mean over the chunks that did not fail."""
    failed = entailments.groupBy("doc_id", "chunk_id").agg(F.max(F.col("p").isNull()).alias("failed"))
    good = chunks.select("doc_id", "chunk_id").join(failed, ["doc_id", "chunk_id"]).where("not failed").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = entailments.groupBy("doc_id", "hypothesis").agg(F.sum("p").alias("s"))
    grid = good.join(F.broadcast(hypotheses))
    return grid.join(total, ["doc_id", "hypothesis"], "left").select("doc_id", "pole", "polarity", "idx", "hypothesis", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean_p"))


def error_payload(docs: DataFrame, poles: DataFrame, error: str) -> DataFrame:
    """Zero stance for every pole with the error code, in the shape of :func:`stance`."""
    if error not in ERRORS:
        raise ValueError(f"unknown error code {error!r}")
    zero = F.lit(0.0)
    return docs.select("doc_id").join(F.broadcast(poles.select("pole_ord", "pole"))).select("doc_id", "pole_ord", "pole", zero.alias("pro_mean"), zero.alias("contra_mean"), zero.alias("stance"), F.lit(0).cast("long").alias("n_chunks"), F.lit(error).alias("error"))
