"""Blending of pole scores with stance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _with_stance(scores: DataFrame, stance: DataFrame) -> DataFrame:
    """Poles that only the stance knows are dropped; missing ones are 0."""
    s = stance.select("doc_id", "pole", F.col("stance").alias("_s"), F.col("error").alias("_e"))
    return scores.join(s, ["doc_id", "pole"], "left")


def blend_gamma(scores: DataFrame, stance: DataFrame, gamma: float) -> DataFrame:
    """max(0, score + gamma * stance), made to sum to 1; uniform if all are clipped. Without stance, or with an error, the score."""
    g = max(0.0, gamma)
    w = Window.partitionBy("doc_id")  # the few poles of a text
    j = _with_stance(scores, stance)
    raw = F.greatest(F.lit(0.0), F.col("score") + g * F.coalesce("_s", F.lit(0.0)))
    total = F.sum("_raw").over(w)
    pure = (F.count("_s").over(w) == 0) | (F.count("_e").over(w) > 0)
    blended = F.when(total <= 0, 1.0 / F.count(F.lit(1)).over(w)).otherwise(F.try_divide(F.col("_raw"), total))
    out = j.withColumn("_raw", raw)
    return out.select("doc_id", "pole_ord", "pole", F.when(pure, F.col("score")).otherwise(blended).alias("score"), F.when(~pure, F.col("score")).alias("cosine_score"), F.when(~pure, F.coalesce("_s", F.lit(0.0))).alias("stance_score"))


def blend_alpha(scores: DataFrame, stance: DataFrame, alpha: float) -> DataFrame:
    """alpha * score + (1 - alpha) * (stance + 1) / 2, not made to sum to 1."""
    a = min(1.0, max(0.0, alpha))
    w = Window.partitionBy("doc_id")
    j = _with_stance(scores, stance)
    pure = (F.count("_s").over(w) == 0) | (F.count("_e").over(w) > 0)
    mixed = a * F.col("score") + (1 - a) * (F.coalesce("_s", F.lit(0.0)) + 1.0) / 2.0
    return j.select("doc_id", "pole_ord", "pole", F.when(pure, F.col("score")).otherwise(mixed).alias("score"), F.when(~pure, F.col("score")).alias("cosine_score"), F.when(~pure, F.coalesce("_s", F.lit(0.0))).alias("stance_score"))


def blend(scores: DataFrame, stance: DataFrame | None, gamma: float | None = None, alpha: float | None = None) -> DataFrame:
    """Gamma if given (0 as well), else alpha, else the scores alone."""
    if stance is not None and gamma is not None:
        return blend_gamma(scores, stance, gamma)
    if stance is not None and alpha is not None:
        return blend_alpha(scores, stance, alpha)
    none = F.lit(None).cast("double")
    return scores.select("doc_id", "pole_ord", "pole", "score", none.alias("cosine_score"), none.alias("stance_score"))


def score_block(blended: DataFrame) -> DataFrame:
    """``doc_id, scores map, dominant_pole``; ties to the first pole in order."""
    entries = F.sort_array(F.collect_list(F.struct("pole_ord", "pole", "score")))  # the few poles of a text
    best = F.max(F.struct("score", (-F.col("pole_ord")).alias("o"), "pole")).getField("pole")
    return blended.groupBy("doc_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["pole"], e["score"]))).alias("scores"), best.alias("dominant_pole"))
