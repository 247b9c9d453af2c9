"""Pole vectors, similarity of chunks to poles, softmax and its mean over chunks.

The poles are the configuration's few rows. They are gathered to one row
that is broadcast; each chunk meets it once and is scored within its row, so
scoring chunks needs no shuffle before the mean over a text's chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polescale.config import TAU, TAU_FLOOR
from polescale.functions.vector import dot, norm, softmax

#: A pole table with more rows than this is not configuration.
MOST_POLES = 10_000


def pole_vectors(seeds: DataFrame) -> DataFrame:
    """``pole_ord, pole, vec`` from seed embeddings ``pole_ord, pole, embedding``: the mean, not normalised again."""
    long = seeds.select("pole_ord", "pole", F.posexplode("embedding").alias("d", "v"))
    mean = long.groupBy("pole_ord", "pole", "d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    sorted_ = F.sort_array(F.collect_list(F.struct("d", "m")))  # one vector
    return mean.groupBy("pole_ord", "pole").agg(F.transform(sorted_, lambda x: x["m"]).alias("vec"))


def _gathered(poles: DataFrame) -> DataFrame:
    """All poles as one row, in pole order; their number is checked."""
    rows = F.sort_array(F.collect_list(F.struct("pole_ord", "pole", "vec", norm(F.col("vec")).alias("norm"))))
    few = F.when(F.size(rows) <= MOST_POLES, rows).otherwise(F.raise_error(F.lit(f"more than {MOST_POLES} poles")))
    return poles.limit(MOST_POLES + 1).agg(few.alias("_poles"))


def _similarities(vec: Column, poles: Column) -> Column:
    own = norm(vec)
    safe = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(poles, lambda p: dot(vec, p["vec"]) / (safe(own) * safe(p["norm"])))


def similarities(chunks: DataFrame, poles: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, _poles, sims``: cosines in pole order; a zero vector is similar to nothing."""
    j = chunks.join(F.broadcast(_gathered(poles)))
    return j.select("doc_id", "chunk_id", "_poles", _similarities(F.col("embedding"), F.col("_poles")).alias("sims"))


def similarity_matrix(chunks: DataFrame, poles: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, pole_ord, pole, sim``."""
    s = similarities(chunks, poles).select("doc_id", "chunk_id", F.explode(F.arrays_zip("_poles", "sims")).alias("x"))
    return s.select("doc_id", "chunk_id", "x._poles.pole_ord", "x._poles.pole", F.col("x.sims").alias("sim"))


def chunk_softmax(chunks: DataFrame, poles: DataFrame, tau: float = TAU) -> DataFrame:
    """``doc_id, chunk_id, pole_ord, pole, prob``."""
    s = similarities(chunks, poles)
    s = s.select("doc_id", "chunk_id", "_poles", softmax(F.col("sims"), F.lit(max(tau, TAU_FLOOR))).alias("prob"))
    s = s.select("doc_id", "chunk_id", F.explode(F.arrays_zip("_poles", "prob")).alias("x"))
    return s.select("doc_id", "chunk_id", "x._poles.pole_ord", "x._poles.pole", "x.prob")


def pole_scores(docs: DataFrame, chunks: DataFrame, poles: DataFrame, tau: float = TAU) -> DataFrame:
    """``doc_id, pole_ord, pole, score``: mean softmax over chunks, summing to 1; all 0 for a text without chunks."""
    mean = chunk_softmax(chunks, poles, tau).groupBy("doc_id", "pole_ord").agg(F.avg("prob").alias("p"))
    grid = docs.select("doc_id").join(F.broadcast(_gathered(poles))).select("doc_id", F.explode("_poles").alias("x")).select("doc_id", "x.pole_ord", "x.pole")
    return grid.join(mean, ["doc_id", "pole_ord"], "left").select("doc_id", "pole_ord", "pole", F.coalesce("p", F.lit(0.0)).alias("score"))


def dominant(scores: DataFrame) -> DataFrame:
    """``doc_id, dominant_pole``: the best score, ties to the first pole in order."""
    best = F.max(F.struct("score", (-F.col("pole_ord")).alias("o"), "pole"))
    return scores.groupBy("doc_id").agg(best.getField("pole").alias("dominant_pole"))
