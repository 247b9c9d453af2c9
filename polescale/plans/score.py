"""Scoring of texts on the poles: segment, chunk, embed, softmax, stance, blend, argmax."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.config import DEFAULT_HYPOTHESES, DEFAULT_POLES, GAMMA, TAU, TAU_SCORE, Hypotheses, Pole, hypotheses_frame, poles_frame
from polescale.functions.text import chunks as chunk_texts
from polescale.operators import blend, geometry, stance
from polescale.plans import providers


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, text`` of ``docs`` (doc_id, text); no shuffle."""
    return docs.select("doc_id", F.posexplode(chunk_texts(F.col("text"))).alias("chunk_id", "text"))


def pole_table(spark: SparkSession, poles: tuple[Pole, ...], embedder: Callable) -> DataFrame:
    seeds = poles_frame(spark, poles).select("pole_ord", "pole", F.explode("seeds").alias("text"))
    return geometry.pole_vectors(providers.embed(seeds, embedder))


def theme_scores(spark: SparkSession, docs: DataFrame, themes: tuple[Pole, ...], embedder: Callable, tau: float | None = None) -> DataFrame:
    """Scores of arbitrary themes, by the same geometry."""
    vectors = providers.embed(chunk_rows(docs), embedder)
    return geometry.pole_scores(docs, vectors, pole_table(spark, themes, embedder), TAU if tau is None else tau)


def score(spark: SparkSession, docs: DataFrame, embedder: Callable, entailment: Callable | None = None, poles: tuple[Pole, ...] = DEFAULT_POLES, hypotheses: tuple[Hypotheses, ...] = DEFAULT_HYPOTHESES, gamma: float | None = GAMMA, alpha: float | None = None, use_stance: bool = True, softmax_tau: float | None = TAU_SCORE, language: str = "fr") -> DataFrame:
    """``doc_id, scores, dominant_pole, stance``; without stance gamma plays no part.

    A null text is an empty one: all scores 0, the first pole dominant.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cos = theme_scores(spark, docs, poles, embedder, softmax_tau)
    found = stance_rows(spark, docs, entailment, hypotheses, poles, language) if use_stance else None
    out = blend.score_block(blend.blend(cos, found, gamma if use_stance else None, alpha))
    if found is None:
        return out.withColumn("stance", F.lit(None).cast("map<string,double>"))
    each = found.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("pole_ord", "pole", "stance"))), lambda e: F.struct(e["pole"], e["stance"]))).alias("stance"))
    return out.join(each, "doc_id", "left")


def stance_rows(spark: SparkSession, docs: DataFrame, entailment: Callable | None, hypotheses: tuple[Hypotheses, ...], poles: tuple[Pole, ...], language: str = "fr") -> DataFrame:
    """Stance by pole; a missing model, empty hypotheses or another language give zero scores and an error code."""
    table = poles_frame(spark, poles)
    if not hypotheses:
        return stance.error_payload(docs, table, "hypotheses_missing")
    if not any(h.pro or h.contra for h in hypotheses):
        return stance.error_payload(docs, table, "hypotheses_empty")
    if language != "fr":
        return stance.error_payload(docs, table, "language_not_supported")
    if entailment is None:
        return stance.error_payload(docs, table, "nli_model_unavailable")
    rows = chunk_rows(docs).where(F.length(F.trim("text")) > 0)
    texts = list(dict.fromkeys(t for h in hypotheses for t in (*h.pro, *h.contra)))
    return stance.stance(docs, rows, providers.entail(rows, texts, entailment), hypotheses_frame(spark, hypotheses))


def score_payload(spark: SparkSession, docs: DataFrame, embedder: Callable, entailment: Callable | None = None, poles: tuple[Pole, ...] = DEFAULT_POLES, hypotheses: tuple[Hypotheses, ...] = DEFAULT_HYPOTHESES, gamma: float | None = GAMMA, alpha: float | None = None, use_stance: bool = True, softmax_tau: float | None = TAU_SCORE, language: str = "fr", model: str | None = None, hypotheses_file: str = "") -> DataFrame:
    """``doc_id`` and the full result of a text: ``scores, labels, pole_order, dominant_pole`` always; with stance
    ``cosine_scores, stance_scores`` and the ``blend_gamma`` or ``blend_alpha`` that was used (null where an error leaves
    the cosine scores alone), and ``stance``: its own scores, method, model, hypotheses, details, chunks and error."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cos = theme_scores(spark, docs, poles, embedder, softmax_tau)
    by_pole = lambda df, c, name: df.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("pole_ord", "pole", c))), lambda e: F.struct(e["pole"], e[c]))).alias(name))  # noqa: E731  the few poles of a text
    found = stance_rows(spark, docs, entailment, hypotheses, poles, language) if use_stance else None
    mixed = blend.blend(cos, found, gamma if use_stance else None, alpha)
    out = blend.score_block(mixed)
    keys = F.array(*[F.lit(p.key) for p in poles])
    labels = F.map_from_arrays(keys, F.array(*[F.lit(p.label) for p in poles]))
    out = out.withColumn("labels", labels).withColumn("pole_order", keys)
    if found is None:
        return out
    for c, name in (("cosine_score", "cosine_scores"), ("stance_score", "stance_scores")):
        out = out.join(by_pole(mixed.where(F.col(c).isNotNull()), c, name), "doc_id", "left")
    used = F.col("cosine_scores").isNotNull()
    by_gamma = gamma is not None
    out = out.withColumn("blend_gamma", F.when(used, F.lit(max(0.0, gamma) if by_gamma else None).cast("double")))
    out = out.withColumn("blend_alpha", F.when(used, F.lit(None if by_gamma or alpha is None else min(1.0, max(0.0, alpha))).cast("double")))

    first = found.groupBy("doc_id").agg(F.first("n_chunks").alias("n"), F.first("error").alias("e"))
    block = by_pole(found, "stance", "s").join(first, "doc_id")
    own = {p.key: h for p in poles for h in hypotheses if h.key == p.key}
    texts = lambda side: F.map_from_arrays(keys, F.array(*[F.array(*map(F.lit, getattr(own[p.key], side) if p.key in own else ())).cast("array<string>") for p in poles]))
    means = F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("pole_ord", "pole", "pro_mean", "contra_mean"))), lambda e: F.struct(e["pole"], F.struct(e["pro_mean"].alias("pro_mean"), e["contra_mean"].alias("contra_mean")))))
    details = found.where("error is null").groupBy("doc_id").agg(means.alias("details"))
    block = block.join(details, "doc_id", "left")
    per = _per_hypothesis(spark, docs, entailment, hypotheses, language)
    block = block.join(per, "doc_id", "left") if per is not None else block.withColumn("per", F.lit(None).cast("map<string,struct<pro:array<double>,contra:array<double>>>"))
    failed = F.col("e").isNotNull()
    result = F.struct(F.col("s").alias("scores"), labels.alias("labels"), keys.alias("pole_order"), F.lit("nli_zero_shot").alias("method"), F.when(~failed, F.lit(model).cast("string")).alias("model"), F.lit(hypotheses_file).alias("hypotheses_file"), F.when(~failed, texts("pro")).alias("hypotheses_pro"), F.when(~failed, texts("contra")).alias("hypotheses_contra"), "details", F.when(~failed, F.col("per")).alias("per_hypothesis"), F.col("n").alias("n_chunks"), F.col("e").alias("error"))
    return out.join(block.select("doc_id", result.alias("stance")), "doc_id", "left")


def _per_hypothesis(spark: SparkSession, docs: DataFrame, entailment: Callable | None, hypotheses: tuple[Hypotheses, ...], language: str) -> DataFrame | None:
    """``doc_id, per``: pole -> mean probabilities of its hypotheses, in their order."""
    if entailment is None or language != "fr" or not any(h.pro or h.contra for h in hypotheses):
        return None
    rows = chunk_rows(docs).where(F.length(F.trim("text")) > 0)
    asked = list(dict.fromkeys(t for h in hypotheses for t in (*h.pro, *h.contra)))
    d = stance.stance_details(rows, providers.entail(rows, asked, entailment), hypotheses_frame(spark, hypotheses))
    side = lambda s: F.transform(F.sort_array(F.filter(F.collect_list(F.struct("polarity", "idx", "mean_p")), lambda x: x["polarity"] == s)), lambda x: x["mean_p"])  # noqa: E731  a pole's hypotheses
    each = d.groupBy("doc_id", "pole").agg(F.struct(side("pro").alias("pro"), side("contra").alias("contra")).alias("v"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("pole", "v"))).alias("per"))
