"""Scoring of text streams. An addition: the reference computations are batch only.

Lexical scores and segmentation are row-local here, so they run unchanged on
a stream; windows aggregate them with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polescale.functions.text import tokens
from polescale.operators.axis import axis_scores

#: A lexicon of more rows than this is joined (``joined_scores``), not shipped in every row's expression.
MOST_ROW_LOCAL = 50_000


def scores(texts: DataFrame, lexicon: DataFrame, tokenize=tokens) -> DataFrame:
    """Adds ``axis_score, n_hits, n_tokens`` to static ``texts`` (body), by the way that the lexicon's size asks for.

    A stream with a large lexicon calls this in ``foreachBatch``; its batches are static.
    """
    small = lexicon.limit(MOST_ROW_LOCAL + 1).count() <= MOST_ROW_LOCAL
    return (row_local_scores if small else joined_scores)(texts, lexicon, tokenize)


def joined_scores(texts: DataFrame, lexicon: DataFrame, tokenize=tokens) -> DataFrame:
    """The same columns as ``row_local_scores`` for static ``texts`` and a lexicon of any size, by a join.

    Rows are told apart by their body's digest, as nothing else need be unique. Rows of one body are scored together: their
    mean is each one's, their hits are shared out; so bodies themselves are never shuffled.
    """
    key = F.unhex(F.sha2(F.coalesce("body", F.lit("")), 256))  # as bytes: it stands in each row of a text's words
    bodies = texts.select(key.alias("slug"), F.coalesce("body", F.lit("")).alias("body"))
    scored = axis_scores(bodies, lexicon.where("score is not null"), tokenize).withColumnRenamed("slug", "_body")
    scored = scored.groupBy("_body").agg(F.first("axis_score").alias("axis_score"), (F.first("n_hits") / F.count(F.lit(1))).cast("long").alias("n_hits"), F.first("n_tokens").alias("n_tokens"))
    return texts.withColumn("_body", key).join(scored, "_body").select(*texts.columns, "axis_score", "n_hits", "n_tokens")


def row_local_scores(texts: DataFrame, lexicon: DataFrame, tokenize=tokens) -> DataFrame:
    """Adds ``axis_score, n_hits, n_tokens`` to ``texts`` (body), static or streaming, without a shuffle.

    The lexicon (word, pos, score) is one broadcast row; its size is checked. For larger ones see ``scores``.
    """
    key = F.concat_ws("\x01", "word", "pos")
    few = lexicon.limit(MOST_ROW_LOCAL + 1).agg(F.map_from_entries(F.collect_list(F.struct(key, "score"))).alias("_lexicon"))
    checked = few.select(F.when(F.size("_lexicon") <= MOST_ROW_LOCAL, F.col("_lexicon")).otherwise(F.raise_error(F.lit("lexicon too large for row-local scoring"))).alias("_lexicon"))
    j = texts.join(F.broadcast(checked)).withColumn("_t", tokenize(F.col("body")))
    found = F.filter(F.transform("_t", lambda t: F.try_element_at(F.col("_lexicon"), F.concat_ws("\x01", t["word"], t["pos"]))), lambda s: s.isNotNull())
    j = j.withColumn("_s", found)
    total = F.aggregate("_s", F.lit(0.0), lambda a, s: a + s)
    return j.withColumns({"axis_score": F.coalesce(F.try_divide(total, F.size("_s")), F.lit(0.0)), "n_hits": F.size("_s").cast("long"), "n_tokens": F.size("_t").cast("long")}).drop("_t", "_s", "_lexicon")


def windowed_means(scored: DataFrame, ts: str, width: str, delay: str, *keys: str | Column) -> DataFrame:
    """Mean score and hits in tumbling windows of event time; rows later than ``delay`` are dropped."""
    w = scored.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys)
    out = w.agg(F.avg("axis_score").alias("mean_score"), F.sum("n_hits").alias("n_hits"), F.count(F.lit(1)).alias("n_texts"))
    return out.withColumn("start", F.col("window.start")).withColumn("end", F.col("window.end")).drop("window")
