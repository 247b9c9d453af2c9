"""Lexicon calibration: document counts, Wordscores, and log-odds with a Dirichlet-like constant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polescale.config import DIGITS, LOWE_ALPHA
from polescale.functions.text import tokens
from polescale.operators.counting import row_words

KEY = ["word", "pos"]


def explode_tokens(texts: DataFrame, key: str = "slug", *more: str, tokenize=tokens) -> DataFrame:
    """A row for each token of ``body``, in order as ``tok_id``."""
    return texts.select(key, *more, F.posexplode(tokenize(F.col("body"))).alias("tok_id", "t")).select(key, *more, "tok_id", "t.word", "t.pos")


def token_counts(texts: DataFrame, key: str = "slug", tokenize=tokens) -> DataFrame:
    return texts.select(key, F.size(tokenize(F.col("body"))).cast("long").alias("n_tokens"))


def document_counts(texts: DataFrame, tokenize=tokens) -> DataFrame:
    """``slug, pole, word, pos, n``."""
    return explode_tokens(texts, "slug", "pole", tokenize=tokenize).groupBy("slug", "pole", *KEY).agg(F.count(F.lit(1)).alias("n"))


def single_documents(texts: DataFrame) -> bool:
    """Whether no two rows are of one document (slug, pole)."""
    return not texts.groupBy("slug", "pole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()


def row_counts(texts: DataFrame, tokenize=tokens) -> DataFrame:
    """As ``document_counts``; counted in rows without a shuffle where each document is one row."""
    return row_words(texts, "slug", "pole", tokenize=tokenize) if single_documents(texts) else document_counts(texts, tokenize)


def pole_totals(texts: DataFrame, tokenize=tokens) -> DataFrame:
    """Texts and tokens of each pole; no shuffle of tokens."""
    return texts.select("pole", F.size(tokenize(F.col("body"))).alias("k")).groupBy("pole").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("k").cast("long").alias("n_tokens"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEY).agg(F.countDistinct("slug").alias("n_docs"))


def frequencies(counts: DataFrame, minus: str, plus: str) -> DataFrame:
    """``word, pos, freq_minus, freq_plus, n_docs``: one aggregation, as a document has one row for each word."""
    of = lambda p: F.sum(F.when(F.col("pole") == p, F.col("n")).otherwise(0)).cast("long")
    return counts.where(F.col("pole").isin(minus, plus)).groupBy(*KEY).agg(of(minus).alias("freq_minus"), of(plus).alias("freq_plus"), F.count(F.lit(1)).alias("n_docs"))


def score_of(minus: Column, plus: Column, all_minus: Column, all_plus: Column, ref: tuple[float, float] = (-1.0, 1.0)) -> Column:
    """Reference scores weighted by relative frequencies; null if the word is in neither pole."""
    rm = F.coalesce(F.try_divide(minus, all_minus), F.lit(0.0))
    rp = F.coalesce(F.try_divide(plus, all_plus), F.lit(0.0))
    return F.try_divide(rm * ref[0] + rp * ref[1], rm + rp)


def wordscores(freqs: DataFrame, ref: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """Adds ``score``; totals are one row, joined as such."""
    totals = freqs.agg(F.sum("freq_minus").alias("_m"), F.sum("freq_plus").alias("_p"))
    scored = freqs.join(F.broadcast(totals)).withColumn("score", score_of(F.col("freq_minus"), F.col("freq_plus"), F.col("_m"), F.col("_p"), ref))
    return scored.where("score is not null").drop("_m", "_p")


def lowe(freqs: DataFrame, alpha: float = LOWE_ALPHA) -> DataFrame:
    """Adds ``score`` = difference of smoothed log shares; totals and vocabulary are those of the lexicon."""
    totals = freqs.agg(F.sum("freq_minus").alias("_m"), F.sum("freq_plus").alias("_p"), F.count(F.lit(1)).alias("_v"))
    log = lambda c, n: F.log((c + alpha) / (n + alpha * F.col("_v")))
    scored = freqs.join(F.broadcast(totals)).withColumn("score", log(F.col("freq_plus"), F.col("_p")) - log(F.col("freq_minus"), F.col("_m")))
    return scored.drop("_m", "_p", "_v")


def lexicon_rows(scored: DataFrame, cis: DataFrame | None = None) -> DataFrame:
    """The stored lexicon: scores rounded, interval or null, in order of word."""
    out = scored if cis is None else scored.join(cis, KEY, "left")
    if cis is None:
        out = out.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    rounded = [F.round(c, DIGITS).alias(c) for c in ("ci_low", "ci_high")]
    return out.select(*KEY, F.round("score", DIGITS).alias("score"), "freq_minus", "freq_plus", "n_docs", *rounded)
