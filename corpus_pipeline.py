"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves,
with the columns of ``documents``; the last adds ``copy`` (with underscores
behind, if there is such a column). Rows are told apart by their place in the
order of (doc_id, text), so null and repeated ids do no harm, and further
columns pass through under their own names, whatever these are. Null, empty
and very long texts, ties, repeated rows and empty tables go as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm import decontam, minhash, mixing, quality, suffix
from polescale.llm.common import Workspace, documents_of, free_names, scratch, table

#: Similarity in percent from which the stage links documents; op3's own contract has 85.
NEAR_PERCENT = 80


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _rows(spark: SparkSession, docs: DataFrame, name: str, without: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents as an operator takes them with doc_id = _uid, rows as (_uid, _row) to join back)."""
    own = F.struct(*[F.col(_quoted(c)) for c in docs.columns if c not in without]).alias("_row")
    base = documents_of(Workspace(spark, name), docs, own)
    return base.select(F.col("_uid").alias("doc_id"), F.col("_text").alias("text"), F.col("_row.source").alias("source")), base.select("_uid", "_row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule or whose host is rejected."""
    plain, rows = _rows(spark, docs, "stage-quality")
    kept = quality.judge(spark, plain).where("kept").select("_uid")
    return rows.join(kept, "_uid", "left_semi").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates."""
    plain, rows = _rows(spark, docs, "stage-near")
    kept = minhash.near_duplicates(spark, plain, percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("_uid"))
    return rows.join(kept, "_uid", "left_semi").select("_row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 100 that came before out of the texts; every document stays."""
    plain, rows = _rows(spark, docs, "stage-suffix", ("text",))
    cut = suffix.remove_repeats(spark, plain).select("_uid", F.col("kept_text").alias("_kept"))
    own = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return rows.join(cut, "_uid").select(*[own.get(c, F.col(f"_row.{_quoted(c)}")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of the benchmark."""
    plain, rows = _rows(spark, docs, "stage-leaks")
    gone = decontam.leaks(spark, plain, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_uid")).distinct()
    return rows.join(gone, "_uid", "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: a row for each copy, ``copy`` from 1."""
    plain, rows = _rows(spark, docs, "stage-mix")
    taken = mixing.mix(spark, plain).where("copies > 0").select("_uid", "copies")
    out = rows.join(taken, "_uid").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    [copy] = free_names(docs, "copy")
    return out.select("_row.*", F.col("_copy").cast("long").alias(copy))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: MinHash components and greedy tiles are not expressible in SQL; tests/llm compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = ws.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
