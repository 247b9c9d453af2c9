"""Corpora of Markdown files, hold-outs, reference books and direct texts."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.config import INVERSION_HOLD
from polescale.functions.labels import fold_pole, fold_pole_or_none, is_seed, role
from polescale.functions.text import strip

log = logging.getLogger(__name__)
BOM = "\ufeff"


def direct(spark: SparkSession, text: str | None) -> DataFrame:
    """``doc_id, text`` of one text; None is empty."""
    return spark.createDataFrame([(0, text or "")], "doc_id long, text string")


def split_legacy(raw: str) -> tuple[dict[str, str], str]:
    """Flat ``key: value`` header and body.

    The header ends at the first blank line after ``auteur:``, else at the
    first blank line; without one there is no border and that is an error.
    """
    rows = raw.splitlines()
    blank = [i for i, r in enumerate(rows) if not r.strip()]
    author = [i for i, r in enumerate(rows) if r.strip().lower().startswith("auteur:")]
    end = next((i for i in blank if author and i > author[0]), blank[0] if blank else None)
    if end is None:
        raise RuntimeError("no blank line between header and body")
    pairs = (r.partition(":") for r in rows[:end] if ":" in r)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, "\n".join(rows[end + 1 :]).lstrip("\n")


def split_frontmatter(raw: str) -> tuple[dict, str]:
    """YAML between two ``---`` lines, and the body; no closing line leaves everything to the body."""
    import yaml

    rows = raw.split("\n")
    end = next((i for i, r in enumerate(rows[1:], 1) if r.strip() == "---"), None)
    if end is None:
        return {}, raw.strip()
    meta = yaml.safe_load("\n".join(rows[1:end]))
    return (meta if isinstance(meta, dict) else {}), "\n".join(rows[end + 1 :]).strip()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (raw or "").lstrip(BOM)
            legacy = raw.split("\n", 1)[0].strip() != "---"
            header, body = split_legacy(raw) if legacy else split_frontmatter(raw)
            audit = header.get("audit")
            audit = audit if isinstance(audit, dict) else {}
            label, flag, r = header.get("attracteur"), audit.get("use_for_seeds"), audit.get("role")
            row = (path, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], None if label is None else str(label), None if r is None else str(r), flag if isinstance(flag, bool) else None, legacy, json.dumps(header, default=str, ensure_ascii=False), body)
            for to, x in zip(cols, row, strict=True):
                to.append(x)
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "slug", "attracteur", "role", "use_for_seeds", "legacy", "header", "body"])


def read_corpus(spark: SparkSession, folder: str, require_pole: bool = True) -> DataFrame:
    """``path, slug, attracteur_raw, expected_pole, role, use_for_seeds, legacy, header (JSON), body`` of a folder's ``*.md``.

    Not recursive; ``._*`` and ``*.en.md`` are skipped. With ``require_pole``
    an unknown label is an error, else the pole is null.
    """
    files = spark.read.option("recursiveFileLookup", False).text(folder, wholetext=True, pathGlobFilter="*.md")
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw"))
    named = named.where(~F.col("name").startswith("._") & ~F.col("name").endswith(".en.md")).select("path", "raw")
    kinds = "path string, slug string, attracteur string, role string, use_for_seeds boolean, legacy boolean, header string, body string"
    rows = named.mapInArrow(_parse, kinds)
    pole = fold_pole(F.coalesce("attracteur", F.lit(""))) if require_pole else fold_pole_or_none(F.col("attracteur"))
    return rows.select("path", "slug", F.coalesce("attracteur", F.lit("")).alias("attracteur_raw"), pole.alias("expected_pole"), role(F.col("role")).alias("role"), "use_for_seeds", "legacy", "header", "body")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_holdout(spark: SparkSession, folder: str) -> DataFrame | None:
    """As :func:`read_corpus` without demanding poles; None if there is no such folder."""
    if not _exists(spark, folder):
        log.warning("no hold-out texts at %s", folder)
        return None
    return read_corpus(spark, folder, require_pole=False)


def seed_pool(corpus: DataFrame) -> DataFrame:
    """Texts that may build a lexicon: ``use_for_seeds`` is true, not merely "true"."""
    return corpus.where(is_seed(F.col("use_for_seeds")))


def inversions(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("role") == INVERSION_HOLD)


def eval_pool(holdout: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hold-out texts and the corpus's inversions; a seed among them is an error."""
    both = holdout.unionByName(inversions(corpus))
    leak = F.when(is_seed(F.col("use_for_seeds")), F.raise_error(F.concat(F.lit("seed text in the evaluation pool: "), F.col("slug"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(leak)


def axis_corpus(corpus: DataFrame, minus: str, plus: str) -> tuple[DataFrame, DataFrame]:
    """(seeds on the axis, slugs of inversions on the axis left out)."""
    on = F.col("expected_pole").isin(minus, plus)
    return seed_pool(corpus).where(on), inversions(corpus).where(on).select("slug")


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """One row ``slug, body``: the text of a file, or of all .txt, .md and bare files below a folder, in order of path.

    UTF-8, else Latin-1; empty or missing gives no row. A book is one text.
    """
    empty = spark.createDataFrame([], "slug string, body string")
    if not _exists(spark, path):
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    good = ~name.startswith("._") & (name.rlike(r"(?i)\.(txt|md)$") | ~name.contains("."))
    single = files.select("path", name.alias("n"), "content").where(good | (F.col("path").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("path", text.alias("t")))), lambda x: x["t"])
    body = strip(F.array_join(parts, "\n"))
    slug = path.rstrip("/").rsplit("/", 1)[-1]
    return single.agg(body.alias("body")).where("body <> ''").select(F.lit(slug).alias("slug"), "body")
