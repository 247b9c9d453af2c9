"""Registered queries of readers, writers and whole computations over files, and of small expressions; with their DuckDB SQL.

Files are written to the shared folder from the driver's tables and read back:
each conversation is a text of the corpus (every fourth with the old flat
header), each benchmark item a hold-out text and a chapter of the reference
book.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale import config
from polescale import queries as q
from polescale.config import AXES, FOLD, LABELS, POLES
from polescale.functions import labels as lb
from polescale.functions import text as tx
from polescale.functions import vector
from polescale.operators import axis as ax
from polescale.operators import stance
from polescale.operators import wordscores as ws
from polescale.plans import compare as cmp
from polescale.plans import providers
from polescale.sources import corpus, files, tables

AXIS = "hors-sol-terrestre"
MINUS, PLUS = AXES[AXIS]
# Raw labels of the corpus's texts, taken in turn; roles likewise.
RAW = ["terrestre", "Hors-Sol", "horssol", "Terrestre", "hors_sol", "local+", "GLOBAL-"]
ROLES = ["SEED", "seed", "INVERSION-HOLD", "Test", "SEED"]


def _turn(c, xs: list[str]):
    return F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    """``id, slug, raw, raw_role, use, legacy, body`` of the texts, as they are written."""
    i = F.col("conv_id")
    talks = q.talks(spark, d).select(i, tx.strip("text").alias("body"))
    return talks.select(i.alias("id"), F.concat(F.lit("text_"), F.lpad(i.cast("string"), 6, "0")).alias("slug"), _turn(i, RAW).alias("raw"), _turn(i, ROLES).alias("raw_role"), (i % 5 != 2).alias("use"), (i % 4 == 3).alias("legacy"), "body")


def write_corpus(spark: SparkSession, d: str, folder: str) -> str:
    """``corpus``, ``corpus/tests`` and ``book`` below the folder; with files that readers must skip."""
    c = corpus_rows(spark, d)
    new = F.concat(F.lit("---\ntitle: Text of "), "slug", F.lit("\nattracteur: "), "raw", F.lit("\naudit:\n  role: "), "raw_role", F.lit("\n  use_for_seeds: "), F.col("use").cast("string"), F.lit("\n---\n\n"), "body", F.lit("\n"))
    old = F.concat(F.lit("source: "), "slug", F.lit("\nattracteur: "), "raw", F.lit("\nauteur: nobody\n\n"), "body", F.lit("\n"))
    items = q.t(spark, d, "benchmark").select("item_id", tx.strip("text").alias("body"))
    name = F.concat(F.lit("item_"), F.lpad(F.col("item_id").cast("string"), 6, "0"))
    held = items.select(F.concat(F.lit("corpus/tests/"), name, F.lit(".md")).alias("name"), F.concat(F.lit("﻿---\nattracteur: "), F.when(F.col("item_id") % 3 == 0, "cross:a/b").otherwise(_turn(F.col("item_id"), RAW)), F.lit("\naudit:\n  role: TEST\n---\n"), "body").alias("content"))
    end = _turn(F.col("item_id"), [".txt", ".MD", ""])
    book = items.select(F.concat(F.lit("book/"), F.when(F.col("item_id") % 2 == 0, "part/").otherwise(""), name, end).alias("name"), F.col("body").alias("content"))
    skipped = spark.createDataFrame([("corpus/._text.md", "no header"), ("corpus/text.en.md", "no header"), ("corpus/notes.txt", "x"), ("corpus/deeper/text.md", "---\n---\nx"), ("book/cover.png", "x"), ("book/._x.txt", "x")], "name string, content string")
    all_ = c.select(F.concat(F.lit("corpus/"), "slug", F.lit(".md")).alias("name"), F.when(F.col("legacy"), old).otherwise(new).alias("content")).union(held).union(book).union(skipped)
    files.write_files(all_, folder)
    return folder


def _root(spark: SparkSession, d: str) -> str:
    return write_corpus(spark, d, files.shared_folder(spark, "corpus"))


# --- readers and writers ------------------------------------------------------


def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.read_corpus(spark, f"{_root(spark, d)}/corpus")
    return c.select("slug", "attracteur_raw", "expected_pole", "role", "use_for_seeds", "legacy", F.md5(F.col("body").cast("binary")).alias("digest"), F.length("body").cast("long").alias("n_chars"))


def frontmatter_headers(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.read_corpus(spark, f"{_root(spark, d)}/corpus").where("not legacy")
    return c.select("slug", F.get_json_object("header", "$.title").alias("title"), F.get_json_object("header", "$.audit.role").alias("raw_role"))


def legacy_headers(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.read_corpus(spark, f"{_root(spark, d)}/corpus").where("legacy")
    return c.select("slug", F.get_json_object("header", "$.source").alias("source"), F.get_json_object("header", "$.auteur").alias("auteur"))


def holdout_files(spark: SparkSession, d: str) -> DataFrame:
    h = corpus.read_holdout(spark, f"{_root(spark, d)}/corpus/tests")
    return h.select("slug", "expected_pole", "role", "use_for_seeds", F.md5(F.col("body").cast("binary")).alias("digest"))


def axis_corpus_files(spark: SparkSession, d: str) -> DataFrame:
    kept, left = corpus.axis_corpus(corpus.read_corpus(spark, f"{_root(spark, d)}/corpus"), MINUS, PLUS)
    return kept.select("slug", "expected_pole").union(left.select("slug", F.lit(None).cast("string")))


def reference_book(spark: SparkSession, d: str) -> DataFrame:
    b = corpus.read_book(spark, f"{_root(spark, d)}/book")
    return b.select("slug", F.md5(F.col("body").cast("binary")).alias("digest"), F.length("body").cast("long").alias("n_chars"))


def direct_text(spark: SparkSession, d: str) -> DataFrame:
    return corpus.direct(spark, "Un texte.").union(corpus.direct(spark, None))


def _yaml(spark: SparkSession, d: str, lines: list[str]) -> Path:
    folder = files.shared_folder(spark, "yaml")
    files.write_files(spark.createDataFrame([("c.yml", "\n".join(lines) + "\n")], "name string, content string"), folder)
    return Path(folder.removeprefix("file://"))


def themes_yaml(spark: SparkSession, d: str) -> DataFrame:
    """A configuration of regions as poles and their nations as seeds, written, loaded and shown as a table."""
    rows = q.t(spark, d, "nation").join(q.t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_regionkey", "n_nationkey").collect()  # configuration
    lines, last = ["themes:"], None
    for r in rows:
        if r.r_name != last:
            lines += [f"  {r.r_name}:", f"    label: 'of {r.r_name}'", "    seeds:"]
            last = r.r_name
        lines.append(f"      - '{r.n_name}'")
    poles = config.load_poles(_yaml(spark, d, lines) / "c.yml", "themes")
    p = config.poles_frame(spark, poles).select("pole_ord", "pole", "label", F.posexplode("seeds").alias("seed_ord", "seed"))
    return p.select(F.col("pole_ord").cast("long").alias("pole_ord"), "pole", "label", F.col("seed_ord").cast("long").alias("seed_ord"), "seed")


def hypotheses_yaml(spark: SparkSession, d: str) -> DataFrame:
    rows = q.t(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").collect()  # configuration
    lines, last = ["poles:"], None
    for r in rows:
        if r.n_regionkey != last:
            lines.append(f"  r{r.n_regionkey}:")
            lines.append("    hypotheses_pro:")
            last = r.n_regionkey
        lines.append(f"      - '{r.n_name}'")
    h = config.hypotheses_frame(spark, config.load_hypotheses(_yaml(spark, d, lines) / "c.yml"))
    return h.select(F.col("pole_ord").cast("long").alias("pole_ord"), "pole", "polarity", F.col("idx").cast("long").alias("idx"), "hypothesis")


def lexicon_files(spark: SparkSession, d: str) -> DataFrame:
    """Written and read back: scores by name, counts by place."""
    folder = files.shared_folder(spark, "lexicon")
    tables.write_lexicon(q.lbg(spark, d), folder, MINUS, PLUS)
    scores, counts = tables.read_lexicon(spark, f"{folder}/lexicon.csv"), tables.read_pole_counts(spark, f"{folder}/lexicon.csv")
    return scores.join(counts, ["word", "pos"])


def lexicon_parquet(spark: SparkSession, d: str) -> DataFrame:
    folder = files.shared_folder(spark, "lexicon")
    tables.write_lexicon(q.lbg(spark, d), folder, MINUS, PLUS)
    return spark.read.schema(tables.lexicon_schema(MINUS, PLUS)).parquet(f"{folder}/lexicon.parquet").drop("ci_low", "ci_high")


def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    folder = files.shared_folder(spark, "predictions")
    s = F.col("conv_id")
    pole = F.when(s % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), _turn(s, list(POLES)), F.lit('"')))
    own = F.when(s % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"slug": "s'), s.cast("string"), F.lit('", ')))
    rows = q.t(spark, d, "conversations").select("conv_id").distinct()
    rows = rows.select(F.concat(F.lit("f"), s.cast("string"), F.lit(".prediction.json")).alias("name"), F.concat(F.lit("{\n"), own, F.lit('"predicted_pole": '), pole, F.lit(',\n"scores": {}}')).alias("content"))
    files.write_files(rows, folder)
    return tables.read_predictions(spark, folder)


def interval_table(scored: DataFrame) -> DataFrame:
    """A stand-in for intervals that SQL can repeat: wider for fewer hits, none below twenty."""
    wide = F.lit(0.4) / F.sqrt("n_hits")
    return scored.where("n_hits >= 20").select("slug", F.round(F.col("axis_score") - wide, 9).alias("ci_low"), F.round(F.col("axis_score") + wide, 9).alias("ci_high"))


def _with_intervals(spark: SparkSession, d: str) -> DataFrame:
    g = q.graded(spark, d)
    return ax.graded(g.drop("predicted_pole", "on_axis", "correct"), MINUS, PLUS, interval_table(g))


def graded_with_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _with_intervals(spark, d).select("slug", q.r6("axis_score"), q.r6("ci_low"), q.r6("ci_high"), "sign_robust")


def comparison_files(spark: SparkSession, d: str) -> DataFrame:
    """The stored table, read back as text."""
    path = f"{files.shared_folder(spark, 'comparison')}/comparison.csv"
    g = _with_intervals(spark, d)
    tables.write_comparison(g.withColumns({c: F.col(c) + q.NUDGE for c in ("axis_score", "ci_low", "ci_high")}), path, "lbg")
    back = spark.read.option("header", True).csv(path).fillna("")
    return back.withColumn("axis_score", F.col("axis_score").cast("double"))


def lexicon_with_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows with word intervals from 500 hashed draws."""
    rows = ws.lexicon_rows(ws.wordscores(q.freqs(spark, d)), q.word_ci(spark, d))
    return rows.select("word", "pos", "score", "freq_minus", "freq_plus", "n_docs", q.r6("ci_low"), q.r6("ci_high"))


# --- whole computations ---------------------------------------------------------


def _calibrated(spark: SparkSession, d: str) -> str:
    from polescale.plans.calibrate import calibrate

    root = _root(spark, d)
    if calibrate(spark, root, AXIS):
        raise ValueError("no seed text in the conversations")
    return root


def calibrated_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Calibration from files to file; read back."""
    path = f"{_calibrated(spark, d)}/axes/{AXIS}/lexicon.csv"
    scores = tables.read_lexicon(spark, path)
    return scores.join(tables.read_pole_counts(spark, path), ["word", "pos"])


def category_texts(spark: SparkSession, d: str) -> DataFrame:
    root = _root(spark, d)
    c = corpus.read_corpus(spark, f"{root}/corpus")
    x = cmp.category_texts(c, corpus.read_holdout(spark, f"{root}/corpus/tests"), MINUS, PLUS, corpus.read_book(spark, f"{root}/book"), PLUS)
    return x.select("slug", "category", "gold_pole", F.length("body").cast("long").alias("n_chars"))


def _compared(spark: SparkSession, d: str, scoring: str) -> tuple[str, DataFrame]:
    import contextlib
    import io

    root = _calibrated(spark, d)
    with contextlib.redirect_stdout(io.StringIO()):
        if cmp.compare(spark, root, AXIS, book_path=f"{root}/book", scoring=scoring):
            raise ValueError("nothing to compare")
    end = "" if scoring == "lbg" else f"_{scoring}"
    return root, spark.read.option("header", True).csv(f"{root}/axes/{AXIS}/comparison{end}.csv").fillna("")


def _compared_columns(rows: DataFrame) -> DataFrame:
    """Without what NumPy's draws give."""
    return rows.select("slug", "category", "gold_pole", "predicted_pole", F.round(F.col("axis_score").cast("double") + 1e-8, 5).alias("axis_score"), F.col("n_lexicon_hits").cast("long").alias("n_lexicon_hits"), F.col("n_tokens").cast("long").alias("n_tokens"), "on_axis_correct", "scoring")


def compared_files(spark: SparkSession, d: str) -> DataFrame:
    """Comparison from files to file, the reference book too; read back."""
    return _compared_columns(_compared(spark, d, "lbg")[1])


def compared_files_lowe(spark: SparkSession, d: str) -> DataFrame:
    return _compared_columns(_compared(spark, d, "lowe")[1])


def report_figures(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the written report: correct of gradable by kind of text, seeds by pole, inversions."""
    root, _ = _compared(spark, d, "lbg")
    text = spark.read.text(f"{root}/axes/{AXIS}/comparison-report.md")
    return text.where(F.col("value").rlike(r"^(\| (seed|holdout|inversion|oracle) \||Misclassified)")).select(F.col("value").alias("line"))


# --- expressions ------------------------------------------------------------------


def fold_strict(spark: SparkSession, d: str) -> DataFrame:
    c = corpus_rows(spark, d)
    return c.select("slug", lb.fold_pole(F.col("raw")).alias("pole"), lb.display(lb.fold_pole(F.col("raw"))).alias("shown"), lb.role(F.col("raw_role")).alias("role"))


def axis_registry(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(a, *config.axis_poles(a)) for a in AXES], "axis string, minus_pole string, plus_pole string")


def devices(spark: SparkSession, d: str) -> DataFrame:
    """Device of a setting without and with CUDA."""
    rows = q.t(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()  # five
    wishes = [None, "", "-1", "cpu", "mps", *(str(r.r_regionkey) for r in rows), "cuda:1"]
    return spark.createDataFrame([(w, providers.device(w), providers.device(w, True)) for w in wishes], "setting string, without string, with_cuda string")


def nonblank_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = q.t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return c.where(F.length(F.trim("text")) > 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def interval_text(spark: SparkSession, d: str) -> DataFrame:
    e = q.t(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    return e.select("vec_id", tx.format_ci(*[F.round(c, 6) + 1e-9 for c in ("x0", "x1", "x2")]).alias("shown"))


def correctness_vector(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("doc_id")
    words = _turn(s, ["True", " true ", "False", "1", "yes", ""])
    return q.t(spark, d, "documents").select("doc_id", lb.as_correct(words, "string").alias("of_text"), lb.as_correct(s % 3, "long").alias("of_number"), lb.as_correct(F.when(s % 4 == 0, None).otherwise(s % 2 == 0), "boolean").alias("of_flag"))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Of each vector and the next."""
    e = q.t(spark, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return j.select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("other")) + q.NUDGE, 6).alias("cosine"))


def content_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Of words tagged by their length: which are kept, in which form, how often."""
    w = F.regexp_extract_all("text", F.lit(r"(\p{L}+|[0-9]+)"), F.lit(1))
    tag = lambda x: F.struct(x.alias("lemma"), _turn(F.length(x), ["NOUN", "DET", "VERB", "ADJ", "ADP", "PROPN"]).alias("pos"), (F.lower(x) == "the").alias("is_stop"), x.rlike("^[0-9]+$").alias("is_punct"), F.lit(False).alias("is_space"))
    kept = tx.keep_lemmas(F.transform(w, tag), config.POS_KEPT)
    x = q.t(spark, d, "documents").select("doc_id", F.explode(kept).alias("k"))
    return x.groupBy("doc_id", "k.word", "k.pos").agg(F.count(F.lit(1)).alias("n"))


def word_slices(spark: SparkSession, d: str) -> DataFrame:
    """Fixed slices of 100 words, as for a text without sentences."""
    s = q.t(spark, d, "documents").select("doc_id", F.posexplode(tx.word_slices(F.col("text"), 100)).alias("slice_id", "slice"))
    return s.select("doc_id", F.col("slice_id").cast("long").alias("slice_id"), F.md5(F.col("slice").cast("binary")).alias("digest"))


def stance_errors(spark: SparkSession, d: str) -> DataFrame:
    """The zero payload under each error code."""
    docs, poles = q.talk_docs(spark, d), config.poles_frame(spark)
    rows = [stance.error_payload(docs, poles, e) for e in stance.ERRORS]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.drop("pole_ord")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return q.t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def theme_scores(spark: SparkSession, d: str) -> DataFrame:
    """Themes by the metric's own temperature, with the hashing embedder."""
    from polescale.plans import score

    s = score.theme_scores(spark, _items(spark, d), config.DEFAULT_POLES, providers.hashed_embedder())
    return s.select("doc_id", "pole", q.r6("score"))


def scored_texts(spark: SparkSession, d: str) -> DataFrame:
    """The whole of scoring with its defaults, with the hashing embedder and the overlap of words as entailment."""
    from polescale.plans import score

    s = score.score_payload(spark, _items(spark, d), providers.hashed_embedder(), providers.overlap_entailment())
    pole = F.explode("pole_order").alias("pole")
    x = s.select("doc_id", "dominant_pole", "scores", "cosine_scores", "stance_scores", "blend_gamma", F.col("stance.n_chunks").alias("n_chunks"), pole)
    return x.select("doc_id", "pole", "dominant_pole", "blend_gamma", "n_chunks", *[F.round(F.col(c)[F.col("pole")] + q.NUDGE, 6).alias(c[:-1]) for c in ("scores", "cosine_scores", "stance_scores")])


_NAMES = """theme_scores scored_texts corpus_files frontmatter_headers legacy_headers holdout_files axis_corpus_files reference_book direct_text themes_yaml hypotheses_yaml lexicon_files lexicon_parquet
prediction_files graded_with_intervals comparison_files lexicon_with_intervals calibrated_lexicon category_texts compared_files compared_files_lowe report_figures fold_strict axis_registry
devices nonblank_chunks interval_text correctness_vector cosine_pairs content_lemmas word_slices stance_errors"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}


# --- DuckDB -------------------------------------------------------------------


def _list(xs) -> str:
    return "[{}]".format(", ".join(f"'{x}'" for x in xs))


def _fold(x: str) -> str:
    return "CASE {} END".format(" ".join(f"WHEN lower(trim({x})) = '{k}' THEN '{v}'" for k, v in FOLD.items()))


def _show(x: str) -> str:
    return "CASE {} ELSE {} END".format(" ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in LABELS.items()), f"coalesce({x}, '—')")


_TALKS = "talks AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"
_C = f"""{_TALKS}, c0 AS (SELECT conv_id AS id, concat('text_', lpad(conv_id::VARCHAR, 6, '0')) AS slug, ({_list(RAW)})[conv_id % {len(RAW)} + 1] AS raw, ({_list(ROLES)})[conv_id % {len(ROLES)} + 1] AS raw_role, conv_id % 5 <> 2 AS use, conv_id % 4 = 3 AS legacy, {q._strip("text")} AS body FROM talks),
c AS (SELECT id, slug, raw, raw_role, legacy, body, {_fold("raw")} AS expected_pole, CASE WHEN NOT legacy THEN upper(raw_role) END AS role, CASE WHEN NOT legacy THEN use END AS use_for_seeds FROM c0),
held AS (SELECT item_id, concat('item_', lpad(item_id::VARCHAR, 6, '0')) AS slug, CASE WHEN item_id % 3 <> 0 THEN {_fold(f"({_list(RAW)})[item_id % {len(RAW)} + 1]")} END AS expected_pole, {q._strip("text")} AS body FROM benchmark),
book AS (SELECT string_agg(body, chr(10) ORDER BY concat(CASE WHEN item_id % 2 = 0 THEN 'part/' ELSE '' END, slug, (['.txt', '.MD', ''])[item_id % 3 + 1])) AS body FROM held)"""
_KEPT = f"use_for_seeds AND expected_pole IN ('{MINUS}', '{PLUS}')"
_TEXT_C = f"""{_C}, pool AS (SELECT slug, 'seed' AS category, expected_pole AS gold_pole, body FROM c WHERE {_KEPT} UNION ALL SELECT slug, 'inversion', expected_pole, body FROM c WHERE role = 'INVERSION-HOLD'
 UNION ALL SELECT slug, 'holdout', expected_pole, body FROM held UNION ALL SELECT 'book', 'oracle', '{PLUS}', {q._strip("body")} FROM book),
texts AS (SELECT concat(category, chr(1), slug) AS slug, body, gold_pole AS pole, category FROM pool)"""
_CALIBRATED = f"WITH {_TEXT_C}, {q._TOK}, {q._COUNTS}, {q._FREQS}, {q._LBG}, {q._LOWE}"


def _compared_sql(lexicon: str, scoring: str) -> str:
    return f"""{_CALIBRATED}, lowe6 AS (SELECT word, score FROM lowe), {q._scored(lexicon)},
 pred AS (SELECT s.*, p.category, p.gold_pole, p.slug AS name, CASE WHEN n_hits > 0 AND axis_score > 0 THEN '{PLUS}' WHEN n_hits > 0 AND axis_score < 0 THEN '{MINUS}' END AS predicted_pole FROM scored s JOIN pool p ON s.slug = concat(p.category, chr(1), p.slug)),
 final AS (SELECT *, CASE WHEN gold_pole IN ('{MINUS}', '{PLUS}') THEN coalesce(predicted_pole = gold_pole, false) END AS correct FROM pred)"""


_INTERVALS = f"""{q._GRADED}, wide AS (SELECT *, CASE WHEN n_hits >= 20 THEN round(axis_score - 0.4 / sqrt(n_hits), 9) END AS ci_low, CASE WHEN n_hits >= 20 THEN round(axis_score + 0.4 / sqrt(n_hits), 9) END AS ci_high FROM graded),
robust AS (SELECT *, coalesce(CASE WHEN axis_score > 0 THEN ci_low > 0 WHEN axis_score < 0 THEN ci_high < 0 END, false) AS sign_robust FROM wide)"""
_SHARE = "printf('%d/%d (%s)', ok, n, CASE WHEN n > 0 THEN printf('%.1f%%', 100.0 * ok / n) ELSE 'n/a' END)"

def _values(rows: list[tuple]) -> str:
    return ", ".join("({})".format(", ".join(f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x) for x in r)) for r in rows)


def _scoring(tau: float) -> str:
    """``cos`` (cosine scores) and ``st`` (stance) of benchmark items, whose segments are all shorter than a chunk."""
    seeds = [(i, p.key, t) for i, p in enumerate(config.DEFAULT_POLES) for t in p.seeds]
    hypotheses = [(i, side, t) for i, h in enumerate(config.DEFAULT_HYPOTHESES) for side, ts in (("pro", h.pro), ("contra", h.contra)) for t in ts]
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')".format
    return f"""items AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark), {q._segments("items", "item_id")},
 chunks AS (SELECT item_id AS doc_id, seg_id AS chunk_id, array_to_string(parts, ' ') AS t FROM flat WHERE len(parts) > 0),
 seeds(pole_ord, pole, t) AS (VALUES {_values(seeds)}), hyps(pole_ord, side, t) AS (VALUES {_values(hypotheses)}),
 units AS (SELECT 'c' AS kind, doc_id, chunk_id, t FROM chunks UNION ALL SELECT 's', pole_ord, row_number() OVER (), t FROM seeds),
 hashed AS (SELECT kind, doc_id, chunk_id, md5(w) AS m FROM (SELECT kind, doc_id, chunk_id, unnest({words("t")}) AS w FROM units)),
 raw AS (SELECT kind, doc_id, chunk_id, CAST(concat('0x', substr(m, 15, 2)) AS BIGINT) % 64 AS dim, sum(CASE WHEN substr(m, 1, 1) >= '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM hashed GROUP BY ALL),
 unit AS (SELECT kind, doc_id, chunk_id, dim, v / coalesce(nullif(sqrt(sum(v * v) OVER (PARTITION BY kind, doc_id, chunk_id)), 0), 1) AS v FROM raw),
 pole AS (SELECT u.doc_id AS pole_ord, dim, sum(v) / any_value(n) AS v FROM unit u JOIN (SELECT pole_ord, count(*) AS n FROM seeds GROUP BY pole_ord) k ON u.doc_id = k.pole_ord WHERE kind = 's' GROUP BY u.doc_id, dim),
 pnorm AS (SELECT pole_ord, sqrt(sum(v * v)) AS n FROM pole GROUP BY pole_ord), cnorm AS (SELECT doc_id, chunk_id, sqrt(sum(v * v)) AS n FROM unit WHERE kind = 'c' GROUP BY ALL),
 dots AS (SELECT u.doc_id, u.chunk_id, p.pole_ord, sum(u.v * p.v) AS s FROM unit u JOIN pole p ON u.dim = p.dim WHERE kind = 'c' GROUP BY ALL),
 names AS (SELECT DISTINCT pole_ord, pole FROM seeds),
 sims AS (SELECT c.doc_id, c.chunk_id, n.pole_ord, n.pole, coalesce(d.s / nullif(cn.n * pn.n, 0), 0) AS sim FROM chunks c CROSS JOIN names n LEFT JOIN dots d ON c.doc_id = d.doc_id AND c.chunk_id = d.chunk_id AND n.pole_ord = d.pole_ord LEFT JOIN cnorm cn ON c.doc_id = cn.doc_id AND c.chunk_id = cn.chunk_id LEFT JOIN pnorm pn ON n.pole_ord = pn.pole_ord),
 ex AS (SELECT *, exp((sim - max(sim) OVER w) / {tau}) AS e FROM sims WINDOW w AS (PARTITION BY doc_id, chunk_id)),
 prob AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, chunk_id) AS p FROM ex),
 cos AS (SELECT i.item_id AS doc_id, n.pole_ord, n.pole, coalesce(m.p, 0.0) AS score FROM items i CROSS JOIN names n LEFT JOIN (SELECT doc_id, pole_ord, avg(p) AS p FROM prob GROUP BY doc_id, pole_ord) m ON i.item_id = m.doc_id AND n.pole_ord = m.pole_ord),
 hw AS (SELECT pole_ord, side, t, list_distinct({words("t")}) AS ws FROM hyps), cw AS (SELECT doc_id, chunk_id, list_distinct({words("t")}) AS ws FROM chunks WHERE length(trim(t, ' ')) > 0),
 best AS (SELECT doc_id, chunk_id, pole_ord, side, max(len(list_intersect(h.ws, c.ws)) / CAST(len(h.ws) AS DOUBLE)) AS p FROM cw c CROSS JOIN hw h GROUP BY ALL),
 sides AS (SELECT doc_id, pole_ord, side, avg(p) AS m FROM best GROUP BY ALL),
 st AS (SELECT doc_id, pole_ord, coalesce(max(m) FILTER (side = 'pro'), 0) - coalesce(max(m) FILTER (side = 'contra'), 0) AS stance FROM sides GROUP BY ALL),
 counted AS (SELECT doc_id, count(*) AS n_chunks FROM cw GROUP BY doc_id)"""


ORACLE_SQL = {
    "theme_scores": f"WITH {_scoring(config.TAU)} SELECT doc_id, pole, round(score + {q.NUDGE}, 6) AS score FROM cos",
    "scored_texts": f"""WITH {_scoring(config.TAU_SCORE)}, both_ AS (SELECT c.*, s.stance, s.stance IS NULL AS pure, greatest(0.0, c.score + coalesce(s.stance, 0)) AS raw FROM cos c LEFT JOIN st s ON c.doc_id = s.doc_id AND c.pole_ord = s.pole_ord),
 mixed AS (SELECT *, CASE WHEN pure THEN score WHEN sum(raw) OVER w <= 0 THEN 0.25 ELSE raw / sum(raw) OVER w END AS blended FROM both_ WINDOW w AS (PARTITION BY doc_id)),
 top AS (SELECT doc_id, pole AS dominant_pole FROM mixed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY blended DESC, pole_ord) = 1)
 SELECT m.doc_id, pole, dominant_pole, CASE WHEN NOT pure THEN 1.0::DOUBLE END AS blend_gamma, coalesce(n_chunks, 0) AS n_chunks, round(blended + {q.NUDGE}, 6) AS score, CASE WHEN NOT pure THEN round(score + {q.NUDGE}, 6) END AS cosine_score, CASE WHEN NOT pure THEN round(stance + {q.NUDGE}, 6) END AS stance_score
 FROM mixed m JOIN top t ON m.doc_id = t.doc_id LEFT JOIN counted k ON m.doc_id = k.doc_id""",
    "corpus_files": f"WITH {_C} SELECT slug, raw AS attracteur_raw, expected_pole, role, use_for_seeds, legacy, md5(body) AS digest, CAST(length(body) AS BIGINT) AS n_chars FROM c",
    "frontmatter_headers": f"WITH {_C} SELECT slug, concat('Text of ', slug) AS title, raw_role FROM c WHERE NOT legacy",
    "legacy_headers": f"WITH {_C} SELECT slug, slug AS source, 'nobody' AS auteur FROM c WHERE legacy",
    "holdout_files": f"WITH {_C} SELECT slug, expected_pole, 'TEST' AS role, CAST(NULL AS BOOLEAN) AS use_for_seeds, md5(body) AS digest FROM held",
    "axis_corpus_files": f"WITH {_C} SELECT slug, expected_pole FROM c WHERE {_KEPT} UNION ALL SELECT slug, NULL FROM c WHERE role = 'INVERSION-HOLD' AND expected_pole IN ('{MINUS}', '{PLUS}')",
    "reference_book": f"WITH {_C} SELECT 'book' AS slug, md5({q._strip('body')}) AS digest, CAST(length({q._strip('body')}) AS BIGINT) AS n_chars FROM book",
    "direct_text": "SELECT CAST(0 AS BIGINT) AS doc_id, 'Un texte.' AS text UNION ALL SELECT 0, ''",
    "themes_yaml": "SELECT dense_rank() OVER (ORDER BY r_regionkey) - 1 AS pole_ord, r_name AS pole, concat('of ', r_name) AS label, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS seed_ord, n_name AS seed FROM nation JOIN region ON n_regionkey = r_regionkey",
    "hypotheses_yaml": "SELECT dense_rank() OVER (ORDER BY n_regionkey) - 1 AS pole_ord, concat('r', n_regionkey) AS pole, 'pro' AS polarity, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS idx, n_name AS hypothesis FROM nation",
    "lexicon_files": f"{q._BASE} SELECT word, pos, score, freq_minus, freq_plus FROM lbg WHERE score IS NOT NULL",
    "lexicon_parquet": f"{q._BASE} SELECT word, pos, score, freq_minus AS freq_{MINUS}, freq_plus AS freq_{PLUS}, n_docs FROM lbg WHERE score IS NOT NULL",
    "prediction_files": f"SELECT CASE WHEN conv_id % 5 = 0 THEN concat('f', conv_id) ELSE concat('s', conv_id) END AS slug, ({_list(POLES)})[conv_id % 4 + 1] AS predicted_pole FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 <> 0",
    "graded_with_intervals": f"{_INTERVALS} SELECT slug, round(axis_score + {q.NUDGE}, 6) AS axis_score, round(ci_low + {q.NUDGE}, 6) AS ci_low, round(ci_high + {q.NUDGE}, 6) AS ci_high, sign_robust FROM robust",
    "comparison_files": f"""{_INTERVALS} SELECT slug::VARCHAR AS slug, category, coalesce(gold_pole, '') AS gold_pole, coalesce(predicted_pole, '') AS predicted_pole, round(axis_score + {q.NUDGE}, 6) AS axis_score,
 coalesce(CAST(round(ci_low + {q.NUDGE}, 6) AS VARCHAR), '') AS axis_score_ci_low, coalesce(CAST(round(ci_high + {q.NUDGE}, 6) AS VARCHAR), '') AS axis_score_ci_high, CASE WHEN sign_robust THEN 'True' ELSE 'False' END AS sign_robust, n_hits::VARCHAR AS n_lexicon_hits, n_tokens::VARCHAR AS n_tokens, CASE WHEN correct THEN '1' WHEN NOT correct THEN '0' ELSE '' END AS on_axis_correct, 'lbg' AS scoring FROM robust""",
    "lexicon_with_intervals": f"WITH ci AS ({q.ORACLE_SQL['word_ci']}), lex AS ({q._BASE} SELECT word, pos, score, freq_minus, freq_plus, n_docs FROM lbg WHERE score IS NOT NULL) SELECT lex.word, lex.pos, score, freq_minus, freq_plus, n_docs, ci_low, ci_high FROM lex LEFT JOIN ci ON lex.word = ci.word AND lex.pos = ci.pos",
    "calibrated_lexicon": f"{_CALIBRATED} SELECT word, pos, score, freq_minus, freq_plus FROM lbg WHERE score IS NOT NULL",
    "category_texts": f"WITH {_TEXT_C} SELECT slug, category, gold_pole, CAST(length(body) AS BIGINT) AS n_chars FROM pool",
    "report_figures": f"""{_compared_sql("lbg", "lbg")}, per AS (SELECT category, count(*) FILTER (correct) AS ok, count(correct) AS n FROM final GROUP BY category),
 kinds AS (SELECT unnest(['seed', 'holdout', 'inversion', 'oracle']) AS category), said AS (SELECT k.category, coalesce(ok, 0) AS ok, coalesce(n, 0) AS n FROM kinds k LEFT JOIN per p ON k.category = p.category WHERE p.category IS NOT NULL OR k.category IN ('seed', 'holdout'))
 SELECT concat('| ', category, ' | ', {_SHARE}, ' |') AS line FROM said UNION ALL SELECT printf('Misclassified: %d of %d.', count(*) FILTER (NOT correct), count(correct)) FROM final WHERE category = 'inversion'""",
    "fold_strict": f"WITH {_C} SELECT slug, expected_pole AS pole, {_show('expected_pole')} AS shown, upper(raw_role) AS role FROM c",
    "axis_registry": "SELECT * FROM (VALUES {}) v(axis, minus_pole, plus_pole)".format(", ".join(f"('{a}', '{m}', '{p}')" for a, (m, p) in AXES.items())),
    "devices": "SELECT * FROM (VALUES (NULL, 'cpu', 'cpu'), ('', 'cpu', 'cpu'), ('-1', 'cpu', 'cpu'), ('cpu', 'cpu', 'cpu'), ('mps', 'mps', 'mps'), ('cuda:1', 'cpu', 'cuda:1')) v(setting, without, with_cuda) UNION ALL SELECT r_regionkey::VARCHAR, 'cpu', concat('cuda:', r_regionkey) FROM region",
    "nonblank_chunks": "SELECT doc_id, count(*) AS n_chunks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE length(trim(t, ' ')) > 0 GROUP BY doc_id",
    "interval_text": "SELECT vec_id, printf('%.3f [%.3f, %.3f]', round(embedding[1]::DOUBLE, 6) + 1e-9, round(embedding[2]::DOUBLE, 6) + 1e-9, round(embedding[3]::DOUBLE, 6) + 1e-9) AS shown FROM embeddings",
    "correctness_vector": "SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS of_text, CASE WHEN doc_id % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS of_number, CASE WHEN doc_id % 4 <> 0 AND doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS of_flag FROM documents",
    "cosine_pairs": f"SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + {q.NUDGE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "content_lemmas": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\p{L}+|[0-9]+)', 1)) AS x FROM documents),
 k AS (SELECT doc_id, lower(x) AS word, (['NOUN', 'DET', 'VERB', 'ADJ', 'ADP', 'PROPN'])[length(x) % 6 + 1] AS pos FROM w WHERE lower(x) <> 'the' AND NOT regexp_matches(x, '^[0-9]+$'))
 SELECT doc_id, word, pos, count(*) AS n FROM k WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'PROPN') AND length(word) >= 2 GROUP BY doc_id, word, pos""",
    "word_slices": rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{tx.WS}+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(CAST(ceil(len(ws) / 100.0) AS BIGINT))) AS slice_id FROM w)
 SELECT doc_id, slice_id, md5(array_to_string(ws[slice_id * 100 + 1:slice_id * 100 + 100], ' ')) AS digest FROM s""",
    "stance_errors": f"SELECT doc_id, pole, 0.0::DOUBLE AS pro_mean, 0.0::DOUBLE AS contra_mean, 0.0::DOUBLE AS stance, CAST(0 AS BIGINT) AS n_chunks, error FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations UNION ALL SELECT -1), (SELECT unnest({_list(POLES)}) AS pole), (SELECT unnest({_list(stance.ERRORS)}) AS error)",
} | {
    name: f"""{_compared_sql(lexicon, scoring)} SELECT name AS slug, category, coalesce(gold_pole, '') AS gold_pole, coalesce(predicted_pole, '') AS predicted_pole, round(round(axis_score, 6) + 1e-8, 5) AS axis_score, n_hits AS n_lexicon_hits, n_tokens, CASE WHEN correct THEN '1' WHEN NOT correct THEN '0' ELSE '' END AS on_axis_correct, '{scoring}' AS scoring FROM final"""
    for name, lexicon, scoring in (("compared_files", "lbg", "lbg"), ("compared_files_lowe", "lowe6", "lowe"))
}
