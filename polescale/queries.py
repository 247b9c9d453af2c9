"""Registered queries of the text-scaling operators, and their DuckDB SQL.

The driver's tables stand in for a corpus: ``documents`` are the texts,
``labels.quality`` 0 / 1 the minus / plus pole, ``doc_id % 5`` the split
(0 hold-out, 1 inversions, else seeds; unlabelled texts are hold-outs without
a gold pole, and never seeds); of embeddings, labels 0 to 3 are the
poles' seeds and 4 to 9 chunks of pseudo-documents ``vec_id % 20``;
conversations are texts of several paragraphs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.config import CI_PERCENTILES, FOLD, POLES, TAU, TEXT_CI_DRAWS, WORD_CI_DRAWS
from polescale.functions import labels as lb
from polescale.functions import text as tx
from polescale.operators import axis as ax
from polescale.operators import blend, bootstrap, geometry, stance
from polescale.operators import wordscores as ws
from polescale.sources.files import work_table

MINUS, PLUS = "hors_sol", "terrestre"
ACCURACY_DRAWS = 1000
SEED = 42
NUDGE = 1e-12

# Hypotheses (index, polarity, word); p of a chunk is the share of its words that are the hypothesis's word, times 20, at most 1.
HYPOTHESES = [(0, "pro", "the"), (0, "pro", "of"), (0, "contra", "that"), (1, "pro", "and"), (1, "contra", "in"), (2, "pro", "la"), (2, "contra", "de"), (2, "contra", "le"), (3, "pro", "der"), (3, "contra", "und")]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: str):
    """Six digits. Means of rounded scores often end in a 5 at the seventh; the nudge keeps engines from rounding such ties by the last bit of a sum."""
    return F.round(F.col(c) + NUDGE, 6).alias(c)


def texts(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = F.col("doc_id")
    pole = F.when(F.col("quality") == 0, MINUS).when(F.col("quality").isNotNull(), PLUS)
    category = F.when(F.col("quality").isNull() | (s % 5 == 0), "holdout").when(s % 5 == 1, "inversion").otherwise("seed")
    j = j.select(s.alias("slug"), F.col("text").alias("body"), pole.alias("pole"), category.alias("category"))
    gold = F.when(F.col("category") == "seed", F.col("pole")).when(F.col("slug") % 13 == 0, None).when(F.col("slug") % 11 == 0, "local").otherwise(F.col("pole"))
    return j.withColumn("gold_pole", gold)


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).where("category = 'seed'")


def freqs(spark: SparkSession, d: str) -> DataFrame:
    """Written once: lexicons read it for the words and for their totals."""
    return work_table(ws.frequencies(ws.row_counts(seeds(spark, d)), MINUS, PLUS), "freqs")


def lbg(spark: SparkSession, d: str) -> DataFrame:
    return ws.lexicon_rows(ws.wordscores(freqs(spark, d)))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("slug")
    p = F.when(s % 7 == 0, None).when(s % 3 == 0, "local").when(s % 2 == 0, MINUS).otherwise(PLUS)
    return texts(spark, d).select("slug", p.alias("predicted_pole"))


def graded(spark: SparkSession, d: str, ci: DataFrame | None = None) -> DataFrame:
    all_ = texts(spark, d)
    scored = ax.axis_scores(all_, lbg(spark, d)).withColumn("axis_score", F.round("axis_score", 9))
    return ax.graded(scored.join(all_.select("slug", "category", "gold_pole"), "slug"), MINUS, PLUS, ci)


# --- tokens, counts, lexicons -------------------------------------------------


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return ws.token_counts(t(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("body")))


def doc_counts(spark: SparkSession, d: str) -> DataFrame:
    return ws.document_counts(seeds(spark, d))


def pole_totals(spark: SparkSession, d: str) -> DataFrame:
    return ws.pole_totals(seeds(spark, d))


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ws.document_frequency(ws.document_counts(seeds(spark, d)))


def wordscores_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return lbg(spark, d).select("word", "pos", "score", "freq_minus", "freq_plus", "n_docs")


def lowe_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return ws.lowe(freqs(spark, d)).select("word", "pos", r6("score"))


# --- axis scores and grading --------------------------------------------------


def axis_score_lbg(spark: SparkSession, d: str) -> DataFrame:
    return ax.axis_scores(texts(spark, d), lbg(spark, d)).select("slug", r6("axis_score"), "n_hits", "n_tokens")


def axis_score_lowe(spark: SparkSession, d: str) -> DataFrame:
    return ax.axis_scores(texts(spark, d), ws.lowe(freqs(spark, d))).select("slug", r6("axis_score"), "n_hits", "n_tokens")


def graded_texts(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("slug", "category", "gold_pole", "predicted_pole", "on_axis", "correct", r6("axis_score"), "n_hits", "n_tokens")


def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    return ax.accuracy_by_category(graded(spark, d))


def pole_confusion(spark: SparkSession, d: str) -> DataFrame:
    return ax.confusion(graded(spark, d))


def inversion_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ax.inversion_outcomes(graded(spark, d)).withColumn("axis_score", r6("axis_score"))


def inversion_counts(spark: SparkSession, d: str) -> DataFrame:
    return ax.inversion_counts(graded(spark, d))


def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    return ax.head_to_head(graded(spark, d).where("category = 'holdout'"), predictions(spark, d), MINUS, PLUS)


def divergences(spark: SparkSession, d: str) -> DataFrame:
    return ax.divergences(graded(spark, d).where("category = 'holdout'"), predictions(spark, d), MINUS, PLUS)


# --- labels and pools ---------------------------------------------------------

# Raw labels, taken in turn.
VARIANTS = ["local+", " Local-", "LOCAL", "global+", "Global-", "global", "horssol", "Hors-Sol ", "hors_sol", "terrestre", "cross:local/global", ""]
ROLES = ["SEED", " inversion-hold", "Test", "sanity"]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the shape of a read corpus, with raw labels and roles taken in turn."""
    s = F.col("doc_id")
    docs = t(spark, d, "documents").select(s.alias("slug"), F.element_at(F.array(*map(F.lit, VARIANTS)), (s % 12 + 1).cast("int")).alias("raw"), F.element_at(F.array(*map(F.lit, ROLES)), (s % 4 + 1).cast("int")).alias("raw_role"), F.when(s % 8 == 4, None).otherwise(s % 4 == 0).alias("use_for_seeds"))
    return docs.select("slug", "raw", lb.fold_pole_or_none(F.col("raw")).alias("expected_pole"), lb.role(F.col("raw_role")).alias("role"), "use_for_seeds")


def fold_labels(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d)


def seed_pool(spark: SparkSession, d: str) -> DataFrame:
    from polescale.sources.corpus import seed_pool as pool

    return pool(corpus(spark, d)).select("slug", "expected_pole")


def eval_pool(spark: SparkSession, d: str) -> DataFrame:
    from polescale.sources.corpus import eval_pool as pool

    holdout = t(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("slug"), F.lit("").alias("raw"), F.lit(None).cast("string").alias("expected_pole"), F.lit("TEST").alias("role"), F.lit(False).alias("use_for_seeds"))
    return pool(holdout, corpus(spark, d)).select("slug", "expected_pole", "role")


def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    """With every scored text's interval (NumPy's draws, as the published table) and sign robustness."""
    from polescale.sources.tables import comparison_columns

    all_, hits = texts(spark, d), hit_arrays(spark, d)
    scored = ax.hit_scores(all_, hits).withColumn("axis_score", F.round("axis_score", 9))
    rows = ax.graded(scored.join(all_.select("slug", "category", "gold_pole"), "slug"), MINUS, PLUS, bootstrap.array_ci(hits, exact=True))
    return comparison_columns(rows, "lbg")


# --- segments and chunks ------------------------------------------------------


def talks(spark: SparkSession, d: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))  # one conversation
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def _segmented(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, tx.segment(F.col("text")).alias("g")).select(key, "g.strategy", F.posexplode("g.segments").alias("seg_id", "sents"))


def segment_strategy(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", tx.segment(F.col("text")).alias("g"))
    return docs.select("doc_id", "g.strategy", F.size("g.segments").cast("long").alias("n_segments"))


def paragraph_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _segmented(talks(spark, d), "conv_id")
    return s.select("conv_id", "strategy", F.col("seg_id").cast("long").alias("seg_id"), F.array_join("sents", " ").alias("segment"))


def single_newline_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _segmented(t(spark, d, "documents"), "doc_id").where("strategy = 'single_newline'")
    return s.select("doc_id", F.col("seg_id").cast("long").alias("seg_id"), F.array_join("sents", " ").alias("segment"))


def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    s = _segmented(t(spark, d, "documents"), "doc_id").where("strategy in ('sentence_window', 'short')")
    return s.select("doc_id", "strategy", F.col("seg_id").cast("long").alias("seg_id"), F.array_join("sents", " ").alias("segment"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts' sentences packed to chunks of 64 words."""
    c = t(spark, d, "documents").select("doc_id", F.posexplode(tx.pack(tx.sentences(F.col("text")), 64)).alias("chunk_id", "chunk"))
    return c.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk", tx.n_words(F.col("chunk")).cast("long").alias("n_words"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The whole path: segments, then chunks of 256 words in each."""
    return t(spark, d, "documents").select("doc_id", tx.chunks(F.col("text")).alias("c")).select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.aggregate(F.transform("c", tx.n_words), F.lit(0), lambda a, n: a + n).cast("long").alias("n_words"))


# --- geometry, stance, blending -----------------------------------------------


def poles(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").where("label < 4")
    return geometry.pole_vectors(e.select(F.col("label").cast("int").alias("pole_ord"), F.element_at(F.array(*map(F.lit, POLES)), (F.col("label") + 1).cast("int")).alias("pole"), "embedding"))


def vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").where("label >= 4").select((F.col("vec_id") % 20).alias("doc_id"), F.col("vec_id").alias("chunk_id"), "embedding")


def vector_docs(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo-documents 0 to 20; the last has no chunk."""
    return spark.range(21).withColumnRenamed("id", "doc_id")


def cos_scores(spark: SparkSession, d: str, tau: float = TAU) -> DataFrame:
    return geometry.pole_scores(vector_docs(spark, d), vector_chunks(spark, d), poles(spark, d), tau)


def pole_vectors(spark: SparkSession, d: str) -> DataFrame:
    p = poles(spark, d).select("pole_ord", "pole", F.posexplode("vec").alias("dim", "value"))
    return p.select(F.col("pole_ord").cast("long").alias("pole_ord"), "pole", F.col("dim").cast("long").alias("dim"), r6("value"))


def cosine_matrix(spark: SparkSession, d: str) -> DataFrame:
    return geometry.similarity_matrix(vector_chunks(spark, d), poles(spark, d)).select("doc_id", "chunk_id", "pole", r6("sim"))


def chunk_softmax(spark: SparkSession, d: str) -> DataFrame:
    return geometry.chunk_softmax(vector_chunks(spark, d), poles(spark, d)).select("doc_id", "chunk_id", "pole", r6("prob"))


def semaxis_scores(spark: SparkSession, d: str) -> DataFrame:
    return cos_scores(spark, d).select("doc_id", "pole", r6("score"))


def dominant_pole(spark: SparkSession, d: str) -> DataFrame:
    return geometry.dominant(cos_scores(spark, d))


def hypotheses(spark: SparkSession) -> DataFrame:
    rows, seen = [], {}
    for o, side, w in HYPOTHESES:
        rows.append((o, POLES[o], side, seen.setdefault((o, side), 0), w))
        seen[o, side] += 1
    return spark.createDataFrame(rows, "pole_ord int, pole string, polarity string, idx int, hypothesis string")


def stance_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation is a chunk."""
    return t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), "text")


def talk_docs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations, and a text -1 without any turn."""
    return t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().union(spark.range(-1, 0))


def entailments(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic stand-in for a model; every eleventh turn fails, and an answer lacks hypotheses it gives 0."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(tx.TOKEN), F.lit(1))
    c = stance_chunks(spark, d).select("doc_id", "chunk_id", words.alias("w"))
    x = c.join(F.broadcast(hypotheses(spark).select("hypothesis")))  # ten hypotheses
    share = F.coalesce(F.try_divide(F.size(F.filter("w", lambda w: w == F.col("hypothesis"))) * 20.0, F.size("w")), F.lit(0.0))
    fails = (F.col("doc_id") + F.col("chunk_id")) % 11 == 0
    return x.select("doc_id", "chunk_id", "hypothesis", F.when(fails, None).otherwise(F.least(F.lit(1.0), share)).alias("p")).where("p is null or p > 0")


def _stance(spark: SparkSession, d: str) -> DataFrame:
    return stance.stance(talk_docs(spark, d), stance_chunks(spark, d), entailments(spark, d), hypotheses(spark))


def stance_scores(spark: SparkSession, d: str) -> DataFrame:
    return _stance(spark, d).select("doc_id", "pole", r6("pro_mean"), r6("contra_mean"), r6("stance"), "n_chunks", "error")


def stance_details(spark: SparkSession, d: str) -> DataFrame:
    s = stance.stance_details(stance_chunks(spark, d), entailments(spark, d), hypotheses(spark))
    return s.select("doc_id", "pole", "polarity", F.col("idx").cast("long").alias("idx"), "hypothesis", r6("mean_p"))


def _blended(spark: SparkSession, d: str, gamma: float | None, alpha: float | None) -> DataFrame:
    return blend.blend(cos_scores(spark, d), _stance(spark, d), gamma, alpha)


def blend_gamma(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d, 1.0, None).select("doc_id", "pole", r6("score"), r6("cosine_score"), r6("stance_score"))


def blend_alpha(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d, None, 0.4).select("doc_id", "pole", r6("score"), r6("cosine_score"), r6("stance_score"))


def score_block(spark: SparkSession, d: str) -> DataFrame:
    b = blend.score_block(_blended(spark, d, 1.0, None))
    return b.select("doc_id", "dominant_pole", *[F.round(F.col("scores")[p] + NUDGE, 6).alias(p) for p in POLES])


# --- intervals ----------------------------------------------------------------


def accuracy_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = graded(spark, d).where("category = 'holdout' and correct is not null")
    return bootstrap.accuracy_ci(spark, rows, draws=ACCURACY_DRAWS, seed=SEED).select(r6("point"), r6("mean"), r6("ci_lo"), r6("ci_hi"), "n", "n_iter", "seed")


def paired_diff_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = graded(spark, d).where("category = 'holdout' and correct is not null")
    rows = ax.with_predictions(rows, predictions(spark, d)).withColumn("other", F.coalesce(F.col("other_pole") == F.col("gold_pole"), F.lit(False)))
    return bootstrap.paired_diff_ci(spark, rows, "correct", "other", draws=ACCURACY_DRAWS, seed=SEED).select(r6("point_a"), r6("point_b"), r6("diff"), r6("mean"), r6("ci_lo"), r6("ci_hi"), "n", "n_iter", "seed", "inconclusive")


def hit_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Written once: scores and intervals of the texts read it."""
    return work_table(ax.text_hits(texts(spark, d), lbg(spark, d)), "hits")


def text_ci(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap.array_ci(hit_arrays(spark, d), TEXT_CI_DRAWS, SEED).select("slug", r6("ci_low"), r6("ci_high"))


def text_ci_numpy(spark: SparkSession, d: str) -> DataFrame:
    """NumPy's draws: not for SQL; tests compare them with NumPy itself."""
    return bootstrap.array_ci(hit_arrays(spark, d), exact=True)


def word_ci(spark: SparkSession, d: str) -> DataFrame:
    counts = work_table(ws.row_counts(seeds(spark, d)), "counts")
    draws = bootstrap.hashed_blocks(spark, seeds(spark, d), WORD_CI_DRAWS, 12345)
    return bootstrap.word_ci(counts, draws, MINUS, PLUS).select("word", "pos", r6("ci_low"), r6("ci_high"))


def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all texts as a stream's batches would have them, with the whole lexicon."""
    from polescale.streaming import joined_scores

    return joined_scores(texts(spark, d).select("slug", "body"), lbg(spark, d)).select("slug", r6("axis_score"), "n_hits", "n_tokens")


_NAMES = """token_counts doc_counts pole_totals doc_frequency wordscores_lexicon lowe_lexicon axis_score_lbg axis_score_lowe graded_texts accuracy_by_category
pole_confusion inversion_outcomes inversion_counts head_to_head divergences fold_labels seed_pool eval_pool comparison_table segment_strategy paragraph_segments
single_newline_segments sentence_windows chunk_pack document_chunks pole_vectors cosine_matrix chunk_softmax semaxis_scores dominant_pole stance_scores stance_details
blend_gamma blend_alpha score_block accuracy_ci paired_diff_ci text_ci text_ci_numpy word_ci stream_scores"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}


# --- DuckDB -------------------------------------------------------------------

_TEXTS = f"""texts AS (SELECT slug, body, pole, category, CASE WHEN category = 'seed' THEN pole WHEN slug % 13 = 0 THEN NULL WHEN slug % 11 = 0 THEN 'local' ELSE pole END AS gold_pole
 FROM (SELECT d.doc_id AS slug, d.text AS body, CASE WHEN l.quality = 0 THEN '{MINUS}' WHEN l.quality IS NOT NULL THEN '{PLUS}' END AS pole,
 CASE WHEN l.quality IS NULL OR d.doc_id % 5 = 0 THEN 'holdout' WHEN d.doc_id % 5 = 1 THEN 'inversion' ELSE 'seed' END AS category FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""
_TOK = r"""lists AS (SELECT slug, pole, category, regexp_extract_all(lower(coalesce(body, '')), '(\p{L}{2,})', 1) AS ws FROM texts),
tok AS (SELECT slug, pole, category, unnest(ws) AS word, unnest(range(len(ws))) AS tok_id FROM lists)"""
_COUNTS = "counts AS (SELECT slug, pole, word, 'X' AS pos, count(*) AS n FROM tok WHERE category = 'seed' GROUP BY slug, pole, word)"
_FREQS = f"""freqs AS (SELECT word, pos, CAST(sum(CASE WHEN pole = '{MINUS}' THEN n ELSE 0 END) AS BIGINT) AS freq_minus, CAST(sum(CASE WHEN pole = '{PLUS}' THEN n ELSE 0 END) AS BIGINT) AS freq_plus, count(*) AS n_docs FROM counts GROUP BY word, pos),
totals AS (SELECT sum(freq_minus) AS am, sum(freq_plus) AS ap, count(*) AS v FROM freqs)"""
_RATE = "(coalesce({p} / nullif(CAST({ap} AS DOUBLE), 0), 0) - coalesce({m} / nullif(CAST({am} AS DOUBLE), 0), 0)) / nullif(coalesce({p} / nullif(CAST({ap} AS DOUBLE), 0), 0) + coalesce({m} / nullif(CAST({am} AS DOUBLE), 0), 0), 0)"
_LBG = f"lbg AS (SELECT word, pos, round({_RATE.format(p='freq_plus', m='freq_minus', ap='ap', am='am')}, 6) AS score, freq_minus, freq_plus, n_docs FROM freqs, totals)"
_LOWE = "lowe AS (SELECT word, pos, ln((freq_plus + 0.5) / (ap + 0.5 * v)) - ln((freq_minus + 0.5) / (am + 0.5 * v)) AS score FROM freqs, totals)"
_BASE = f"WITH {_TEXTS}, {_TOK}, {_COUNTS}, {_FREQS}, {_LBG}, {_LOWE}"


def _scored(lexicon: str) -> str:
    return f"""scored AS (SELECT l.slug, coalesce(a.s, 0.0) AS axis_score, coalesce(a.h, 0) AS n_hits, CAST(len(l.ws) AS BIGINT) AS n_tokens FROM lists l LEFT JOIN
 (SELECT t.slug, sum(x.score) / count(*) AS s, count(*) AS h FROM tok t JOIN {lexicon} x ON t.word = x.word GROUP BY t.slug) a ON l.slug = a.slug)"""


_GRADED = f"""{_BASE}, {_scored("lbg")},
pred AS (SELECT s.slug, t.category, t.gold_pole, round(s.axis_score, 9) AS axis_score, s.n_hits, s.n_tokens, CASE WHEN n_hits > 0 AND round(axis_score, 9) > 0 THEN '{PLUS}' WHEN n_hits > 0 AND round(axis_score, 9) < 0 THEN '{MINUS}' END AS predicted_pole FROM scored s JOIN texts t ON s.slug = t.slug),
graded AS (SELECT *, coalesce(gold_pole IN ('{MINUS}', '{PLUS}'), false) AS on_axis, CASE WHEN gold_pole IN ('{MINUS}', '{PLUS}') THEN coalesce(predicted_pole = gold_pole, false) END AS correct FROM pred),
other AS (SELECT slug, CASE WHEN slug % 7 = 0 THEN NULL WHEN slug % 3 = 0 THEN 'local' WHEN slug % 2 = 0 THEN '{MINUS}' ELSE '{PLUS}' END AS other_pole FROM texts),
hold AS (SELECT g.*, o.other_pole, coalesce(predicted_pole = gold_pole, false) AS mine, coalesce(other_pole = gold_pole, false) AS theirs FROM graded g LEFT JOIN other o ON g.slug = o.slug WHERE category = 'holdout')"""

_Q = "[{}]".format(", ".join(f"'{x}'" for x in VARIANTS))
_FOLDED = "CASE {} END".format(" ".join(f"WHEN lower(trim(raw)) = '{k}' THEN '{v}'" for k, v in FOLD.items()))
_CORPUS = f"""WITH rows_ AS (SELECT doc_id AS slug, ({_Q})[doc_id % 12 + 1] AS raw, upper(trim((['SEED', ' inversion-hold', 'Test', 'sanity'])[doc_id % 4 + 1])) AS role, CASE WHEN doc_id % 8 = 4 THEN NULL ELSE doc_id % 4 = 0 END AS use_for_seeds FROM documents),
corpus AS (SELECT slug, raw, {_FOLDED} AS expected_pole, role, use_for_seeds FROM rows_)"""

_W = tx.WS


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _parts(x: str, sep: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '{sep}'), lambda p: {_strip('p')}), lambda p: p <> '')"


def _sents(x: str) -> str:
    marked = f"regexp_replace({x}, '{tx.SENTENCE_END}', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {_strip('p')}), lambda p: p <> '')"


def _segments(table: str, key: str) -> str:
    return f"""cut AS (SELECT {key}, text, {_parts("text", chr(92) + "n" + _W + "*" + chr(92) + "n")} AS paras, {_parts("text", chr(92) + "n")} AS lines, {_sents("text")} AS sents FROM {table}),
seg AS (SELECT {key}, CASE WHEN len(paras) >= 3 THEN 'paragraphs' WHEN length(text) > 1500 AND len(lines) >= 3 THEN 'single_newline' WHEN len(sents) <= 3 THEN 'short' ELSE 'sentence_window' END AS strategy,
 CASE WHEN len(paras) >= 3 THEN list_transform(paras, lambda q: {_sents("q")}) WHEN length(text) > 1500 AND len(lines) >= 3 THEN list_transform(lines, lambda q: {_sents("q")}) WHEN len(sents) <= 3 THEN [sents]
 ELSE list_transform(range(1, len(sents) - 1), lambda i: sents[i:i + 2]) END AS segments FROM cut),
flat AS (SELECT {key}, strategy, unnest(range(len(segments))) AS seg_id, unnest(segments) AS parts FROM seg)"""


_GEOMETRY = f"""WITH names AS (SELECT unnest({list(POLES)}) AS pole, unnest(range(4)) AS pole_ord),
long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
poles AS (SELECT n.pole_ord, n.pole, l.dim, avg(l.v) AS value FROM long l JOIN names n ON l.label = n.pole_ord GROUP BY n.pole_ord, n.pole, l.dim),
pn AS (SELECT pole_ord, sqrt(sum(value * value)) AS n FROM poles GROUP BY pole_ord),
cn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM long WHERE label >= 4 GROUP BY vec_id),
dots AS (SELECT l.vec_id, p.pole_ord, p.pole, sum(l.v * p.value) AS s FROM long l JOIN poles p ON l.dim = p.dim WHERE l.label >= 4 GROUP BY l.vec_id, p.pole_ord, p.pole),
sims AS (SELECT d.vec_id % 20 AS doc_id, d.vec_id AS chunk_id, d.pole_ord, d.pole, d.s / (CASE WHEN cn.n = 0 THEN 1 ELSE cn.n END * CASE WHEN pn.n = 0 THEN 1 ELSE pn.n END) AS sim FROM dots d JOIN cn ON d.vec_id = cn.vec_id JOIN pn ON d.pole_ord = pn.pole_ord),
ex AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY chunk_id)) / 0.05) AS e FROM sims),
prob AS (SELECT doc_id, chunk_id, pole_ord, pole, e / sum(e) OVER (PARTITION BY chunk_id) AS prob FROM ex),
cos AS (SELECT d.doc_id, n.pole_ord, n.pole, coalesce(m.p, 0.0) AS score FROM (SELECT unnest(range(21)) AS doc_id) d CROSS JOIN names n LEFT JOIN (SELECT doc_id, pole_ord, avg(prob) AS p FROM prob GROUP BY doc_id, pole_ord) m ON d.doc_id = m.doc_id AND n.pole_ord = m.pole_ord)"""

_HYP = "hyp AS (SELECT * FROM (VALUES {}) h(pole_ord, pole, polarity, idx, hypothesis))"
_seen: dict = {}
_rows = []
for _o, _s, _w in HYPOTHESES:
    _rows.append(f"({_o}, '{POLES[_o]}', '{_s}', {_seen.setdefault((_o, _s), 0)}, '{_w}')")
    _seen[_o, _s] += 1
_HYP = _HYP.format(", ".join(_rows))
_STANCE = rf"""{_HYP},
turns AS (SELECT conv_id AS doc_id, turn AS chunk_id, regexp_extract_all(lower(text), '(\p{{L}}{{2,}})', 1) AS ws FROM conversations),
good AS (SELECT * FROM turns WHERE (doc_id + chunk_id) % 11 <> 0),
ent AS (SELECT g.doc_id, g.chunk_id, h.pole_ord, h.pole, h.polarity, h.idx, h.hypothesis, least(1.0, coalesce(len(list_filter(g.ws, lambda w: w = h.hypothesis)) * 20.0 / nullif(len(g.ws), 0), 0.0)) AS p FROM good g CROSS JOIN hyp h),
answered AS (SELECT doc_id, chunk_id FROM ent GROUP BY doc_id, chunk_id HAVING max(p) > 0),
best AS (SELECT e.doc_id, e.chunk_id, pole_ord, pole, polarity, max(p) AS p FROM ent e JOIN answered a ON e.doc_id = a.doc_id AND e.chunk_id = a.chunk_id GROUP BY ALL),
side AS (SELECT doc_id, pole_ord, pole, polarity, avg(p) AS m FROM best GROUP BY doc_id, pole_ord, pole, polarity),
both_ AS (SELECT doc_id, pole_ord, max(CASE WHEN polarity = 'pro' THEN m END) AS a, max(CASE WHEN polarity = 'contra' THEN m END) AS b FROM side GROUP BY doc_id, pole_ord),
stance AS (SELECT d.doc_id, h.pole_ord, h.pole, coalesce(b.a, 0.0) AS pro_mean, coalesce(b.b, 0.0) AS contra_mean, greatest(-1.0, least(1.0, coalesce(b.a, 0.0) - coalesce(b.b, 0.0))) AS stance, coalesce(c.n, 0) AS n_chunks, CASE WHEN c.n IS NULL THEN 'empty_text' END AS error
 FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations UNION ALL SELECT -1) d CROSS JOIN (SELECT DISTINCT pole_ord, pole FROM hyp) h LEFT JOIN both_ b ON d.doc_id = b.doc_id AND h.pole_ord = b.pole_ord LEFT JOIN (SELECT doc_id, count(*) AS n FROM turns GROUP BY doc_id) c ON d.doc_id = c.doc_id)"""
_BLEND = f"""{_GEOMETRY}, {_STANCE},
joined AS (SELECT c.doc_id, c.pole_ord, c.pole, c.score, s.stance AS st, count(s.stance) OVER w = 0 OR count(s.error) OVER w > 0 AS pure, greatest(0.0, c.score + coalesce(s.stance, 0.0)) AS raw FROM cos c LEFT JOIN stance s ON c.doc_id = s.doc_id AND c.pole = s.pole WINDOW w AS (PARTITION BY c.doc_id)),
gam AS (SELECT doc_id, pole_ord, pole, CASE WHEN pure THEN score WHEN sum(raw) OVER w <= 0 THEN 1.0 / count(*) OVER w ELSE raw / nullif(sum(raw) OVER w, 0) END AS score, CASE WHEN NOT pure THEN score END AS cosine_score, CASE WHEN NOT pure THEN coalesce(st, 0.0) END AS stance_score FROM joined WINDOW w AS (PARTITION BY doc_id))"""


def _draw(b: str, slot: str, seed: int, n: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat_ws('-', CAST({b} AS VARCHAR), CAST({slot} AS VARCHAR), '{seed}')), 1, 8)) AS BIGINT) % {n})"


_LO, _HI = (p / 100 for p in CI_PERCENTILES)


def _boot(value: str) -> str:
    return f"""{_GRADED}, v AS (SELECT row_number() OVER (ORDER BY slug) - 1 AS i, {value} AS v FROM hold WHERE correct IS NOT NULL), size AS (SELECT count(*) AS n FROM v),
drawn AS (SELECT b, {_draw("b", "slot", SEED, "n")} AS i FROM size, (SELECT unnest(range({ACCURACY_DRAWS})) AS b), LATERAL (SELECT unnest(range(n)) AS slot)),
means AS (SELECT b, avg(v.v) AS a FROM drawn JOIN v ON drawn.i = v.i GROUP BY b),
got AS (SELECT (SELECT round(avg(v), 6) FROM v) AS point, round(avg(a), 6) AS mean, round(quantile_cont(a, {_LO}), 6) AS ci_lo, round(quantile_cont(a, {_HI}), 6) AS ci_hi FROM means)"""


ORACLE_SQL = {
    "token_counts": r"SELECT doc_id AS slug, CAST(len(regexp_extract_all(lower(text), '(\p{L}{2,})', 1)) AS BIGINT) AS n_tokens FROM documents",
    "doc_counts": f"{_BASE} SELECT slug, pole, word, pos, n FROM counts",
    "pole_totals": f"{_BASE} SELECT pole, count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_tokens FROM lists WHERE category = 'seed' GROUP BY pole",
    "doc_frequency": f"{_BASE} SELECT word, pos, count(DISTINCT slug) AS n_docs FROM counts GROUP BY word, pos",
    "wordscores_lexicon": f"{_BASE} SELECT word, pos, score, freq_minus, freq_plus, n_docs FROM lbg WHERE score IS NOT NULL",
    "lowe_lexicon": f"{_BASE} SELECT word, pos, round(score, 6) AS score FROM lowe",
    "axis_score_lbg": f"{_BASE}, {_scored('lbg')} SELECT slug, round(axis_score, 6) AS axis_score, n_hits, n_tokens FROM scored",
    "axis_score_lowe": f"{_BASE}, {_scored('lowe')} SELECT slug, round(axis_score, 6) AS axis_score, n_hits, n_tokens FROM scored",
    "graded_texts": f"{_GRADED} SELECT slug, category, gold_pole, predicted_pole, on_axis, correct, round(axis_score, 6) AS axis_score, n_hits, n_tokens FROM graded",
    "accuracy_by_category": f"{_GRADED} SELECT category, count(*) FILTER (correct) AS n_correct, count(correct) AS n_graded FROM graded GROUP BY category",
    "pole_confusion": f"{_GRADED} SELECT gold_pole, count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (predicted_pole IS NULL) AS n_undecided FROM graded WHERE category = 'seed' AND on_axis GROUP BY gold_pole",
    "inversion_outcomes": f"{_GRADED} SELECT slug, gold_pole, predicted_pole, round(axis_score, 6) AS axis_score, n_hits, CASE WHEN correct IS NULL THEN 'off_axis' WHEN correct THEN 'correct' ELSE 'misclassified' END AS outcome FROM graded WHERE category = 'inversion'",
    "inversion_counts": f"{_GRADED} SELECT count(*) FILTER (NOT correct) AS n_misclassified, count(correct) AS n_gradable FROM graded WHERE category = 'inversion'",
    "head_to_head": f"{_GRADED} SELECT count(*) FILTER (on_axis AND mine) AS ws_ok, count(*) FILTER (on_axis) AS ws_tot, count(*) FILTER (theirs) AS lat_ok, count(*) FILTER (gold_pole IS NOT NULL AND other_pole IS NOT NULL) AS lat_tot, count(*) FILTER (on_axis AND other_pole IS NOT NULL AND mine <> theirs) AS n_div FROM hold",
    "divergences": f"{_GRADED} SELECT slug, gold_pole, predicted_pole, other_pole FROM hold WHERE on_axis AND other_pole IS NOT NULL AND mine <> theirs",
    "fold_labels": f"{_CORPUS} SELECT * FROM corpus",
    "seed_pool": f"{_CORPUS} SELECT slug, expected_pole FROM corpus WHERE use_for_seeds",
    "eval_pool": f"{_CORPUS} SELECT slug, expected_pole, role FROM corpus WHERE role = 'INVERSION-HOLD' UNION ALL SELECT -item_id - 1, NULL, 'TEST' FROM benchmark",
    "segment_strategy": f"WITH {_segments('documents', 'doc_id')} SELECT doc_id, strategy, CAST(len(segments) AS BIGINT) AS n_segments FROM seg",
    "paragraph_segments": f"WITH talks AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id), {_segments('talks', 'conv_id')} SELECT conv_id, strategy, seg_id, array_to_string(parts, ' ') AS segment FROM flat",
    "single_newline_segments": f"WITH {_segments('documents', 'doc_id')} SELECT doc_id, seg_id, array_to_string(parts, ' ') AS segment FROM flat WHERE strategy = 'single_newline'",
    "sentence_windows": f"WITH {_segments('documents', 'doc_id')} SELECT doc_id, strategy, seg_id, array_to_string(parts, ' ') AS segment FROM flat WHERE strategy IN ('sentence_window', 'short')",
    "chunk_pack": f"""WITH s AS (SELECT doc_id, list_transform({_sents("text")}, lambda x: {{'done': CAST([] AS VARCHAR[]), 'buf': x, 'n': len(list_filter(string_split_regex(x, '{_W}+'), lambda w: w <> ''))}}) AS parts FROM documents),
 f AS (SELECT doc_id, list_reduce(parts, lambda a, x: CASE WHEN a.n + x.n > 64 THEN {{'done': list_append(a.done, a.buf), 'buf': x.buf, 'n': x.n}} ELSE {{'done': a.done, 'buf': a.buf || ' ' || x.buf, 'n': a.n + x.n}} END) AS r FROM s WHERE len(parts) > 0),
 c AS (SELECT doc_id, list_append(r.done, r.buf) AS cs FROM f)
 SELECT doc_id, unnest(range(len(cs))) AS chunk_id, unnest(cs) AS chunk, CAST(len(list_filter(string_split_regex(unnest(cs), '{_W}+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM c""",
    "document_chunks": f"""WITH {_segments('documents', 'doc_id')}, s AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: len(list_filter(string_split_regex(x, '{_W}+'), lambda w: w <> ''))), lambda n: n > 0) AS ns FROM flat),
 k AS (SELECT doc_id, list_sum(ns) AS words, list_reduce(list_transform(ns, lambda n: {{'c': 1, 'n': n}}), lambda a, x: CASE WHEN a.n + x.n > 256 THEN {{'c': a.c + 1, 'n': x.n}} ELSE {{'c': a.c, 'n': a.n + x.n}} END).c AS chunks FROM s WHERE len(ns) > 0)
 SELECT d.doc_id, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS n_chunks, CAST(coalesce(sum(words), 0) AS BIGINT) AS n_words FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id""",
    "pole_vectors": f"{_GEOMETRY} SELECT pole_ord, pole, dim, round(value, 6) AS value FROM poles",
    "cosine_matrix": f"{_GEOMETRY} SELECT doc_id, chunk_id, pole, round(sim, 6) AS sim FROM sims",
    "chunk_softmax": f"{_GEOMETRY} SELECT doc_id, chunk_id, pole, round(prob, 6) AS prob FROM prob",
    "semaxis_scores": f"{_GEOMETRY} SELECT doc_id, pole, round(score, 6) AS score FROM cos",
    "dominant_pole": f"{_GEOMETRY} SELECT doc_id, pole AS dominant_pole FROM cos QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pole_ord) = 1",
    "stance_scores": f"WITH {_STANCE} SELECT doc_id, pole, round(pro_mean, 6) AS pro_mean, round(contra_mean, 6) AS contra_mean, round(stance, 6) AS stance, n_chunks, error FROM stance",
    "stance_details": f"WITH {_STANCE} SELECT e.doc_id, e.pole, e.polarity, CAST(e.idx AS BIGINT) AS idx, e.hypothesis, round(avg(p), 6) AS mean_p FROM ent e JOIN answered a ON e.doc_id = a.doc_id AND e.chunk_id = a.chunk_id GROUP BY e.doc_id, e.pole, e.polarity, e.idx, e.hypothesis",
    "blend_gamma": f"{_BLEND} SELECT doc_id, pole, round(score, 6) AS score, round(cosine_score, 6) AS cosine_score, round(stance_score, 6) AS stance_score FROM gam",
    "blend_alpha": f"{_BLEND} SELECT doc_id, pole, round(CASE WHEN pure THEN score ELSE 0.4 * score + 0.6 * (coalesce(st, 0.0) + 1.0) / 2.0 END, 6) AS score, round(CASE WHEN NOT pure THEN score END, 6) AS cosine_score, round(CASE WHEN NOT pure THEN coalesce(st, 0.0) END, 6) AS stance_score FROM joined",
    "score_block": f"{_BLEND} SELECT doc_id, arg_max(pole, struct_pack(s := score, o := -pole_ord)) AS dominant_pole, {', '.join(f"round(max(CASE WHEN pole = '{p}' THEN score END), 6) AS {p}" for p in POLES)} FROM gam GROUP BY doc_id",
    "accuracy_ci": f"{_boot('CAST(correct AS DOUBLE)')} SELECT point, mean, ci_lo, ci_hi, n, CAST({ACCURACY_DRAWS} AS BIGINT) AS n_iter, CAST({SEED} AS BIGINT) AS seed FROM got, size",
    "paired_diff_ci": f"{_boot('CAST(correct AS DOUBLE) - CAST(theirs AS DOUBLE)')} SELECT (SELECT round(avg(CAST(correct AS DOUBLE)), 6) FROM hold WHERE correct IS NOT NULL) AS point_a, (SELECT round(avg(CAST(theirs AS DOUBLE)), 6) FROM hold WHERE correct IS NOT NULL) AS point_b, point AS diff, mean, ci_lo, ci_hi, n, CAST({ACCURACY_DRAWS} AS BIGINT) AS n_iter, CAST({SEED} AS BIGINT) AS seed, ci_lo <= 0 AND ci_hi >= 0 AS inconclusive FROM got, size",
    "word_ci": f"""{_BASE}, placed AS (SELECT slug, pole, row_number() OVER (PARTITION BY pole ORDER BY slug) - 1 AS i, count(*) OVER (PARTITION BY pole) AS n FROM texts WHERE category = 'seed'),
 drawn AS (SELECT b, pole, {_draw("concat(pole, '/', b)", "i", 12345, "n")} AS i FROM placed, (SELECT unnest(range({WORD_CI_DRAWS})) AS b)),
 times AS (SELECT d.b, d.pole, p.slug, count(*) AS k FROM drawn d JOIN placed p ON d.pole = p.pole AND d.i = p.i GROUP BY d.b, d.pole, p.slug),
 tot AS (SELECT b, sum(CASE WHEN t.pole = '{MINUS}' THEN k * len(ws) ELSE 0 END) AS am, sum(CASE WHEN t.pole = '{PLUS}' THEN k * len(ws) ELSE 0 END) AS ap FROM times t JOIN lists l ON t.slug = l.slug GROUP BY b),
 per AS (SELECT t.b, c.word, c.pos, sum(CASE WHEN c.pole = '{MINUS}' THEN k * n ELSE 0 END) AS m, sum(CASE WHEN c.pole = '{PLUS}' THEN k * n ELSE 0 END) AS p FROM counts c JOIN times t ON c.slug = t.slug WHERE c.word IN (SELECT word FROM freqs WHERE n_docs >= 3) GROUP BY t.b, c.word, c.pos),
 s AS (SELECT word, pos, {_RATE.format(p="p", m="m", ap="ap", am="am")} AS s FROM per JOIN tot ON per.b = tot.b)
 SELECT word, pos, round(quantile_cont(s, {_LO}), 6) AS ci_low, round(quantile_cont(s, {_HI}), 6) AS ci_high FROM s WHERE s IS NOT NULL GROUP BY word, pos""",
    "stream_scores": f"{_BASE}, {_scored('lbg')} SELECT slug, round(axis_score, 6) AS axis_score, n_hits, n_tokens FROM scored",
}

_ROUND = re.compile(r"round\(((?:quantile_cont|avg|max)\((?:[^()]|\([^()]*\))*\)|[\w.]+), 6\)")
ORACLE_SQL = {k: _ROUND.sub(rf"round(\1 + {NUDGE}, 6)", v) for k, v in ORACLE_SQL.items()}
