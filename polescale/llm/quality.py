"""Quality rules of documents and of their hosts, in DataFrame functions only.

Rules of a document (words are runs of characters that are no white space):
too few words, or too many words in 8-word windows that occur twice or more.
Other measures are returned for further rules.

Host rule: a document's host is its ``source``. Failures are counted for
each host. A beta prior, fitted to the hosts' rates by moments, shrinks the
rates: a host's posterior is Beta(a + failed, b + passed). The prior is the
hosts' own, so a host of two documents is not rejected for one failure. A host
is rejected, with all its documents, if its rate is above the limit with
probability ``LEVEL`` (95 %): if the posterior's mean less ``SIGMAS`` standard
deviations (the normal quantile of LEVEL) is above it. The limit is
``HOST_TIMES`` times the mean rate of all documents, but ``HOST_LEAST`` at
least, as clean documents of a host must not go for a rate that is only
relatively high, and ``HOST_MOST`` at most. Moments are clamped: the variance between hosts to at least
``LEAST_VARIANCE``, the prior's strength a + b to 2 .. ``MOST_STRENGTH``.

Hosts are counted with partial aggregation and joined back by an ordinary
join (adaptive execution splits a hot host), and the measures, a few numbers
a document, are written once so that both use them.

Defined results: null or empty text has no words (and fails); very long texts
are measured whole; null source is a host like any other; repeated rows, and
rows with null or repeated ids, count as often as they stand; a host just at
the limit is kept; an empty table gives an empty result; extra columns, with
whatever names, are not read.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polescale.llm.common import BLANKS, WHITE, Workspace, documents_of

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
HOST_TIMES, HOST_LEAST, HOST_MOST = 3.0, 0.2, 0.5
LEVEL = 0.95
#: Normal quantile of LEVEL.
SIGMAS = NormalDist().inv_cdf(LEVEL)
LEAST_VARIANCE, MOST_STRENGTH = 1e-6, 1e4


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(hashes: Column) -> Column:
    """Words covered by windows found twice or more, from the words' hashes."""

    def of(h: Column) -> Column:
        n = F.size(h)
        windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

        def covered(w: Column) -> Column:
            pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

            def twice(p: Column) -> Column:
                near = lambda k: F.get(p, k).getField("x")
                kept = F.filter(p, lambda v, k: F.coalesce(near(k - 1) == v["x"], F.lit(False)) | F.coalesce(near(k + 1) == v["x"], F.lit(False)))
                return F.sort_array(F.transform(kept, lambda v: v["i"]))

            def length(at: Column) -> Column:
                ends = F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0)))
                gaps = F.zip_with(at, ends, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
                return F.aggregate(gaps, F.lit(0), lambda s, v: s + v)

            return F.when(F.size(F.array_distinct(w)) < F.size(w), let(let(pairs, twice), length)).otherwise(F.lit(0))

        return F.when(n > WINDOW, let(windows, covered)).otherwise(F.lit(0))

    return let(hashes, of)


def measures(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, BLANKS), lambda w: w != "")
    bare = F.translate(t, WHITE, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    found = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(F.transform(w, lambda x: F.xxhash64(x))).alias("r")))
    return [
        found.alias("_found"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """Measures of ``_text`` beside ``_uid``, ``_id`` and ``_host``."""
    m = docs.select("_uid", "_id", "_host", *measures(F.col("_text")))
    m = m.select("_uid", "_id", "_host", F.col("_found.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_found.r").cast("long").alias("n_repeat_words"))
    return m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(rows: DataFrame, times: float = HOST_TIMES, least: float = HOST_LEAST, most: float = HOST_MOST, sigmas: float = SIGMAS) -> DataFrame:
    """``_host, n_docs, n_failed, shrunk_rate, low_rate, host_kept`` for each host; the prior is one row for all hosts."""
    hosts = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # moments over hosts: mean m, variance v without what sampling adds; strength a + b = m (1 - m) / v - 1
    prior = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1.0 / F.col("n_docs")).alias("inv"))
    prior = prior.select((F.col("f") / F.greatest(F.col("n"), F.lit(1))).alias("m"), "v", "inv")
    within = F.col("m") * (1 - F.col("m")) * F.col("inv")
    true_v = F.greatest(F.col("v") - within, F.lit(LEAST_VARIANCE))
    prior = prior.select("m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / true_v - 1, F.lit(2.0)), F.lit(MOST_STRENGTH)).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    spread = F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (F.col("n_docs") + F.col("strength") + 1))
    judged = hosts.join(F.broadcast(prior)).withColumn("shrunk_rate", shrunk).withColumn("low_rate", F.col("shrunk_rate") - sigmas * spread)
    return judged.withColumn("host_kept", F.col("low_rate") <= F.least(F.greatest(times * F.col("m"), F.lit(least)), F.lit(most))).drop("m", "strength")


def judge(spark: SparkSession, docs: DataFrame, times: float = HOST_TIMES, least: float = HOST_LEAST, most: float = HOST_MOST) -> DataFrame:
    """``_uid, doc_id``, the measures, ``base_failed, shrunk_rate, low_rate, kept`` for each row of ``docs``."""
    ws = Workspace(spark, "quality")
    base = documents_of(ws, docs, F.col("source").cast("string").alias("_host"))
    rows = ws.save(measured(base), "measures")
    verdicts = ws.save(host_verdicts(rows, times, least, most), "hosts")
    j = rows.join(verdicts.select(F.col("_host").alias("_h"), "shrunk_rate", "low_rate", "host_kept"), F.col("_host").eqNullSafe(F.col("_h")))
    return j.select("_uid", F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "shrunk_rate", "low_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
