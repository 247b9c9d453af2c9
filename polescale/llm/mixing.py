"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...
and share ``budget`` times the words of all documents. A target stops at
``most`` (3) times its source's words; the excess is shared again by weight
until no target is above. That is water filling, in closed form: with sources
in order of stop / weight, the level is what the stops before leave, over the
weights left, at the first source that does not reach its stop. Prefix sums
over sources go by partition, so no task sorts all of them.

Draw: a document of a source has target / size expected copies. Documents of
a source stand in order of their number of words (equal ones in the order of
a hash), so the sample is even over lengths. Expected copies are summed up
along the order, a random offset of the source is added, and a document is
emitted once for each integer boundary crossed in its step. A document's
place in the order comes from row numbers within small groups (source,
words, salt) plus the groups' running totals; a group of n
is dealt over about sqrt(n) salts, so no task sorts a hot source or a group
of copies.

Defined results: null or empty text has no words and the size 0, so it takes
0 words however often it is copied. Null source is a source of its own.
Repeated rows, and rows with null or repeated ids, are separate documents;
of equal numbers of words the hash decides. Very long texts are counted
whole. A source without words has the target 0. Reruns agree, as the offset
and the order come from hashes. An empty table gives an empty result; extra
columns, with whatever names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polescale.llm.common import BLANKS, Workspace, documents_of, global_row_number, in_order
from polescale.llm.quality import let

MOST = 3


def number(*parts: Column) -> Column:
    """A hash of 60 bits that SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("bigint")


def n_words(text: Column) -> Column:
    return F.coalesce(let(F.split(text, BLANKS), lambda w: F.size(w) - F.size(F.filter(w, lambda x: x == ""))), F.lit(0)).cast("long")


def targets(ws: Workspace, sizes: DataFrame, budget: float = 1.0, most: int = MOST) -> DataFrame:
    """``_source, source_size, target`` from ``_source, _size`` rows."""
    per = ws.save(sizes.groupBy("_source").agg(F.sum("_size").alias("source_size")), "sources")
    ranked = global_row_number(ws, per, [F.col("_source").asc_nulls_last()], "_rank")
    ranked = ws.save(ranked.select("_source", "source_size", (F.col("_rank") % 3 + 1).alias("_weight"), (most * F.col("source_size")).alias("_stop")), "ranked")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    filled, part, at = in_order(ws, ranked, [(F.col("_stop") / F.col("_weight")).asc()], "by-stop")
    ahead = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = filled.groupBy(part).agg(F.sum("_stop").alias("_s"), F.sum("_weight").alias("_w"))  # a row for each partition
    sums = sums.select(part, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_held"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_gone"))
    held = F.col("_held") + F.coalesce(F.sum("_stop").over(ahead), F.lit(0))
    gone = F.col("_gone") + F.coalesce(F.sum("_weight").over(ahead), F.lit(0))
    line = filled.join(F.broadcast(sums), part).select("_stop", "_weight", ((budget * (total or 0) - held) / (F.lit(weights or 0) - gone)).alias("_level"))
    level = line.where(F.col("_level") <= F.col("_stop") / F.col("_weight")).agg(F.max("_level")).first()[0]
    # no such source: all reach their stops
    goal = F.col("_stop").cast("double") if level is None else F.least(F.col("_stop").cast("double"), F.lit(level) * F.col("_weight"))
    return ranked.select("_source", "source_size", goal.alias("target"))


def mix(spark: SparkSession, docs: DataFrame, budget: float = 1.0, most: int = MOST, seed: int = 10) -> DataFrame:
    """``_uid, doc_id, size, source, source_size, target, copies, taken`` for each row of ``docs``."""
    ws = Workspace(spark, "mix")
    base = documents_of(ws, docs, F.col("source").cast("string").alias("_source"))
    rows = ws.save(base.select("_uid", "_id", "_source", n_words(F.col("_text")).alias("_size")), "sizes")
    goal = ws.save(targets(ws, rows, budget, most), "targets")

    # places in the order of (words, salt, hash) within each source
    # tables of their own, so that the joins stand alone and a hot source or size can be split
    groups = ws.save(rows.groupBy("_source", "_size").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_salts")), "groups")
    keyed = rows.join(groups.withColumnRenamed("_source", "_s").withColumnRenamed("_size", "_z"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    keyed = keyed.withColumn("_hash", number(F.lit(str(seed)), F.col("_uid").cast("string")))
    keyed = ws.save(keyed.withColumn("_salt", F.pmod(F.col("_hash"), F.col("_salts"))).drop("_s", "_z", "_salts"), "keyed")
    step = Window.partitionBy("_source").orderBy("_size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    heads = keyed.groupBy("_source", "_size", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(step), F.lit(0)))
    heads = ws.save(heads.select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_salt").alias("_t"), "_before"), "heads")
    inner = F.row_number().over(Window.partitionBy("_source", "_size", "_salt").orderBy("_hash", "_uid"))
    placed = keyed.withColumn("_row", inner).join(heads, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_salt") == F.col("_t")))
    placed = placed.select("_uid", "_id", "_source", "_size", (F.col("_before") + F.col("_row")).alias("_place"))

    offset = F.pmod(number(F.lit(str(seed)), F.lit("offset"), F.coalesce("_source", F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
    goal = goal.select(F.col("_source").alias("_s"), "source_size", "target")
    joined = placed.join(goal, F.col("_source").eqNullSafe(F.col("_s")))
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(float(most)))
    joined = joined.withColumn("_rate", rate).withColumn("_offset", offset)
    crossed = F.floor(F.col("_place") * F.col("_rate") + F.col("_offset")) - F.floor((F.col("_place") - 1) * F.col("_rate") + F.col("_offset"))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return joined.select("_uid", F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))
