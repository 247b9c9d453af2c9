"""Lexicons, predictions, comparison tables: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polescale.config import DIGITS


def lexicon_schema(minus: str, plus: str) -> T.StructType:
    fields = [("word", T.StringType()), ("pos", T.StringType()), ("score", T.DoubleType()), (f"freq_{minus}", T.LongType()), (f"freq_{plus}", T.LongType()), ("n_docs", T.LongType()), ("ci_low", T.DoubleType()), ("ci_high", T.DoubleType())]
    return T.StructType([T.StructField(n, t, n.startswith("ci_")) for n, t in fields])


def write_one(df: DataFrame, path: str, kind: str, **options) -> None:
    """Write ``df`` as one file at ``path``: a lexicon's or a benchmark's rows, not a corpus. It appears when it is complete."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    df.coalesce(1).write.mode("overwrite").format(kind).options(**options).save(f"{path}.parts")
    [part] = [f.getPath() for f in store.listStatus(parts) if f.getPath().getName().startswith("part-")]
    store.delete(target, True)
    if not store.rename(part, target):
        raise OSError(f"cannot write {path}")
    store.delete(parts, True)


def write_lexicon(rows: DataFrame, folder: str, minus: str, plus: str) -> None:
    """A sorted CSV file and a snappy Parquet file with axis-named frequency columns; a null interval is an empty CSV field."""
    named = rows.withColumnRenamed("freq_minus", f"freq_{minus}").withColumnRenamed("freq_plus", f"freq_{plus}")
    named = named.select(*lexicon_schema(minus, plus).fieldNames()).orderBy("word", "pos")
    write_one(named, f"{folder}/lexicon.csv", "csv", header=True, emptyValue="")
    write_one(named, f"{folder}/lexicon.parquet", "parquet", compression="snappy")


def _last(df: DataFrame, *values: str) -> DataFrame:
    """Of rows that repeat (word, pos) the last of the file counts."""
    order = F.monotonically_increasing_id()
    last = df.withColumn("_n", order).groupBy("word", "pos").agg(F.max(F.struct("_n", *values)).alias("v"))
    return last.select("word", "pos", *[F.col(f"v.{x}").alias(x) for x in values])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, pos, score`` of a lexicon CSV, by column name."""
    df = spark.read.option("header", True).csv(path)
    return _last(df.select("word", "pos", F.col("score").cast("double").alias("score")), "score")


def read_pole_counts(spark: SparkSession, path: str) -> DataFrame:
    """``word, pos, freq_minus, freq_plus`` of a lexicon CSV; frequencies are the fourth and fifth columns whatever their names."""
    df = spark.read.option("header", True).csv(path)
    c = df.columns
    named = df.select(F.col(f"`{c[0]}`").alias("word"), F.col(f"`{c[1]}`").alias("pos"), F.col(f"`{c[3]}`").cast("long").alias("freq_minus"), F.col(f"`{c[4]}`").cast("long").alias("freq_plus"))
    return _last(named, "freq_minus", "freq_plus")


def read_predictions(spark: SparkSession, folder: str, suffix: str = ".prediction.json") -> DataFrame:
    """``slug, predicted_pole`` of ``*<suffix>`` files; the slug is the file's name if the JSON has none; null predictions are dropped."""
    raw = spark.read.schema("slug string, predicted_pole string").option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    name = F.col("_metadata.file_name")
    named = raw.select("slug", "predicted_pole", name.alias("n")).where(~F.col("n").startswith("._"))
    slug = F.coalesce(F.nullif(F.col("slug"), F.lit("")), F.regexp_replace("n", suffix.replace(".", r"\.") + "$", ""))
    return named.where("predicted_pole is not null and predicted_pole <> ''").select(slug.alias("slug"), "predicted_pole")


def shown(c: str) -> Column:
    """A double of six digits as Python and DuckDB write it (0.0005, 1e-05, -0.0), where Spark writes 5.0E-4; other numbers as Spark does."""
    x = F.round(c, DIGITS)
    plain = F.regexp_replace(F.regexp_replace(x.cast(f"decimal(38,{DIGITS})").cast("string"), "0+$", ""), r"\.$", ".0")
    digits = F.rtrim(F.abs(F.round(x * 10**DIGITS)).cast("long").cast("string"), F.lit("0"))  # of numbers below 1e-4, at most two
    power = F.when(F.abs(x) < 9.5e-6, "-06").otherwise("-05")
    small = F.concat(F.when(x < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 1))).otherwise(""), F.lit("e"), power)
    zero = F.when(F.col(c) < 0, "-0.0").otherwise("0.0")
    return F.when(x == 0, zero).when(F.abs(x) < 9.95e-5, small).when(F.abs(x) < 1e15, plain).otherwise(x.cast("string"))


def comparison_columns(rows: DataFrame, scoring: str) -> DataFrame:
    """The stored comparison: rounded numbers, empty strings for nulls, 1/0 grades, True/False robustness."""
    number = lambda c: F.coalesce(shown(c), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    grade = F.when(F.col("correct"), "1").when(~F.col("correct"), "0").otherwise("")
    robust = F.when(F.col("sign_robust"), "True").otherwise("False")
    return rows.select(
        "slug", "category", text("gold_pole").alias("gold_pole"), text("predicted_pole").alias("predicted_pole"), F.round("axis_score", DIGITS).alias("axis_score"),
        number("ci_low").alias("axis_score_ci_low"), number("ci_high").alias("axis_score_ci_high"), robust.alias("sign_robust"),
        F.col("n_hits").alias("n_lexicon_hits"), "n_tokens", grade.alias("on_axis_correct"), F.lit(scoring).alias("scoring"),
    )


def write_comparison(rows: DataFrame, path: str, scoring: str) -> None:
    write_one(comparison_columns(rows, scoring), path, "csv", header=True, emptyValue="")
