"""Lexicons too large for one broadcast row."""

from pyspark.sql import Row

from polescale import queries, streaming


def test_stream_scores_are_axis_scores(spark, tmp_path):
    """All texts, and words of fewer than three seeds count."""
    docs = [(i, f"sol terre rare{'abcdefghijkl'[i]} commun") for i in range(12)] + [(12, None), (13, "xx")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2) for d, _ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got, want = (sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in (queries.stream_scores, queries.axis_score_lbg))
    assert got == want and len(got) == 14 and {n for _, _, n, _ in got} >= {0, 4}


def test_larger_lexicons_are_joined(spark, tmp_path, monkeypatch):
    lex = spark.createDataFrame([("terre", "X", 0.9), ("lune", "X", -0.9), ("vide", "X", None)], "word string, pos string, score double")
    rows = spark.createDataFrame([("a", "terre terre lune vide"), ("a", "terre terre lune vide"), ("b", "rien"), ("c", None), (None, "lune")], "slug string, body string")
    key = lambda df: sorted(map(str, df.collect()))
    small = streaming.scores(rows, lex)
    want = key(small.withColumn("axis_score", queries.r6("axis_score")))
    monkeypatch.setattr(streaming, "MOST_ROW_LOCAL", 2)
    large = streaming.scores(rows, lex)
    assert large.columns == small.columns and key(large.withColumn("axis_score", queries.r6("axis_score"))) == want

    rows.write.parquet(f"{tmp_path}/in")
    stream, out = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), []

    def take(batch, _):
        out.extend(streaming.scores(batch, lex).withColumn("axis_score", queries.r6("axis_score")).collect())

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(str, out)) == want and isinstance(out[0], Row)
