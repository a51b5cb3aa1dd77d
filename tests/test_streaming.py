from pyspark.sql import functions as F

from tidemark.streaming import revisions as R


def test_stream_matches_batch(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 3} 10:00:00", "four real words here" if k % 2 else "no") for k in range(12)]
    df = spark.createDataFrame(rows, "k int, made_at string, text string").withColumn("made_at", F.to_timestamp("made_at"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    s = R.stream_table(spark, str(tmp_path / "in"), df.schema, 1)
    q = R.keep_rates(s).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in R.keep_rates(df).collect()}
    assert {tuple(r) for r in spark.table("rates").collect()} == want


def test_repeated_rows_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, t string").withColumn("made_at", F.to_timestamp(F.lit("2024-01-01")))
    df.write.parquet(str(tmp_path / "in"))
    q = R.first_rows(R.stream_table(spark, str(tmp_path / "in"), df.schema), ["k"]).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
