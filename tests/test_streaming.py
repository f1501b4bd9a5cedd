import datetime

from quietlake.streaming.governed import redacted, windowed_counts


def test_redacted_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("ssn 123-45-6789\nplain\n")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    q = redacted(stream).writeStream.format("memory").queryName("red_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["text"] for r in spark.table("red_out").collect()} == {"ssn <REDACTED:US_SSN>", "plain"}


def test_closed_windows_only(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(minutes=i % 10), "a") for i in range(20)] + [(t, "b")] * 3 + [(t + datetime.timedelta(hours=2), "a")]
    spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", ["k"], "1 hour", "10 minutes").writeStream.format("memory").queryName("win_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["k"], r["n"]) for r in spark.table("win_out").collect()} == {("a", "20"), ("<11", "<11")}
