import datetime as dt

from taskloom.streaming.idle import islands


def test_islands_of_a_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", t + dt.timedelta(minutes=m), False) for m in (0, 90, 181)] + [("s", t + dt.timedelta(days=9), True)]
    spark.createDataFrame(rows, "session string, at timestamp, is_error boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, at timestamp, is_error boolean").parquet(str(tmp_path / "in"))
    q = islands(stream).writeStream.format("memory").queryName("islands_test").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.turns for r in spark.table("islands_test").collect()) == [1, 2]
