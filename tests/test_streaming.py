from echoplane.streaming import windows


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = events.schema
    events.select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for k, df in enumerate((windows.sliding_rates(stream, "user_id", "ts", "value", 10, 5), windows.event_windows(stream.withColumn("ts", stream.ts.cast("timestamp")), "user_id", "ts", "value"))):
        q = df.writeStream.format("memory").queryName(f"out{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
    rates = spark.sql("select * from out0").collect()
    assert rates and all(0 < r.recurrence_rate <= 1 for r in rates)
    assert spark.sql("select * from out1").count() > 0
