from tidewake.streaming import stateful


def test_a_batch_sees_the_vessels_of_its_time(spark, tmp_path):
    source, names = f"{tmp_path}/in", f"{tmp_path}/names"
    got = None
    for rows, known in (([(1, 7), (2, None)], [(7, "old")]), ([(3, 7), (4, 8)], [(7, "new"), (8, "other")])):
        spark.createDataFrame(rows, "event_id long, mmsi long").coalesce(1).write.mode("append").parquet(source)
        spark.createDataFrame(known, "mmsi long, vessel string").coalesce(1).write.mode("overwrite").parquet(names)
        stream = spark.readStream.schema("event_id long, mmsi long").parquet(source)
        got = stateful.enriched(stream, lambda: spark.read.schema("mmsi long, vessel string").parquet(names), "mmsi", f"file://{tmp_path}/run", "event_id long, mmsi long, vessel string")
    assert sorted(map(tuple, got.collect())) == [(1, 7, "old"), (2, None, None), (3, 7, "new"), (4, 8, "other")]
