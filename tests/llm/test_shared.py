from pyspark.sql import functions as F

from tidewake.llm import shared


def test_smallest_are_the_same_however_they_are_found(spark):
    df = spark.range(5000).repartition(7).withColumn("v", F.col("id") % 50)
    place = F.shiftrightunsigned(F.xxhash64("id"), 11)
    for n in (1, 40, 4990, 6000):
        got = [r.id for r in shared.smallest(df, n, F.col("id")).collect()]
        assert got == [r.id for r in df.orderBy(place, "id").limit(n).collect()]
    # one value in all rows has one hash: rows that share it stay eligible
    assert shared.smallest(spark.range(100).withColumn("v", F.lit(1)), 5, F.col("v")).count() == 5
    assert shared.smallest(df.limit(0), 5, F.col("id")).count() == 0
