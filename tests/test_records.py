import pytest
from pyspark.sql import functions as F

from tidewake.functions import records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "output,count",
    [
        ("Detected 0 speech segments:\n", 0),
        ("Detected 1 speech segments:\nSpeech segment 0: start = 1.5, end = 2\n", 1),
        ("", None),
        ("Detected 1 speech segments:", None),
        ("Detected 0 speech segments:\nmore", None),
        ("Detected 1 speech segments:\nSpeech segment 1: start = 1, end = 2", None),
        ("Detected 1 speech segments:\nSpeech segment 0: start = -1, end = 2", None),
        ("Detected x speech segments:", None),
        (None, None),
    ],
)
def test_detector_outputs(spark, output, count):
    assert one(spark, records.vad_segments(F.lit(output).cast("string"))) == count


def test_numbers(spark):
    assert [one(spark, records.timeout_ms(F.lit(s))) for s in (15, 60, 75)] == [90_000, 120_000, 150_000]
    assert [one(spark, records.gcd(F.lit(a), F.lit(b))) for a, b in ((12, 18), (-12, 18), (7, 0), (0, 0), (2_400_000, 25_000))] == [6, 6, 7, 0, 25_000]
    assert [one(spark, records.half_away(F.lit(x))) for x in (2.5, -2.5, 0.4)] == [3, -3, 0]
    assert [one(spark, records.can_channelize(F.lit(hz))) for hz in (155_575_000, 155_574_999, 157_925_000, 157_925_001)] == [True, False, True, False]


def test_clips(spark):
    at = lambda *x: tuple(one(spark, records.clip_bounds(F.lit(1000), *[F.lit(v).cast("double") for v in x])))
    assert at(10, 2, 6) == (3000, 7000) and at(10, None, None) == (1000, 11_000) and at(10, 8, 3) == (9000, 9000) and at(None, 1, 2) == (1000, 1000)
    part = lambda *x: tuple(one(spark, records.activity_slice(F.lit(1000), F.lit(16), *[F.lit(v).cast("double") for v in x])))
    assert part(1, 2) == (32, 64) and part(None, 2) == (0, 1000) and part(2, 1) == (64, 64) and part(1, 99) == (32, 1000)


def test_texts_and_rows(spark):
    said = lambda t: one(spark, records.text_value(F.lit(t).cast("string")))
    assert [said(t) for t in ('{"value": " x "}', '" y"', '{"value": 3}', '"  "', "{", None, '{"other": "z"}')] == ["x", "y", None, None, None, None, None]
    lines = spark.createDataFrame([('{"a": 1}',), ("",), ('{"a": 2}',)], "value string")
    assert sorted(r.a for r in records.json_rows(lines).select(F.try_variant_get("row", "$.a", "int").alias("a")).collect()) == [1, 2]
    with pytest.raises(Exception, match="not a JSON object"):
        records.json_rows(spark.createDataFrame([("[1]",)], "value string")).select(F.col("row").cast("string")).collect()
