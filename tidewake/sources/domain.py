"""The monitoring tables, mapped from the generic ones.

``samples``: quality-annotated pieces of audio. ``spans``: the same, numbered within hourly segments of a
channel. ``segments``: those segments. Times are whole milliseconds, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    """Of stored events or of a stream of them."""
    k = F.get_json_object("props", "$.k").cast("long")
    start = _ms("ts")
    return events.select(
        "event_id",
        F.col("event_type").alias("channel"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("slot"),
        "user_id",
        k.alias("k"),
        start.alias("start_ms"),
        (start + 1000 * (k + 1)).alias("end_ms"),
        (1000 * (k + 1)).alias("dur_ms"),
        (320 * (k + 1)).alias("bytes"),
        F.when(k % 10 != 0, F.col("value") / 200).alias("noise"),
        (F.col("value") / 25).alias("score"),
    )


SAMPLES_SQL = """samples AS (SELECT event_id, event_type AS channel, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS slot, user_id,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS start_ms,
 epoch_us(ts) // 1000 + 1000 * (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS end_ms,
 1000 * (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS dur_ms,
 320 * (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS bytes,
 CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 THEN value / 200 END AS noise, value / 25 AS score FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample as a span of its channel's hourly segment, with byte offsets."""
    df = samples(spark, sf_dir).withColumn("hour", F.floor(F.col("start_ms") / HOUR_MS))
    order = Window.partitionBy("channel", "hour").orderBy("start_ms", "event_id")
    stop = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.select("channel", "hour", F.row_number().over(order).cast("long").alias("span_no"), "bytes", "noise", (stop - F.col("bytes")).alias("byte_start"), stop.alias("byte_end"))


SPANS_SQL = (
    SAMPLES_SQL
    + """, spans AS (SELECT channel, start_ms // 3600000 AS hour, row_number() OVER w AS span_no, bytes, noise,
 CAST(sum(bytes) OVER w - bytes AS BIGINT) AS byte_start, CAST(sum(bytes) OVER w AS BIGINT) AS byte_end FROM samples
 WINDOW w AS (PARTITION BY channel, start_ms // 3600000 ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING))"""
)
