"""A receiver's byte stream: typed frames, the parts of their sound, where they go, and the states among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators import gates
from tidewake.plans.edges import _in_chunks
from tidewake.plans.registry import query
from tidewake.sources import frames
from tidewake.sources.domain import SAMPLES_SQL, samples

SLOT_A, SLOT_B = 156_800_000, 157_100_000
#: k % 10 is the frame's kind, 0 and 9 are wrong ones; every fourth (by k // 10) of the kinds 1, 3, 5 and 7 is damaged.
FRAMES_SQL = f"""{SAMPLES_SQL}, f AS (SELECT user_id * 100000 + start_ms // 86400000 AS stream, event_id, k, k % 10 AS m, k // 10 % 4 = 0 AS bad, start_ms, noise, score,
 CASE WHEN k % 3 = 0 THEN {SLOT_B} ELSE {SLOT_A} END AS frequency, 1 + k // 10 % 5 AS parts, row_number() OVER (PARTITION BY user_id * 100000 + start_ms // 86400000 ORDER BY event_id) - 1 AS frame_no FROM samples),
 p AS (SELECT stream, frame_no, j, 2 * (1 + (k + j) % 5) AS bytes, noise + j / CAST(100 AS DOUBLE) AS noise FROM f, range(0, 5) AS r(j) WHERE m IN (7, 8) AND j < parts),
 w AS (SELECT stream, frame_no, sum(bytes) AS total, sum(bytes * noise) / sum(bytes) AS mean FROM p GROUP BY 1, 2),
 t AS (SELECT f.*, CASE m WHEN 0 THEN 9 WHEN 9 THEN 7 ELSE m END AS kind, CASE WHEN m = 0 THEN 'kind' WHEN m = 9 THEN 'span' WHEN bad AND m IN (1, 5) THEN 'truncated' WHEN bad AND m = 3 THEN 'state' WHEN bad AND m = 7 THEN 'cover' END AS error,
  w.total, w.mean FROM f LEFT JOIN w USING (stream, frame_no))"""


def received(spark, sf):
    """Events as frames of their user's stream of a day, found again in chunks and typed."""
    k, noise = F.col("k"), F.col("noise")
    m, bad = k % 10, F.floor(k / 10) % 4 == 0
    parts = F.transform(F.sequence(F.lit(0), (F.floor(k / 10) % 5).cast("int")), lambda j: F.struct(F.when(m == 9, 3).otherwise(2 * (1 + (k + j) % 5)).cast("long").alias("bytes"), (noise + j / 100).alias("noise")))
    sound = F.aggregate(parts, F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
    length = F.when(m.isin(7, 8, 9), sound + F.when(bad & (m == 7), 2).otherwise(0)).otherwise(2 * k)
    state = F.to_json(F.struct(noise.alias("voice_level"), F.col("score").alias("iq_edge_fraction"), F.create_map(F.lit("156800000"), F.col("score")).alias("spectrum_activity")))
    rows = samples(spark, sf).select(
        (F.col("user_id") * 100_000 + F.floor(F.col("start_ms") / 86_400_000)).alias("stream"), "event_id", bad.alias("bad"), F.when(m == 0, 9).when(m == 9, frames.SPANNED_A).otherwise(m).cast("int").alias("kind"),
        F.col("start_ms").alias("captured_ms"), F.when(k % 3 == 0, SLOT_B).otherwise(SLOT_A).cast("long").alias("frequency"), noise, parts.alias("spans"), F.unhex(F.repeat(F.lit("7F"), length.cast("int"))).alias("pcm"), state.alias("state"),
    )
    cut = F.when(F.col("bad") & F.col("kind").isin(1, 5), F.substring("payload", F.lit(1), F.lit(7))).when(F.col("bad") & (F.col("kind") == 3), F.substring("payload", F.lit(1), F.lit(5))).otherwise(F.col("payload"))
    return frames.typed(frames.deframe(_in_chunks(frames.packed(rows).select("stream", "event_id", frames.frame(F.col("kind"), cut).alias("f")))))


@query(
    "typed_frames",
    f"""WITH {FRAMES_SQL} SELECT stream, frame_no, kind, error, CASE WHEN error IS NULL AND kind >= 5 THEN start_ms END AS captured_ms, CASE WHEN error IS NULL AND kind >= 5 THEN frequency END AS frequency,
 CASE WHEN error IS NULL THEN round(CASE WHEN kind IN (1, 4, 5, 6) THEN noise WHEN kind IN (7, 8) THEN mean END, 9) END AS noise, CASE WHEN error IS NULL AND kind IN (7, 8) THEN parts END AS n_spans,
 CASE WHEN error IS NULL AND kind <> 3 THEN CASE WHEN kind IN (7, 8) THEN total ELSE 2 * k END END AS pcm_bytes FROM t""",
)
def typed_frames(spark, sf):
    """Each frame's fields by its kind, the noise of spanned ones weighted by bytes, or what is wrong with it."""
    size = F.when(F.col("spans").isNotNull(), F.size("spans")).cast("long")
    return received(spark, sf).select("stream", "frame_no", "kind", "error", "captured_ms", "frequency", F.round("noise", 9).alias("noise"), size.alias("n_spans"), F.octet_length("pcm").cast("long").alias("pcm_bytes"))


@query(
    "frame_spans",
    f"""WITH {FRAMES_SQL}, s AS (SELECT p.* FROM p JOIN t USING (stream, frame_no) WHERE t.error IS NULL UNION ALL SELECT stream, frame_no, 0, 2 * k, noise FROM t WHERE error IS NULL AND kind IN (1, 4, 5, 6) AND k > 0)
 SELECT stream, frame_no, j AS span_no, CAST(sum(bytes) OVER (PARTITION BY stream, frame_no ORDER BY j) - bytes AS BIGINT) AS byte_start, bytes, round(noise, 9) AS noise FROM s""",
)
def frame_spans(spark, sf):
    """The parts of each frame's sound, end to end, with the noise of each."""
    return frames.span_rows(received(spark, sf)).withColumn("noise", F.round("noise", 9))


@query(
    "frame_routes",
    f"""WITH {FRAMES_SQL}, e AS (SELECT stream, min(frame_no) AS stop FROM t WHERE error IS NOT NULL GROUP BY 1), r AS (SELECT t.*, CASE WHEN kind IN (7, 8) THEN total ELSE 2 * k END AS size,
 CASE WHEN kind = 1 OR kind IN (5, 7) AND frequency = {SLOT_A} THEN 'A' WHEN kind = 4 OR kind IN (6, 8) AND frequency = {SLOT_B} AND stream % 2 = 0 THEN 'B' WHEN kind = 2 THEN 'calls' WHEN kind = 3 THEN 'state' END AS target FROM t LEFT JOIN e USING (stream) WHERE stop IS NULL OR frame_no < stop)
 SELECT stream, coalesce(target, 'left') AS target, count(*) AS frames, CAST(sum(CASE WHEN kind <> 3 THEN size END) AS BIGINT) AS bytes, count(*) FILTER (WHERE kind = 1 AND noise < CAST(0.22 AS DOUBLE)) AS heard FROM r GROUP BY 1, 2""",
)
def frame_routes(spark, sf):
    """Frames by where they go, up to a stream's first wrong one; every other stream's second slot listens to the digital channel."""
    slot_b = F.when(F.col("stream") % 2 == 0, F.lit(SLOT_B))
    rows = frames.routed(frames.until_error(received(spark, sf)), F.lit(SLOT_A), slot_b, gates.threshold(F.lit(20)))
    return rows.groupBy("stream", F.coalesce("target", F.lit("left")).alias("target")).agg(F.count("*").alias("frames"), F.sum(F.octet_length("pcm")).alias("bytes"), F.count_if("heard").alias("heard"))


@query(
    "frame_states",
    f"WITH {FRAMES_SQL} SELECT stream, frame_no, noise AS voice_level, CAST(NULL AS DOUBLE) AS slot_b_level, score AS iq_edge_fraction, score AS activity FROM t WHERE kind = 3 AND error IS NULL",
)
def frame_states(spark, sf):
    return frames.states(received(spark, sf)).select("stream", "frame_no", "voice_level", "slot_b_level", "iq_edge_fraction", F.try_element_at("spectrum_activity", F.lit("156800000")).alias("activity"))
