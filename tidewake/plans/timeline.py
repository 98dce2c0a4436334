"""Offsets, hulls, locks and templates along a timeline; manifests and back-filled frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import gates
from tidewake.operators.retention import keep_fitting, keep_ttl
from tidewake.plans.activity import BINS_SQL, _bins
from tidewake.plans.registry import query
from tidewake.plans.signals import DAYS_SQL, _days
from tidewake.sources import frames
from tidewake.sources.domain import SAMPLES_SQL, SPANS_SQL, samples, spans


@query(
    "activity_hull",
    f"WITH RECURSIVE {BINS_SQL} SELECT channel, hour, CAST(min(bin) FILTER (WHERE activity > 0) AS BIGINT) AS first_bin, CAST(max(bin) FILTER (WHERE activity > 0) AS BIGINT) AS last_bin, max(activity) AS top, CAST(coalesce(min(bin) FILTER (WHERE activity > 0), 48) AS BIGINT) AS quiet_before, CAST(coalesce(47 - max(bin) FILTER (WHERE activity > 0), 48) AS BIGINT) AS quiet_after FROM bins GROUP BY 1, 2",
)
def activity_hull(spark, sf):
    """From the first active bin to the last, as one interval, and how many quiet ones lie outside."""
    some = F.when(F.col("activity") > 0, F.col("bin"))
    rows = _bins(spark, sf).groupBy("channel", "hour").agg(F.min(some).alias("first_bin"), F.max(some).alias("last_bin"), F.max("activity").alias("top"))
    return rows.withColumn("quiet_before", F.coalesce("first_bin", F.lit(48).cast("long"))).withColumn("quiet_after", F.coalesce(47 - F.col("last_bin"), F.lit(48).cast("long")))


@query(
    "overlap_offsets",
    f"WITH {SAMPLES_SQL}, d AS (SELECT *, start_ms // 86400000 AS day FROM samples) SELECT event_id, CAST(coalesce(sum(dur_ms) OVER (PARTITION BY channel, day ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM d",
)
def overlap_offsets(spark, sf):
    """Where each record begins in its day's play-back."""
    before = Window.partitionBy("channel", "day").orderBy("start_ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = samples(spark, sf).withColumn("day", F.floor(F.col("start_ms") / 86_400_000))
    return rows.select("event_id", F.coalesce(F.sum("dur_ms").over(before), F.lit(0)).cast("long").alias("offset_ms"))


@query(
    "clock_at_offset",
    f"""WITH {SAMPLES_SQL}, d AS (SELECT *, start_ms // 86400000 AS day FROM samples), o AS (SELECT *, sum(dur_ms) OVER w - dur_ms AS lo, sum(dur_ms) OVER w AS hi, row_number() OVER (PARTITION BY channel, day ORDER BY start_ms DESC, event_id DESC) AS back FROM d WINDOW w AS (PARTITION BY channel, day ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING))
 SELECT channel, day, event_id, CAST(start_ms + 600000 - lo AS BIGINT) AS at_ms FROM o WHERE 600000 >= lo AND (600000 < hi OR back = 1)""",
)
def clock_at_offset(spark, sf):
    """What time it was ten minutes into a day's play-back; its last record takes what is beyond."""
    w = Window.partitionBy("channel", "day").orderBy("start_ms", "event_id")
    rows = samples(spark, sf).withColumn("day", F.floor(F.col("start_ms") / 86_400_000))
    rows = rows.withColumn("hi", F.sum("dur_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("event_id").over(w).isNull())
    lo = F.col("hi") - F.col("dur_ms")
    return rows.where((lo <= 600_000) & ((F.col("hi") > 600_000) | F.col("last"))).select("channel", "day", "event_id", (F.col("start_ms") + 600_000 - lo).alias("at_ms"))


@query("asof_template", f"WITH {DAYS_SQL} SELECT event_id, last_value(CASE WHEN n % 7 = 1 THEN score END IGNORE NULLS) OVER (PARTITION BY channel, day ORDER BY n ROWS UNBOUNDED PRECEDING) AS template FROM d")
def asof_template(spark, sf):
    """The latest template at or before each frame; every seventh frame makes one."""
    w = Window.partitionBy("channel", "day").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return _days(spark, sf).select("event_id", F.last(F.when(F.col("n") % 7 == 1, F.col("score")), ignorenulls=True).over(w).alias("template"))


@query(
    "scan_lock",
    f"""WITH RECURSIVE {SPANS_SQL}, f AS (SELECT channel, hour, span_no, bytes, (noise IS NULL OR noise < CAST(0.22 AS DOUBLE)) AS open FROM spans),
 w AS (SELECT channel, hour, span_no, CASE WHEN open THEN bytes ELSE 0 END AS heard, CASE WHEN open THEN 0 ELSE bytes END AS quiet, open AND bytes >= 12000 AS locked FROM f WHERE span_no = 1
 UNION ALL SELECT f.channel, f.hour, f.span_no, CASE WHEN f.open THEN w.heard + f.bytes ELSE 0 END, CASE WHEN f.open THEN 0 ELSE w.quiet + f.bytes END,
 CASE WHEN f.open THEN w.locked OR w.heard + f.bytes >= 12000 ELSE w.locked AND w.quiet + f.bytes < 20000 END FROM w JOIN f ON f.channel = w.channel AND f.hour = w.hour AND f.span_no = w.span_no + 1)
 SELECT channel, hour, span_no, CAST(locked AS INTEGER) AS locked FROM w""",
)
def scan_lock(spark, sf):
    """Locked once sound lasted long enough, until quiet did: the latest of the two events at each span decides."""
    keys = ["channel", "hour"]
    w = Window.partitionBy(*keys).orderBy("span_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = spans(spark, sf).withColumn("open", gates.open_for_playback(F.col("noise"), gates.threshold(F.lit(20))))
    rows = rows.withColumn("island", F.sum(F.coalesce((F.col("open") != F.lag("open").over(w)).cast("long"), F.lit(0))).over(upto))
    lasted = F.sum("bytes").over(Window.partitionBy(*keys, "island").orderBy("span_no").rowsBetween(Window.unboundedPreceding, 0))
    event = F.when(F.col("open") & (lasted >= 12_000), 1).when(~F.col("open") & (lasted >= 20_000), 0)
    return rows.withColumn("event", event).select(*keys, "span_no", F.coalesce(F.last("event", ignorenulls=True).over(upto), F.lit(0)).alias("locked"))


SAVED_MS = 1_706_745_600_000  # when the manifest was written: the start of February 2024

#: Each channel's rows from the newest on: what still fits stays, what would overflow is passed over.
MANIFEST_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, m AS (SELECT channel, event_id, start_ms, bytes, CASE k % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'transcribing' WHEN 2 THEN 'error' ELSE 'complete' END AS status, row_number() OVER (PARTITION BY channel ORDER BY start_ms DESC, event_id DESC) AS rn FROM samples WHERE k >= 5 AND k % 13 <> 0),
 w AS (SELECT DISTINCT channel, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS event_id, '' AS status, false AS kept FROM m
 UNION ALL SELECT m.channel, m.rn, w.used + CASE WHEN w.used + m.bytes <= 5000000 THEN m.bytes ELSE 0 END, m.event_id, m.status, w.used + m.bytes <= 5000000 FROM w JOIN m ON m.channel = w.channel AND m.rn = w.rn + 1)
 SELECT channel, event_id, CASE WHEN status IN ('queued', 'transcribing') THEN 'skipped' ELSE status END AS status FROM w WHERE kept"""


@query("manifest_load", MANIFEST_SQL)
def manifest_load(spark, sf):
    """Stored segments that are valid and as long as their files, newest first: each that still fits the budget. Transcriptions that were under way count as skipped."""
    k = F.col("k")
    status = F.element_at(F.array(*map(F.lit, ("queued", "transcribing", "error", "complete"))), (k % 4 + 1).cast("int"))
    found = F.when(k % 13 == 0, F.col("bytes") - 2).otherwise(F.col("bytes"))  # some files were cut off
    stored = samples(spark, sf).where("k >= 5").select("channel", "event_id", "start_ms", "bytes", found.alias("found"), status.alias("status")).where("found = bytes")
    rows = keep_fitting(stored, "channel", ["start_ms", "event_id"], "bytes", 5_000_000)
    return rows.select("channel", "event_id", F.when(F.col("status").isin("queued", "transcribing"), "skipped").otherwise(F.col("status")).alias("status"))


@query(
    "manifest_events",
    f"""WITH {SAMPLES_SQL}, e AS (SELECT channel, event_id, CASE k % 17 WHEN 0 THEN 0 ELSE event_id + 1 END AS id, start_ms, CASE WHEN k % 5 <> 0 THEN end_ms END AS ended FROM samples)
 SELECT channel, event_id, coalesce(ended, {SAVED_MS}) AS ended_ms, CAST(ended IS NULL AS INTEGER) AS was_open FROM e WHERE id > 0 AND coalesce(ended, {SAVED_MS}) >= {SAVED_MS - 10 * 86_400_000}""",
)
def manifest_events(spark, sf):
    """Stored activity, valid events only: what was open is closed at the time of the manifest, then what ended too long ago goes."""
    k = F.col("k")
    events = samples(spark, sf).select("channel", "event_id", F.when(k % 17 == 0, 0).otherwise(F.col("event_id") + 1).alias("id"), F.when(k % 5 != 0, F.col("end_ms")).alias("ended")).where("id > 0")
    closed = events.select("channel", "event_id", F.coalesce("ended", F.lit(SAVED_MS)).alias("ended_ms"), F.col("ended").isNull().cast("int").alias("was_open"))
    return keep_ttl(closed, "ended_ms", SAVED_MS, 10 * 86_400_000, inclusive=True)


@query("backfill_spans", f"WITH {SAMPLES_SQL} SELECT event_id, bytes AS first_bytes, CAST(2 * bytes AS BIGINT) AS second_bytes, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS valid FROM samples")
def backfill_spans(spark, sf):
    """Two span lengths and their sound as bytes, read back: the lengths must be even, positive and cover it exactly."""
    size = F.col("bytes")
    sound = F.octet_length(F.col("pcm"))
    made = samples(spark, sf).withColumn("pcm", F.unhex(F.repeat(F.lit("00"), (F.when(F.col("k") % 5 == 0, 1).otherwise(0) + 3 * size).cast("int"))))
    rows = made.select("event_id", F.concat(frames.little_endian(size, 4), frames.little_endian(2 * size, 4), "pcm").alias("payload"), sound.alias("n"))
    a, b = frames.number(F.col("payload"), 0, 4), frames.number(F.col("payload"), 4, 4)
    ok = (a > 0) & (b > 0) & (a % 2 == 0) & (b % 2 == 0) & (a + b == F.octet_length("payload") - 8)
    return rows.select("event_id", a.alias("first_bytes"), b.alias("second_bytes"), ok.cast("int").alias("valid"))


@query("rf_strength", f"WITH {SAMPLES_SQL} SELECT event_id, round(CASE WHEN noise IS NULL THEN 0.45 ELSE least(1, greatest(0, (0.5 - noise) / 0.45)) END, 9) AS rf, round(least(1, greatest(0.12, 0.65 * least(1, score / 20) + 0.35 * CASE WHEN noise IS NULL THEN 0.45 ELSE least(1, greatest(0, (0.5 - noise) / 0.45)) END)), 9) AS radio FROM samples")
def rf_strength(spark, sf):
    rf = F.when(F.col("noise").isNull(), 0.45).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.5 - F.col("noise")) / 0.45)))
    radio = F.least(F.lit(1.0), F.greatest(F.lit(0.12), 0.65 * F.least(F.lit(1.0), F.col("score") / 20) + 0.35 * rf))
    return samples(spark, sf).select("event_id", F.round(rf, 9).alias("rf"), F.round(radio, 9).alias("radio"))


@query(
    "speech_mask",
    f"WITH {DAYS_SQL}, t AS (SELECT *, score >= 0.4 * max(score) OVER (PARTITION BY channel, day) AS hit FROM d) SELECT event_id, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS speech FROM t",
)
def speech_mask(spark, sf):
    """Frames near the day's loudest, widened by four on either side."""
    keys = Window.partitionBy("channel", "day")
    hit = (F.col("score") >= 0.4 * F.max("score").over(keys)).cast("int")
    return _days(spark, sf).withColumn("hit", hit).select("event_id", F.max("hit").over(keys.orderBy("n").rowsBetween(-4, 4)).alias("speech"))
