"""Recursions along a day's rows, and settings as they are stored."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewake.functions import stored
from tidewake.operators import folds, playback, signal
from tidewake.plans.registry import query
from tidewake.plans.signals import CLIPS_SQL, DAYS_SQL, _clips
from tidewake.sources.domain import SAMPLES_SQL, samples

_BUSY_MS = 600_000
_RATE = 16_000
_HIGH, _LOW = 1 / (1 + 2 * math.pi * 250 / _RATE), 1 / (1 + _RATE / (2 * math.pi * 3200))


def _dated(spark, sf):
    return samples(spark, sf).withColumn("day", F.floor(F.col("start_ms") / 86_400_000))


@query(
    "strong_gain",
    f"""WITH RECURSIVE {DAYS_SQL}, l AS (SELECT channel, day, n, event_id, score / 1000 AS level FROM d),
 w AS (SELECT channel, day, n, event_id, level, least(CAST(0.012 AS DOUBLE), greatest(level, CAST(1 AS DOUBLE) / 32768)) AS floor FROM l WHERE n = 1
 UNION ALL SELECT l.channel, l.day, l.n, l.event_id, l.level, CASE WHEN l.level < w.floor THEN w.floor * CAST(0.8 AS DOUBLE) + l.level * CAST(0.2 AS DOUBLE) ELSE least(CAST(0.012 AS DOUBLE), w.floor * CAST(0.995 AS DOUBLE) + l.level * CAST(0.005 AS DOUBLE)) END
 FROM w JOIN l ON l.channel = w.channel AND l.day = w.day AND l.n = w.n + 1)
 SELECT event_id, round(floor, 9) AS floor, round(least(CAST(1 AS DOUBLE), greatest(CAST(0.16 AS DOUBLE), CAST(0.16 AS DOUBLE) + (level / greatest(floor, CAST(1 AS DOUBLE) / 32768) - CAST(1.25 AS DOUBLE)) / CAST(1.25 AS DOUBLE) * CAST(0.84 AS DOUBLE))), 6) AS gain FROM w""",
)
def strong_gain(spark, sf):
    """Gain above a noise floor that falls quickly and rises slowly."""
    rows = _dated(spark, sf).select("channel", "day", "start_ms", "event_id", (F.col("score") / 1000).alias("level"))
    found = folds.fold_days(rows, ["channel", "day"], ["start_ms", "event_id"], folds.strong_gain, "event_id long, floor double, gain double")
    return found.select("event_id", F.round("floor", 9).alias("floor"), F.round("gain", 6).alias("gain"))


@query(
    "newest_wins",
    f"""WITH RECURSIVE {SAMPLES_SQL}, c AS (SELECT slot, start_ms // 86400000 AS day, start_ms, event_id, row_number() OVER (PARTITION BY slot, start_ms // 86400000 ORDER BY start_ms, event_id) AS n FROM samples),
 w AS (SELECT slot, day, n, event_id, start_ms + {_BUSY_MS} AS free_at, false AS waits, 0 AS dropped FROM c WHERE n = 1
 UNION ALL SELECT slot, day, n, event_id, CASE WHEN f <= t THEN t + {_BUSY_MS} ELSE f END, f > t, CASE WHEN f > t AND p THEN 1 ELSE 0 END FROM (
 SELECT c.slot, c.day, c.n, c.event_id, c.start_ms AS t, CASE WHEN w.waits AND w.free_at <= c.start_ms THEN w.free_at + {_BUSY_MS} ELSE w.free_at END AS f, w.waits AND w.free_at > c.start_ms AS p FROM w JOIN c ON c.slot = w.slot AND c.day = w.day AND c.n = w.n + 1))
 SELECT event_id, CAST(dropped AS INTEGER) AS dropped, CAST(free_at AS BIGINT) AS free_at FROM w""",
)
def newest_wins(spark, sf):
    """Which arrivals push out a waiting chunk, if a worker is busy for ten minutes with each."""
    rows = _dated(spark, sf).select("slot", "day", "start_ms", "event_id")
    return folds.fold_days(rows, ["slot", "day"], ["start_ms", "event_id"], folds.newest_wins(_BUSY_MS), "event_id long, dropped int, free_at long")


@query("scan_retarget")
def scan_retarget(spark, sf):
    """The channel that each row's slot is on after it; both slots of a day are scanned together."""
    rows = _dated(spark, sf).select("slot", "day", "start_ms", "event_id", "channel", "score", (F.col("k") % 3 == 0).alias("locked"))
    return folds.fold_days(rows, ["day"], ["start_ms", "event_id"], folds.retarget, "event_id long, target string")


@query(
    "stored_settings",
    f"WITH {SAMPLES_SQL} SELECT event_id, CAST(k % 2 = 0 AS INTEGER) AS enabled, channel AS model, CAST(CASE WHEN k BETWEEN 1 AND 16 THEN k ELSE 2 END AS INTEGER) AS threads, CAST(CASE WHEN k <= 10 THEN k ELSE 2 END AS DOUBLE) AS overlap_seconds FROM samples WHERE k % 5 <> 0 UNION ALL SELECT event_id, 0, 'base.en-q5_1', 2, CAST(2 AS DOUBLE) FROM samples WHERE k % 5 = 0",
)
def stored_settings(spark, sf):
    """Settings of each row's stored text; every fifth text is cut off and gives the defaults."""
    rows = samples(spark, sf)
    whole = F.to_json(F.struct((F.col("k") % 2 == 0).alias("enabled"), F.col("channel").alias("model"), F.col("k").alias("threads"), F.col("k").alias("overlapSeconds")))
    text = F.when(F.col("k") % 5 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    read = rows.select("event_id", stored.settings(text, overlap=2, batch_seconds=20).alias("s"))
    return read.select("event_id", F.col("s.enabled").cast("int").alias("enabled"), "s.model", "s.threads", "s.overlap_seconds")


@query(
    "playback_clean",
    f"""WITH RECURSIVE {CLIPS_SQL}, c AS (SELECT CAST({_HIGH!r} AS DOUBLE) AS hi, CAST({_LOW!r} AS DOUBLE) AS lo),
 w AS (SELECT vec_id, n, x, hi * x AS h1, hi * hi * x AS h2, lo * hi * hi * x AS l1, lo * lo * hi * hi * x AS l2 FROM clips, c WHERE n = 0
 UNION ALL SELECT vec_id, n, x, h1, h2, l1, p2 + lo * (l1 - p2) FROM (SELECT *, p1 + lo * (h2 - p1) AS l1 FROM (SELECT *, hi * (q2 + h1 - q1) AS h2 FROM (
 SELECT clips.vec_id, clips.n, clips.x, hi, lo, w.h1 AS q1, w.h2 AS q2, w.l1 AS p1, w.l2 AS p2, hi * (w.h1 + clips.x - w.x) AS h1 FROM w JOIN clips ON clips.vec_id = w.vec_id AND clips.n = w.n + 1, c))))
 SELECT vec_id, round(sum(abs(least(CAST(1 AS DOUBLE), greatest(CAST(-1 AS DOUBLE), l2 * CAST(1.2 AS DOUBLE))))), 6) AS loudness FROM w GROUP BY 1""",
)
def playback_clean(spark, sf):
    """How loud each clip is behind the voice filters."""
    heard = playback.clean(_clips(spark, sf), "x", _RATE, "voice")
    return heard.select("vec_id", F.round(signal.total(F.transform("x", lambda v: F.abs(v))), 6).alias("loudness"))
