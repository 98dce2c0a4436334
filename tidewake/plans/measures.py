"""Measures of enhanced speech, fits at a lag, probes, lost chunks, recurrences and whole configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import config
from tidewake.operators import folds, signal
from tidewake.plans.folding import _BUSY_MS, _dated
from tidewake.plans.registry import query
from tidewake.plans.signals import CLIPS_SQL, PAIRS_SQL, _clips, _pairs
from tidewake.sources.domain import SAMPLES_SQL, samples, table


@query(
    "speech_metrics",
    f"""WITH {PAIRS_SQL}, s AS (SELECT vec_id, x AS r, 0.9 * x + 0.1 * y AS e, x + 0.5 * y AS z, abs(x) >= 0.05 AS speech, n >= 48 AS tail FROM p),
 a AS (SELECT vec_id, count(*) FILTER (WHERE speech) AS n, sum(r * r) FILTER (WHERE speech) AS rr, sum((e - r) * (e - r)) FILTER (WHERE speech) AS er, sum((z - r) * (z - r)) FILTER (WHERE speech) AS zr, sqrt(avg(e * e) FILTER (WHERE speech)) AS loud, sqrt(avg(r * r) FILTER (WHERE speech)) AS meant,
 regr_slope(e, r) FILTER (WHERE speech) AS slope, regr_sxx(e, r) FILTER (WHERE speech) AS srr, regr_syy(e, r) FILTER (WHERE speech) AS see, regr_sxy(e, r) FILTER (WHERE speech) AS sre, coalesce(sqrt(avg(e * e) FILTER (WHERE tail AND NOT speech)), 0) AS quiet FROM s GROUP BY 1)
 SELECT vec_id, n AS speech_samples, round(10 * log10(rr / greatest(er, 1e-30)), 5) AS snr, round(10 * log10(rr / greatest(zr, 1e-30)), 5) AS input_snr, round(10 * log10(greatest(zr, 1e-30) / greatest(er, 1e-30)), 5) AS gained,
 round(10 * log10(greatest(slope * slope * srr, 1e-30) / greatest(see - slope * sre, 1e-30)), 4) AS si_sdr, round(20 * log10(greatest(loud, 1e-12) / greatest(meant, 1e-12)), 5) AS rms_change, round(20 * log10(greatest(abs(slope), 1e-12)), 5) AS projected_gain, round(20 * log10(greatest(quiet, 1e-12)), 5) AS quiet_tail FROM a WHERE n > 2 AND rr > 0""",
)
def speech_metrics(spark, sf):
    """What an enhanced clip gains within speech, and how loud its quiet tail is. Clips with two samples of speech or fewer aren't measured."""
    pairs = _pairs(spark, sf).select("vec_id", F.posexplode(F.arrays_zip("x", "y")).alias("n", "s")).select("vec_id", "n", F.col("s.x").alias("r"), F.col("s.y").alias("y"))
    rows = pairs.select("vec_id", "r", (0.9 * F.col("r") + 0.1 * F.col("y")).alias("e"), (F.col("r") + 0.5 * F.col("y")).alias("z"), (F.abs("r") >= 0.05).alias("speech"), (F.col("n") >= 48).alias("tail"))
    found = signal.speech_metrics(rows, "vec_id").where("speech_samples > 2")
    return found.select("vec_id", "speech_samples", *[F.round(c, 4 if c == "si_sdr" else 5).alias(c) for c in found.columns[2:]])


@query(
    "activity_fit",
    f"""WITH {CLIPS_SQL}, p AS (SELECT a.vec_id, a.vec_id % 7 - 3 AS lag, a.x, b.x AS y FROM clips a JOIN clips b ON b.vec_id = a.vec_id + 1 AND b.n = a.n + a.vec_id % 7 - 3),
 a AS (SELECT vec_id, lag, count(*) AS n, regr_slope(y, x) AS gain, regr_intercept(y, x) AS shift, corr(y, x) AS pearson, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS rest, sum(y * y) AS yy, sum(x * x) AS xx FROM p GROUP BY 1, 2)
 SELECT vec_id, CAST(lag AS BIGINT) AS lag, n, round(pearson, 6) AS pearson, round(20 * log10(greatest(abs(gain), 1e-15)), 4) AS gain_db, round(shift, 6) AS shift, round(10 * log10(rest / yy), 4) AS rest_over_output_db, round(10 * log10(rest / xx), 4) AS rest_over_input_db FROM a""",
)
def activity_fit(spark, sf):
    """Least squares of a clip and the next one at a lag, over the samples that both have: gain, shift and what stays unexplained."""
    lag = (F.col("vec_id") % 7 - 3).cast("int")
    kept = F.size("x") - F.abs(lag)
    at = _pairs(spark, sf).select("vec_id", lag.cast("long").alias("lag"), F.slice("x", F.greatest(F.lit(1), 1 - lag), kept).alias("x"), F.slice("y", F.greatest(F.lit(1), 1 + lag), kept).alias("y"))
    return at.select("vec_id", "lag", signal.fit(F.col("x"), F.col("y")).alias("f")).select(
        "vec_id", "lag", F.col("f.n").alias("n"), F.round("f.pearson", 6).alias("pearson"), F.round("f.gain_db", 4).alias("gain_db"), F.round("f.shift", 6).alias("shift"),
        F.round("f.rest_over_output_db", 4).alias("rest_over_output_db"), F.round("f.rest_over_input_db", 4).alias("rest_over_input_db"),
    )


@query(
    "probe_report",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT slot, start_ms, k * 37 % 256 AS b FROM samples), a AS (SELECT slot, count(*) AS n, count(*) FILTER (WHERE b <= 3 OR b >= 252) AS edges, CAST(sum(b) AS BIGINT) AS checksum, (max(start_ms) - min(start_ms)) / CAST(1000 AS DOUBLE) AS seconds FROM b GROUP BY 1)
 SELECT slot, n // 2 AS iq_samples, edges, checksum, round(edges / CAST(n AS DOUBLE), 9) AS edge_share, round(n // 2 / seconds, 9) AS per_second, round(n // 2 / seconds / 2400000, 15) AS real_time FROM a""",
)
def probe_report(spark, sf):
    """Bytes of a probe: pairs, clipped bytes, their share, throughput and its ratio to the receiver's rate."""
    rows = samples(spark, sf).select("slot", "start_ms", (F.col("k") * 37 % 256).alias("b"))
    sums = rows.groupBy("slot").agg(F.count("*").alias("n"), F.count_if((F.col("b") <= 3) | (F.col("b") >= 252)).alias("edges"), F.sum("b").alias("checksum"), ((F.max("start_ms") - F.min("start_ms")) / 1000).alias("seconds"))
    pairs = F.floor(F.col("n") / 2)
    return sums.select("slot", pairs.alias("iq_samples"), "edges", "checksum", F.round(F.col("edges") / F.col("n"), 9).alias("edge_share"), F.round(pairs / F.col("seconds"), 9).alias("per_second"), F.round(pairs / F.col("seconds") / 2_400_000, 15).alias("real_time"))


@query(
    "drop_counters",
    f"""WITH RECURSIVE {SAMPLES_SQL}, c AS (SELECT slot, start_ms // 86400000 AS day, start_ms AS t, bytes, row_number() OVER (PARTITION BY slot, start_ms // 86400000 ORDER BY start_ms, event_id) AS n FROM samples),
 w AS (SELECT slot, day, n, bytes, t + {_BUSY_MS} AS free_at, false AS waits, 0 AS lost, CAST(0 AS BIGINT) AS lost_bytes FROM c WHERE n = 1
 UNION ALL SELECT slot, day, n, bytes, CASE WHEN f <= t THEN t + {_BUSY_MS} ELSE f END, f > t, CASE WHEN f > t AND p THEN 1 ELSE 0 END, CASE WHEN f > t AND p THEN before ELSE 0 END FROM (
 SELECT c.*, w.bytes AS before, CASE WHEN w.waits AND w.free_at <= c.t THEN w.free_at + {_BUSY_MS} ELSE w.free_at END AS f, w.waits AND w.free_at > c.t AS p FROM w JOIN c ON c.slot = w.slot AND c.day = w.day AND c.n = w.n + 1))
 SELECT slot, day, count(*) AS chunks, CAST(sum(lost) AS BIGINT) AS dropped, CAST(sum(lost_bytes) AS BIGINT) AS dropped_bytes FROM w GROUP BY 1, 2""",
)
def drop_counters(spark, sf):
    """Chunks that were replaced while they waited, and their bytes, by slot and day."""
    rows = _dated(spark, sf).select("slot", "day", "start_ms", "event_id", "bytes")
    seen = folds.fold_sorted(rows, ["slot", "day"], ["start_ms", "event_id"], ["slot", "day"], folds.lost_chunks(_BUSY_MS), "slot string, day long, lost long, lost_bytes long")
    return seen.groupBy("slot", "day").agg(F.count("*").alias("chunks"), F.sum("lost").alias("dropped"), F.sum("lost_bytes").alias("dropped_bytes"))


@query(
    "recurrences",
    f"""WITH RECURSIVE {CLIPS_SQL}, w AS (SELECT vec_id, n, 0.005 * abs(x) AS noise, 0.3 * abs(x) AS level, CAST(CASE WHEN x > 0 THEN 0.18 ELSE 0 END AS DOUBLE) AS gain, 0.25 * x AS emphasis FROM clips WHERE n = 0
 UNION ALL SELECT c.vec_id, c.n, 0.995 * noise + 0.005 * abs(c.x), 0.7 * level + 0.3 * abs(c.x), gain + ((CASE WHEN c.x > 0 THEN 1 ELSE 0 END) - gain) * (CASE WHEN c.x > 0 THEN 0.18 ELSE 0.08 END), emphasis + 0.25 * (c.x - emphasis) FROM w JOIN clips c ON c.vec_id = w.vec_id AND c.n = w.n + 1)
 SELECT vec_id, round(max_by(noise, n), 9) AS noise, round(max_by(level, n), 9) AS level, round(max_by(gain, n), 9) AS gain, round(max_by(emphasis, n), 9) AS emphasis FROM w GROUP BY 1""",
)
def recurrences(spark, sf):
    """First-order recurrences along each whole clip, from 0: noise floor, level, a gain that opens faster than it closes, de-emphasis."""
    x, opened = F.col("x"), F.transform("x", lambda v: (v > 0).cast("double"))
    each = {"noise": signal.follow(F.transform(x, F.abs), 0.005), "level": signal.follow(F.transform(x, F.abs), 0.3), "gain": signal.follow(opened, 0.18, 0.08), "emphasis": signal.follow(x, 0.25)}
    return _clips(spark, sf).where(F.size("x") > 0).select("vec_id", *[F.round(c, 9).alias(n) for n, c in each.items()])


_CONFIG = """concat('{"enabled": ', CASE k % 4 WHEN 0 THEN 'false' WHEN 1 THEN '"false"' ELSE 'true' END, ', "manageReceiverOwnership": ', CASE k % 3 WHEN 0 THEN 'true' ELSE '1' END, ', "receiverOwner": "', CASE k % 2 WHEN 0 THEN 'vhf' ELSE 'x' END,
 '", "receiverMode": "', CASE k % 3 WHEN 0 THEN 'rtl_fm' WHEN 1 THEN 'demo' ELSE '?' END, '", "channelRegion": "', CASE k % 3 WHEN 0 THEN 'CA' ELSE 'EU' END, '", "initialChannel": ', CASE k % 3 WHEN 0 THEN '"22a"' WHEN 1 THEN '6' ELSE 'null' END,
 ', "slotAMode": "scan", "device": "', CASE k % 2 WHEN 0 THEN '  ' ELSE ' 3 ' END, '", "ppm": ', CASE k % 4 WHEN 0 THEN '"-7.5"' WHEN 1 THEN '900' WHEN 2 THEN 'null' ELSE '"none"' END, CASE k % 4 WHEN 0 THEN ', "gainDb": ""' WHEN 1 THEN ', "gainDb": 77' WHEN 2 THEN ', "gainDb": "28.5"' ELSE '' END,
 ', "squelch": ', k * 2, '.9, "sampleRate": ', CASE k % 2 WHEN 0 THEN '"24000"' ELSE '11025' END, ', "replayMinutes": ', CASE k % 3 WHEN 0 THEN 120 ELSE k * 30 END, ', "segmentSeconds": ', k % 9, ', "maxBufferMiB": ', CASE k % 3 WHEN 0 THEN 256 ELSE k * 9 END,
 ', "dscRetentionHours": true, "maxDscMessages": ', k * 12, '}')"""


@query(
    "config_fields",
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
 SELECT event_id, k % 4 <> 0 AS enabled, k % 3 = 0 AS "manageReceiverOwnership", CASE k % 2 WHEN 0 THEN 'vhf' ELSE 'ais' END AS "receiverOwner", CASE k % 3 WHEN 0 THEN 'rtl_sdr' ELSE 'demo' END AS "receiverMode", CASE k % 3 WHEN 0 THEN 'CA' ELSE 'US_CA' END AS "channelRegion",
 CASE k % 3 WHEN 0 THEN '22A' WHEN 1 THEN '6' ELSE '16' END AS "initialChannel", 'scan' AS "slotAMode", 'fixed' AS "slotBMode", '70' AS "slotBChannel", CASE k % 2 WHEN 0 THEN '0' ELSE '3' END AS device, 'bin/sidecar' AS "sidecarPath", CAST(CASE k % 4 WHEN 0 THEN -7 WHEN 1 THEN 150 ELSE 0 END AS BIGINT) AS ppm,
 CAST(CASE k % 4 WHEN 1 THEN 49.6 WHEN 2 THEN 28.5 END AS DOUBLE) AS "gainDb", CAST(CASE k % 2 WHEN 0 THEN 24000 ELSE 16000 END AS BIGINT) AS "sampleRate", least(100, k * 2) AS squelch, CASE WHEN k % 3 = 0 OR k = 4 THEN 1440 ELSE least(1440, greatest(1, k * 30)) END AS "replayMinutes",
 CASE k % 9 WHEN 5 THEN 60 ELSE greatest(2, k % 9) END AS "segmentSeconds", CASE k % 3 WHEN 0 THEN 750 ELSE least(750, greatest(16, k * 9)) END AS "maxBufferMiB", CAST(1 AS BIGINT) AS "dscRetentionHours", least(1000, greatest(10, k * 12)) AS "maxDscMessages", CAST(256 AS BIGINT) AS "maxDscCacheKiB" FROM e""",
)
def config_fields(spark, sf):
    """All fields of configurations as stored, brought to what is allowed."""
    stored = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).select("event_id", F.expr(_CONFIG).alias("t"))
    known = F.array(*map(F.lit, ("6", "16", "22A", "70")))
    return stored.select("event_id", config.configuration(F.col("t"), known, "bin/sidecar").alias("c")).select("event_id", "c.*")
