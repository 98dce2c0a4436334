"""Frames and files, recurrences and spectra, and smaller aggregates over samples and archives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewake.operators import gates
from tidewake.plans.registry import query
from tidewake.plans.signals import CLIPS_SQL, _clips
from tidewake.sources import frames
from tidewake.sources.domain import SAMPLES_SQL, SPANS_SQL, samples, spans, table

OPEN_SQL = "(noise IS NULL OR noise < CAST(0.22 AS DOUBLE))"
ACTIVE_SQL = "(noise IS NOT NULL AND noise < CAST(0.22 AS DOUBLE))"


def _in_chunks(rows):
    """``rows``: stream, event_id, f. A stream's bytes in order, in chunks of 37 that end anywhere."""
    return frames.chunked(rows, ["event_id"], "f", 37)


@query("tlv_frames", f"WITH {SAMPLES_SQL} SELECT user_id * 100000 + start_ms // 86400000 AS stream, k % 6 + 1 AS kind, count(*) AS frames, CAST(sum(strlen(concat('payload ', event_id))) AS BIGINT) AS bytes FROM samples GROUP BY 1, 2")
def tlv_frames(spark, sf):
    """Events as frames of their user's stream of a day, cut into chunks of 37 bytes anywhere, and found again."""
    stream = F.col("user_id") * 100_000 + F.floor(F.col("start_ms") / 86_400_000)
    rows = samples(spark, sf).select(stream.alias("stream"), "event_id", frames.frame(F.col("k") % 6 + 1, F.concat(F.lit("payload "), F.col("event_id").cast("string")).cast("binary")).alias("f"))
    return frames.deframe(_in_chunks(rows)).groupBy("stream", F.col("kind").cast("long").alias("kind")).agg(F.count("*").alias("frames"), F.sum(F.octet_length("payload")).alias("bytes"))


@query("wav_files", f"WITH {CLIPS_SQL}, b AS (SELECT vec_id, CAST(count(*) AS BIGINT) AS n FROM clips GROUP BY 1) SELECT vec_id, 44 + 2 * n AS bytes, 16000 AS rate, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS canonical FROM b")
def wav_files(spark, sf):
    """Clips written as WAV bytes; every third loses its last byte and fails the check."""
    level = lambda x: F.pmod(F.bround(x * 32767).cast("long"), F.lit(65536))
    pcm = F.unhex(F.array_join(F.transform("x", lambda x: F.hex(frames.little_endian(level(x), 2))), ""))
    rows = _clips(spark, sf).select("vec_id", frames.wav(pcm, 16_000).alias("w"))
    whole = F.when(F.col("vec_id") % 3 == 0, F.substring("w", F.lit(1), F.octet_length("w") - 1)).otherwise(F.col("w"))
    return rows.select("vec_id", F.octet_length("w").cast("long").alias("bytes"), frames.number(F.col("w"), 24, 4).cast("int").alias("rate"), frames.canonical_wav(whole, 16_000).cast("int").alias("canonical"))


@query("state_json", f"WITH {SAMPLES_SQL} SELECT event_id, CASE WHEN k % 2 = 0 THEN score END AS score, k FROM samples")
def state_json(spark, sf):
    """Receiver states as JSON with a map from frequency text to score, looked up again."""
    text = F.to_json(F.struct(F.col("k"), F.when(F.col("k") % 2 == 0, F.create_map(F.lit("156800000"), F.col("score"))).alias("activity")))
    rows = samples(spark, sf).select("event_id", F.from_json(text, "k BIGINT, activity MAP<STRING, DOUBLE>").alias("s"))
    return rows.select("event_id", F.try_element_at("s.activity", F.lit("156800000")).alias("score"), F.col("s.k").alias("k"))


@query("synthetic_tone", "SELECT n, round(CASE WHEN n // 8000 % 8 < 2 THEN 3500 * (sin(2 * pi() * 440 * n / 8000) + 0.35 * sin(2 * pi() * 660 * n / 8000)) ELSE 0 END, 4) + 0.0 AS x FROM range(0, 64000) AS r(n)")
def synthetic_tone(spark, sf):
    """Two tones, two seconds of every eight."""
    wave = lambda hz: F.sin(2 * F.pi() * hz * F.col("id") / 8000)
    on = F.floor(F.col("id") / 8000) % 8 < 2
    return spark.range(0, 64_000).select(F.col("id"), F.round(F.when(on, 3500 * (wave(440) + 0.35 * wave(660))).otherwise(0.0), 4) + 0.0).toDF("n", "x")


@query(
    "ema_levels",
    f"""WITH RECURSIVE {CLIPS_SQL}, w AS (SELECT vec_id, n, abs(x) AS level FROM clips WHERE n = 0 UNION ALL SELECT c.vec_id, c.n, CASE WHEN abs(c.x) < w.level THEN 0.82 * w.level + 0.18 * abs(c.x) ELSE 0.92 * w.level + 0.08 * abs(c.x) END FROM w JOIN clips c ON c.vec_id = w.vec_id AND c.n = w.n + 1)
 SELECT vec_id, round(level, 8) AS level FROM w WHERE n = 63""",
)
def ema_levels(spark, sf):
    """A level that follows falls faster than rises: each step needs the one before, so a clip is folded."""
    def step(s, x):
        return F.when(F.abs(x) < s, 0.82 * s + 0.18 * F.abs(x)).otherwise(0.92 * s + 0.08 * F.abs(x))

    last = F.aggregate(F.slice("x", 2, 63), F.abs(F.get("x", F.lit(0))), step)
    return _clips(spark, sf).where(F.size("x") == 64).select("vec_id", F.round(last, 8).alias("level"))


@query(
    "fft_bands",
    f"""WITH {CLIPS_SQL}, f AS (SELECT vec_id, b, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * cos(2 * pi() * b * n / 64)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * sin(2 * pi() * b * n / 64)), 2) AS p FROM clips, range(2, 22) AS r(b) GROUP BY 1, 2)
 SELECT vec_id, round((avg(p) FILTER (WHERE b BETWEEN 3 AND 9)) / (avg(p) FILTER (WHERE b BETWEEN 12 AND 20)), 5) AS snr FROM f GROUP BY 1""",
)
def fft_bands(spark, sf):
    """Mean power of a signal band against a noise band of each windowed clip."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 63)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                p = np.abs(np.fft.rfft(np.asarray(v.values, dtype=float) * window)) ** 2
                out.append(float(p[3:10].mean() / p[12:21].mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["vec_id", "snr"])

    rows = _clips(spark, sf).where(F.size("x") == 64).mapInArrow(run, "vec_id long, snr double")
    return rows.select("vec_id", F.round("snr", 5).alias("snr"))


@query("weighted_noise", f"WITH {SPANS_SQL} SELECT channel, hour, CAST(sum(bytes * CAST(round(noise * 20000) AS BIGINT)) AS DOUBLE) / CAST(sum(CASE WHEN noise IS NOT NULL THEN bytes END) AS DOUBLE) AS mean_noise, min(noise) AS least_noise, CAST(sum(CASE WHEN {ACTIVE_SQL} THEN bytes ELSE 0 END) AS BIGINT) AS active_bytes, CAST(sum(bytes) AS BIGINT) AS bytes FROM spans GROUP BY 1, 2")
def weighted_noise(spark, sf):
    """A segment's noise by bytes (in whole steps of 1/20000, so sums are exact), its least measured one, and how much of it is active."""
    active = gates.active_for_transcription(F.col("noise"), gates.threshold(F.lit(20)))
    known = F.when(F.col("noise").isNotNull(), F.col("bytes"))
    return spans(spark, sf).groupBy("channel", "hour").agg((F.sum(F.col("bytes") * F.round(F.col("noise") * 20_000).cast("long")) / F.sum(known)).alias("mean_noise"), F.min("noise").alias("least_noise"), F.sum(F.when(active, F.col("bytes")).otherwise(0)).alias("active_bytes"), F.sum("bytes").alias("bytes"))


@query("spectrum_seconds", f"WITH {SAMPLES_SQL} SELECT channel, start_ms // 60000 AS minute, round(avg(greatest(0, score - 1)), 9) AS activity, count(*) AS frames FROM samples GROUP BY 1, 2")
def spectrum_seconds(spark, sf):
    """Mean activity of each channel in tumbling minutes."""
    return samples(spark, sf).groupBy("channel", F.floor(F.col("start_ms") / 60_000).alias("minute")).agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("score") - 1)), 9).alias("activity"), F.count("*").alias("frames"))


@query("level_summary", f"WITH {SAMPLES_SQL} SELECT channel, round(sqrt(avg(score * score)), 9) AS whole, round(sqrt(avg(score * score) FILTER (WHERE {OPEN_SQL})), 9) AS inside, round(CASE WHEN count(*) FILTER (WHERE NOT {OPEN_SQL}) >= 10 THEN sqrt(avg(score * score) FILTER (WHERE NOT {OPEN_SQL})) END, 9) AS outside FROM samples GROUP BY 1")
def level_summary(spark, sf):
    is_open = gates.open_for_playback(F.col("noise"), gates.threshold(F.lit(20)))
    rms = lambda keep: F.sqrt(F.avg(F.when(keep, F.col("score") * F.col("score"))))
    rows = samples(spark, sf).withColumn("open", is_open)
    return rows.groupBy("channel").agg(F.round(rms(F.lit(True)), 9).alias("whole"), F.round(rms(F.col("open")), 9).alias("inside"), F.round(F.when(F.count_if(~F.col("open")) >= 10, rms(~F.col("open"))), 9).alias("outside"))


@query("edge_fraction", f"WITH {SAMPLES_SQL} SELECT slot, count(*) AS n, count(*) FILTER (WHERE k <= 3 OR k >= 96) AS edges, round(count(*) FILTER (WHERE k <= 3 OR k >= 96) / CAST(count(*) AS DOUBLE), 9) AS share FROM samples GROUP BY 1")
def edge_fraction(spark, sf):
    edge = (F.col("k") <= 3) | (F.col("k") >= 96)
    return samples(spark, sf).groupBy("slot").agg(F.count("*").alias("n"), F.count_if(edge).alias("edges")).withColumn("share", F.round(F.col("edges") / F.col("n"), 9))


@query("row_tallies", f"WITH {SAMPLES_SQL} SELECT channel, count(*) FILTER (WHERE k % 5 IN (0, 1)) AS speech, count(*) FILTER (WHERE k % 5 = 2) AS no_speech, count(*) FILTER (WHERE k % 5 = 3) AS vad_errors, count(*) FILTER (WHERE k % 5 = 4) AS record_errors FROM samples GROUP BY 1")
def row_tallies(spark, sf):
    n = lambda *of: F.count_if((F.col("k") % 5).isin(*of))
    return samples(spark, sf).groupBy("channel").agg(n(0, 1).alias("speech"), n(2).alias("no_speech"), n(3).alias("vad_errors"), n(4).alias("record_errors"))


@query("orphan_payloads", "SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def orphan_payloads(spark, sf):
    """Payloads that the manifest doesn't list."""
    listed = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(listed, "doc_id", "left_anti")


@query("delete_by_id", f"WITH {SAMPLES_SQL} SELECT event_id, channel FROM samples WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_id(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return samples(spark, sf).select("event_id", "channel").join(gone, "event_id", "left_anti")


@query("record_eligibility", f"WITH {SAMPLES_SQL}, c AS (SELECT *, CASE WHEN dur_ms >= 30000 THEN 'long' WHEN dur_ms BETWEEN 8000 AND 25000 THEN 'short' END AS class FROM samples WHERE dur_ms >= 8000 AND channel <> 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY channel, class ORDER BY start_ms, event_id) AS rn FROM c WHERE class IS NOT NULL) SELECT channel, class, event_id FROM r WHERE rn = 1")
def record_eligibility(spark, sf):
    """Each channel's first long and first short record; which is first is an aggregate, not a sort."""
    kind = F.when(F.col("dur_ms") >= 30_000, "long").when(F.col("dur_ms").between(8000, 25_000), "short")
    rows = samples(spark, sf).where("dur_ms >= 8000 and channel <> 'error'").withColumn("class", kind).where("class is not null")
    return rows.groupBy("channel", "class").agg(F.min_by("event_id", F.struct("start_ms", "event_id")).alias("event_id"))


@query("log_tail", "SELECT page_id, CASE WHEN contains(url, 'm.') THEN url WHEN contains(url, '?') THEN split_part(url, '?', 2) ELSE split_part(url, '/', 3) END AS line FROM pages")
def log_tail(spark, sf):
    """The most telling part of each line: a claimed device first, else the last cause, else the host."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.when(url.contains("m."), url).when(url.contains("?"), F.split_part(url, F.lit("?"), F.lit(2))).otherwise(F.split_part(url, F.lit("/"), F.lit(3))).alias("line"))
