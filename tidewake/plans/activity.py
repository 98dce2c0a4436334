"""Gates, bins, sessions, gaps and slices over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators import batches, gates, sessions
from tidewake.operators.ordered import with_previous, with_running_sum
from tidewake.plans.registry import query
from tidewake.sources.domain import SAMPLES_SQL, SPANS_SQL, samples, spans

KEYS = ["channel", "hour"]
SQUELCH = 20


@query(
    "squelch_gate",
    f"WITH {SAMPLES_SQL} SELECT event_id, k AS squelch, CASE WHEN k > 0 THEN round(greatest(0.04, CAST(0.38 AS DOUBLE) - CAST(0.008 AS DOUBLE) * k), 9) END AS gate_limit,"
    " CASE WHEN noise IS NULL OR k <= 0 OR noise < greatest(0.04, CAST(0.38 AS DOUBLE) - CAST(0.008 AS DOUBLE) * k) THEN 1 ELSE 0 END AS playback,"
    " CASE WHEN noise IS NOT NULL AND (k <= 0 OR noise < greatest(0.04, CAST(0.38 AS DOUBLE) - CAST(0.008 AS DOUBLE) * k)) THEN 1 ELSE 0 END AS transcription FROM samples",
)
def squelch_gate(spark, sf):
    limit = gates.threshold(F.col("k"))
    return samples(spark, sf).select(
        "event_id", F.col("k").alias("squelch"), F.when(F.col("k") > 0, F.round(limit, 9)).alias("gate_limit"),
        gates.open_for_playback(F.col("noise"), limit).cast("int").alias("playback"), gates.active_for_transcription(F.col("noise"), limit).cast("int").alias("transcription"),
    )


_OPEN = "(noise IS NULL OR noise < CAST(0.22 AS DOUBLE))"
RUNS_SQL = (
    SPANS_SQL
    + f""", flagged AS (SELECT *, {_OPEN} AS open FROM spans),
 stepped AS (SELECT *, CASE WHEN open <> lag(open) OVER (PARTITION BY channel, hour ORDER BY span_no) THEN 1 ELSE 0 END AS step FROM flagged),
 numbered AS (SELECT *, sum(step) OVER (PARTITION BY channel, hour ORDER BY span_no ROWS UNBOUNDED PRECEDING) AS run_no FROM stepped),
 runs AS (SELECT channel, hour, CAST(run_no AS BIGINT) AS run_no, open, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(min(byte_start) AS BIGINT) AS byte_start FROM numbered GROUP BY 1, 2, 3, 4)"""
)


def _runs(spark, sf):
    return gates.gate_runs(spans(spark, sf), KEYS, gates.open_for_playback(F.col("noise"), gates.threshold(F.lit(SQUELCH))))


@query("gate_runs", f"WITH {RUNS_SQL} SELECT channel, hour, run_no, CAST(open AS INTEGER) AS is_open, bytes, byte_start FROM runs")
def gate_runs(spark, sf):
    return _runs(spark, sf).select("channel", "hour", "run_no", F.col("open").cast("int").alias("is_open"), "bytes", "byte_start")


@query(
    "gate_hysteresis",
    f"""WITH RECURSIVE {RUNS_SQL}, ordered AS (SELECT *, lead(open) OVER (PARTITION BY channel, hour ORDER BY run_no) AS next_open FROM runs),
 walk AS (SELECT channel, hour, run_no, open, bytes, (open AND bytes >= 16000) AS gate FROM ordered WHERE run_no = 0
 UNION ALL SELECT o.channel, o.hour, o.run_no, o.open, o.bytes,
 CASE WHEN o.open THEN w.gate OR o.bytes >= 16000 ELSE w.gate AND o.bytes <= 12000 AND coalesce(o.next_open, false) END
 FROM walk w JOIN ordered o ON o.channel = w.channel AND o.hour = w.hour AND o.run_no = w.run_no + 1)
 SELECT channel, hour, run_no, bytes, CAST(gate AS INTEGER) AS gate FROM walk""",
)
def gate_hysteresis(spark, sf):
    return gates.hysteresis(_runs(spark, sf), KEYS, 16_000, 12_000).select("channel", "hour", "run_no", "bytes", F.col("gate").cast("int").alias("gate"))


#: The gate walked run by run, as it is stated: 0.2 s open it, 0.15 s may be bridged.
GATED_SQL = f"""{RUNS_SQL}, ahead AS (SELECT *, lead(open) OVER (PARTITION BY channel, hour ORDER BY run_no) AS next_open FROM runs),
 gated AS (SELECT channel, hour, run_no, open, bytes, byte_start, (open AND bytes >= 6400) AS gate FROM ahead WHERE run_no = 0
 UNION ALL SELECT o.channel, o.hour, o.run_no, o.open, o.bytes, o.byte_start,
 CASE WHEN o.open THEN w.gate OR o.bytes >= 6400 ELSE w.gate AND o.bytes <= 4800 AND coalesce(o.next_open, false) END
 FROM gated w JOIN ahead o ON o.channel = w.channel AND o.hour = w.hour AND o.run_no = w.run_no + 1)"""
BINS_SQL = (
    GATED_SQL
    + """, sized AS (SELECT *, byte_start + bytes AS byte_end, CAST(max(byte_start + bytes) OVER (PARTITION BY channel, hour) AS DOUBLE) AS total FROM gated),
 bins AS (SELECT channel, hour, bin, floor(least(1.0, sum(CASE WHEN gate
 THEN greatest(0.0, least(byte_end, (bin + 1) * (total / 48)) - greatest(byte_start, bin * (total / 48))) / (total / 48) ELSE 0.0 END)) * 1000 + 0.5) / 1000 AS activity
 FROM (SELECT *, CAST(unnest(range(CAST(floor(byte_start * 48 / total) AS BIGINT), CAST(least(47, floor((byte_end - 1) * 48 / total)) AS BIGINT) + 1)) AS BIGINT) AS bin FROM sized) GROUP BY 1, 2, 3)"""
)


def _bins(spark, sf):
    runs = gates.hysteresis(_runs(spark, sf), KEYS)
    return gates.activity_bins(runs.withColumn("byte_end", F.col("byte_start") + F.col("bytes")), KEYS, F.col("gate"))


@query("activity_bins48", f"WITH RECURSIVE {BINS_SQL} SELECT channel, hour, bin, activity FROM bins")
def activity_bins48(spark, sf):
    return _bins(spark, sf)


SPECTRUM_SQL = (
    SAMPLES_SQL
    + """, seen AS (SELECT * FROM samples WHERE score >= 2),
 marked AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY channel ORDER BY start_ms, event_id) < 900000 THEN 0 ELSE 1 END AS brk FROM seen),
 sessions AS (SELECT *, sum(brk) OVER (PARTITION BY channel ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked)"""
)


@query("spectrum_sessions", f"WITH {SPECTRUM_SQL} SELECT channel, CAST(session AS BIGINT) AS session, min(start_ms) AS started_ms, max(start_ms) + 1000 AS ended_ms, max(score) AS score, count(*) AS n FROM sessions GROUP BY 1, 2")
def spectrum_sessions(spark, sf):
    seen = samples(spark, sf).where("score >= 2")
    return sessions.keyed_sessions(seen, "channel", "start_ms", "start_ms", 900_000).groupBy("channel", "session").agg(F.min("start_ms").alias("started_ms"), (F.max("start_ms") + 1000).alias("ended_ms"), F.max("score").alias("score"), F.count("*").alias("n"))


@query(
    "spectrum_sessions_tick",
    f"""WITH {SAMPLES_SQL}, seen AS (SELECT * FROM samples WHERE score >= 2), ticks AS (SELECT DISTINCT start_ms AS tick FROM samples),
 prior AS (SELECT *, lag(start_ms) OVER (PARTITION BY channel ORDER BY start_ms, event_id) AS before FROM seen),
 closed AS (SELECT p.event_id, count(t.tick) AS n FROM prior p LEFT JOIN ticks t ON t.tick >= p.before + 900000 AND t.tick < p.start_ms GROUP BY 1),
 marked AS (SELECT p.*, CASE WHEN before IS NULL OR c.n > 0 THEN 1 ELSE 0 END AS brk FROM prior p JOIN closed c USING (event_id)),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY channel ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked)
 SELECT channel, CAST(session AS BIGINT) AS session, min(start_ms) AS started_ms, max(start_ms) + 1000 AS ended_ms, max(score) AS score FROM s GROUP BY 1, 2""",
)
def spectrum_sessions_tick(spark, sf):
    """A session closes at the first tick of any channel that comes 900 s or later after its last sight and before the next."""
    every = samples(spark, sf)
    order = ["start_ms", "event_id"]
    seen = with_previous(every.where("score >= 2").select("channel", "event_id", "start_ms", "score"), order, ["start_ms"], sessions.BUCKET_MS, keys=["channel"]).withColumnRenamed("start_ms_prev", "before")
    # the first tick at or after before + gap closes iff it comes before start: the latest tick before each row decides
    ticks = with_previous(every.select("start_ms").distinct(), ["start_ms"], ["start_ms"], sessions.BUCKET_MS).select("start_ms", F.col("start_ms_prev").alias("tick"))
    brk = F.when(F.col("before").isNull() | (F.col("tick") >= F.col("before") + 900_000), 1).otherwise(0).cast("long")
    marked = with_running_sum(seen.join(ticks, "start_ms").withColumn("brk", brk), order, "brk", "session", ["channel"])
    return marked.groupBy("channel", "session").agg(F.min("start_ms").alias("started_ms"), (F.max("start_ms") + 1000).alias("ended_ms"), F.max("score").alias("score"))


_SAME = "p_slot = slot AND p_channel = channel AND start_ms - p_end BETWEEN -60000 AND 600000"
REPLAY_SQL = (
    SAMPLES_SQL
    + f""", linked AS (SELECT *, lag(slot) OVER o AS p_slot, lag(channel) OVER o AS p_channel, lag(end_ms) OVER o AS p_end FROM samples WINDOW o AS (ORDER BY start_ms, event_id)),
 marked AS (SELECT *, CASE WHEN {_SAME} THEN 0 ELSE 1 END AS brk FROM linked),
 sessions AS (SELECT *, CAST(sum(brk) OVER (ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked)"""
)


def _replay(spark, sf):
    same = (F.col("slot_prev") == F.col("slot")) & (F.col("channel_prev") == F.col("channel")) & (F.col("start_ms") - F.col("end_ms_prev")).between(-60_000, 600_000)
    return sessions.global_sessions(samples(spark, sf), same, ["slot", "channel", "end_ms"], ["start_ms", "event_id"])


@query("replay_sessions", f"WITH {REPLAY_SQL} SELECT event_id, slot, channel, session FROM sessions")
def replay_sessions(spark, sf):
    return _replay(spark, sf).select("event_id", "slot", "channel", "session")


@query(
    "replay_session_rollup",
    f"""WITH {REPLAY_SQL} SELECT session, min(slot) AS slot, min(channel) AS channel, min(start_ms) AS started_ms, max(end_ms) AS ended_ms, CAST(sum(dur_ms) AS BIGINT) AS duration_ms,
 min(noise) AS minimum_noise, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY start_ms, event_id) AS ids, count(*) AS n,
 CAST(sum(CASE WHEN noise IS NULL OR noise < CAST(0.22 AS DOUBLE) THEN dur_ms ELSE 0 END) AS BIGINT) AS active_ms FROM sessions GROUP BY session HAVING sum(CASE WHEN noise IS NULL OR noise < CAST(0.22 AS DOUBLE) THEN dur_ms ELSE 0 END) >= 5000""",
)
def replay_session_rollup(spark, sf):
    """Sessions of both slots in one order of time, rolled up; those hardly active aren't visible."""
    active = F.sum(F.when(gates.open_for_playback(F.col("noise"), gates.threshold(F.lit(SQUELCH))), F.col("dur_ms")).otherwise(0))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "event_id"))), lambda r: r["event_id"].cast("string")), ",")
    return (
        _replay(spark, sf)
        .groupBy("session")
        .agg(F.min("slot").alias("slot"), F.min("channel").alias("channel"), F.min("start_ms").alias("started_ms"), F.max("end_ms").alias("ended_ms"), F.sum("dur_ms").alias("duration_ms"), F.min("noise").alias("minimum_noise"), ids.alias("ids"), F.count("*").alias("n"), active.alias("active_ms"))
        .where("active_ms >= 5000")
    )


QUIET_MS = 60_000
QUIET_SQL = (
    SAMPLES_SQL
    + f""", heard AS (SELECT *, list_transform(range(0, 6), lambda b: (k >> b) & 1) AS acts FROM samples),
 edged AS (SELECT *, dur_ms * CAST(CASE WHEN k & 63 = 0 THEN 6 ELSE list_position(acts, 1) - 1 END AS DOUBLE) / 6 AS quiet_before, dur_ms * CAST(CASE WHEN k & 63 = 0 THEN 6 ELSE list_position(list_reverse(acts), 1) - 1 END AS DOUBLE) / 6 AS quiet_after FROM heard),
 linked AS (SELECT *, lag(slot) OVER o AS p_slot, lag(channel) OVER o AS p_channel, lag(end_ms) OVER o AS p_end, lag(quiet_after) OVER o AS p_quiet FROM edged WINDOW o AS (ORDER BY start_ms, event_id)),
 marked AS (SELECT *, CASE WHEN {_SAME} AND p_quiet + quiet_before < {QUIET_MS} THEN 0 ELSE 1 END AS brk FROM linked),
 sessions AS (SELECT *, CAST(sum(brk) OVER (ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked)"""
)


def _quiet(spark, sf):
    bins = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda b: F.pmod(F.floor(F.col("k") / F.pow(F.lit(2), b)), F.lit(2)))
    rows = samples(spark, sf).withColumn("acts", bins)
    rows = rows.select("*", sessions.edge_quiet(F.col("acts"), F.col("dur_ms")).alias("e")).select("*", F.col("e.leading").alias("quiet_before"), F.col("e.trailing").alias("quiet_after")).drop("e")
    same = (F.col("slot_prev") == F.col("slot")) & (F.col("channel_prev") == F.col("channel")) & (F.col("start_ms") - F.col("end_ms_prev")).between(-60_000, 600_000) & (F.col("quiet_after_prev") + F.col("quiet_before") < QUIET_MS)
    return sessions.global_sessions(rows, same, ["slot", "channel", "end_ms", "quiet_after"], ["start_ms", "event_id"])


@query("replay_sessions_quiet", f"WITH {QUIET_SQL} SELECT event_id, session, round(quiet_before, 6) AS quiet_before, round(quiet_after, 6) AS quiet_after FROM sessions")
def replay_sessions_quiet(spark, sf):
    """Sessions that also break where two clips meet in a long quiet."""
    return _quiet(spark, sf).select("event_id", "session", F.round("quiet_before", 6).alias("quiet_before"), F.round("quiet_after", 6).alias("quiet_after"))


@query(
    "replay_session_details",
    f"""WITH {QUIET_SQL}, g AS (SELECT session, min_by(slot, (start_ms, event_id)) AS slot, min_by(channel, (start_ms, event_id)) AS channel, min(start_ms) AS started_ms, max_by(end_ms, (start_ms, event_id)) AS ended_ms, CAST(sum(dur_ms) AS BIGINT) AS duration_ms, min(noise) AS minimum_noise,
 flatten(list(acts ORDER BY start_ms, event_id)) AS a, min_by(event_id, (start_ms, event_id)) FILTER (WHERE k % 5 = 4) AS failed, min_by(event_id, (start_ms, event_id)) FILTER (WHERE k % 5 = 3) AS busy,
 string_agg(concat('call ', event_id), ' ' ORDER BY start_ms, event_id) FILTER (WHERE k % 5 <= 1) AS said FROM sessions GROUP BY 1)
 SELECT session, slot, channel, started_ms, ended_ms, duration_ms, minimum_noise, array_to_string(CASE WHEN len(a) <= 8 THEN a ELSE list_transform(range(0, 8), lambda i: list_max(a[CAST(floor(i * (len(a) / CAST(8 AS DOUBLE))) AS INT) + 1 : CAST(greatest(floor(i * (len(a) / CAST(8 AS DOUBLE))) + 1, ceil((i + 1) * (len(a) / CAST(8 AS DOUBLE)))) AS INT)])) END, ',') AS activity,
 CASE WHEN failed IS NOT NULL THEN 'error' WHEN busy IS NOT NULL THEN 'queued' WHEN said IS NOT NULL THEN 'complete' END AS status, CASE WHEN failed IS NOT NULL THEN CAST(failed AS VARCHAR) WHEN busy IS NOT NULL THEN CAST(busy AS VARCHAR) ELSE said END AS told FROM g""",
)
def replay_session_details(spark, sf):
    """The first clip's fields, the last one's end, joined activity in few bins, and of the transcriptions an error before what is in work before the joined texts."""
    order, state = F.struct("start_ms", "event_id"), F.col("k") % 5
    first = lambda c: F.min_by(c, order)
    joined = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda r: r["v"])
    failed, busy = (F.min(F.when(state == n, order)).getField("event_id").cast("string") for n in (4, 3))
    said = F.nullif(F.array_join(joined(F.when(state <= 1, F.struct("start_ms", "event_id", F.concat(F.lit("call "), F.col("event_id").cast("string")).alias("v")))), " "), F.lit(""))
    acts = F.flatten(joined(F.struct("start_ms", "event_id", F.col("acts").alias("v"))))
    rows = _quiet(spark, sf).groupBy("session").agg(
        first("slot").alias("slot"), first("channel").alias("channel"), F.min("start_ms").alias("started_ms"), F.max_by("end_ms", order).alias("ended_ms"), F.sum("dur_ms").alias("duration_ms"), F.min("noise").alias("minimum_noise"),
        acts.alias("acts"), failed.alias("failed"), busy.alias("busy"), said.alias("said"),
    )
    status = F.when(F.col("failed").isNotNull(), "error").when(F.col("busy").isNotNull(), "queued").when(F.col("said").isNotNull(), "complete")
    few = F.array_join(F.transform(sessions.downsampled(F.col("acts"), 8), lambda x: x.cast("string")), ",")
    return rows.select("session", "slot", "channel", "started_ms", "ended_ms", "duration_ms", "minimum_noise", few.alias("activity"), status.alias("status"), F.coalesce("failed", "busy", "said").alias("told"))


ARCHIVE_SQL = (
    f"""WITH {SAMPLES_SQL}, linked AS (SELECT s.*, CASE WHEN k % 25 = 24 THEN 8000 ELSE 16000 END AS rate, d.text, lag(channel) OVER o AS p_channel, lag(CASE WHEN k % 25 = 24 THEN 8000 ELSE 16000 END) OVER o AS p_rate, lag(end_ms) OVER o AS p_end,
  greatest(0, least(dur_ms, CASE WHEN k % 7 <> 0 THEN 100 * k - 300 ELSE 0 END)) AS quiet_to, CASE WHEN k % 6 <> 0 THEN 950 * k - 300 ELSE dur_ms END AS told_end FROM samples s LEFT JOIN documents d ON d.doc_id = s.event_id WINDOW o AS (ORDER BY start_ms, event_id)),
 marked AS (SELECT *, greatest(quiet_to, least(dur_ms, told_end)) AS active_to, CASE WHEN p_channel = channel AND p_rate = rate AND start_ms - p_end <= 900000 THEN 0 ELSE 1 END AS brk FROM linked),
 s AS (SELECT *, CAST(sum(brk) OVER (ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked)
 SELECT session, min(channel) AS channel, arg_min(start_ms + quiet_to, (start_ms, event_id)) AS started_ms, arg_max(start_ms + active_to, (start_ms, event_id)) AS ended_ms, CAST(sum(active_to - quiet_to) AS BIGINT) AS duration_ms, CAST(sum(dur_ms) AS BIGINT) AS source_ms, min(noise) AS minimum_noise,
 coalesce(string_agg(CASE WHEN trim(text) <> '' THEN trim(text) END, ' ' ORDER BY start_ms, event_id), '') AS transcript FROM s GROUP BY session"""
)


@query("archive_sessions_whole", ARCHIVE_SQL)
@query("archive_sessions", ARCHIVE_SQL)
def archive_sessions(spark, sf):
    """Neighbouring records of one channel and rate, without the quiet at either end, with what was said in them joined; negative gaps are allowed."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("event_id"), F.trim("text").alias("words"))
    k = F.col("k")
    told = sessions.trimmed(F.col("dur_ms"), F.when(k % 7 != 0, 100 * k - 300), F.when(k % 6 != 0, 950 * k - 300))
    rows = samples(spark, sf).withColumn("rate", F.when(k % 25 == 24, 8000).otherwise(16_000)).withColumn("heard", told)
    same = (F.col("channel_prev") == F.col("channel")) & (F.col("rate_prev") == F.col("rate")) & (F.col("start_ms") - F.col("end_ms_prev") <= 900_000)
    words = F.array_sort(F.collect_list(F.when(F.col("words") != "", F.struct("start_ms", "event_id", "words"))))
    order = F.struct("start_ms", "event_id")
    placed = sessions.global_sessions(rows, same, ["channel", "rate", "end_ms"], ["start_ms", "event_id"])  # without the texts, which would all go to their day's task
    return placed.join(texts, "event_id", "left").groupBy("session").agg(
        F.min("channel").alias("channel"), F.min_by(F.col("start_ms") + F.col("heard.first"), order).alias("started_ms"), F.max_by(F.col("start_ms") + F.col("heard.last"), order).alias("ended_ms"),
        F.sum(F.col("heard.last") - F.col("heard.first")).alias("duration_ms"), F.sum("dur_ms").alias("source_ms"), F.min("noise").alias("minimum_noise"), F.array_join(F.transform(words, lambda r: r["words"]), " ").alias("transcript"),
    )


@query(
    "silence_break",
    f"""WITH {SPANS_SQL}, f AS (SELECT *, {_OPEN} AS open FROM spans), i AS (SELECT *, sum(CASE WHEN open THEN 1 ELSE 0 END) OVER (PARTITION BY channel, hour ORDER BY span_no ROWS UNBOUNDED PRECEDING) AS island FROM f),
 c AS (SELECT *, sum(CASE WHEN open THEN 0 ELSE bytes END) OVER (PARTITION BY channel, hour, island ORDER BY span_no ROWS UNBOUNDED PRECEDING) AS closed FROM i)
 SELECT channel, hour, span_no, CAST(closed AS BIGINT) AS closed_bytes, CASE WHEN island > 0 AND NOT open AND closed >= 20000 AND closed - bytes < 20000 THEN 1 ELSE 0 END AS flush FROM c""",
)
def silence_break(spark, sf):
    return sessions.silence_breaks(spans(spark, sf), KEYS, gates.open_for_playback(F.col("noise"), gates.threshold(F.lit(SQUELCH))), 20_000).withColumn("flush", F.col("flush").cast("int"))


@query(
    "fixed_slices",
    f"""WITH {SPANS_SQL}, cut AS (SELECT *, CAST(unnest(range(byte_start // 30000, (byte_end - 1) // 30000 + 1)) AS BIGINT) AS slice FROM spans)
 SELECT channel, hour, slice, count(*) AS pieces, CAST(sum(least(byte_end, (slice + 1) * 30000) - greatest(byte_start, slice * 30000)) AS BIGINT) AS bytes FROM cut GROUP BY 1, 2, 3""",
)
def fixed_slices(spark, sf):
    return sessions.fixed_slices(spans(spark, sf), KEYS, 30_000).groupBy(*KEYS, "slice").agg(F.count("*").alias("pieces"), F.sum("bytes").alias("bytes"))


@query(
    "conversation_gaps",
    f"""WITH {SAMPLES_SQL}, g AS (SELECT channel, event_id, start_ms - max(end_ms) OVER (PARTITION BY channel ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_ms FROM samples)
 SELECT channel, event_id, gap_ms, CASE WHEN gap_ms < 60000 THEN concat(CAST(floor(gap_ms / 1000.0 + 0.5) AS BIGINT), ' sec') WHEN gap_ms < 3600000 THEN concat(CAST(floor(gap_ms / 60000.0 + 0.5) AS BIGINT), ' min') ELSE concat(CAST(floor(gap_ms / 3600000.0 + 0.5) AS BIGINT), ' hr') END AS label FROM g WHERE gap_ms > 0""",
)
def conversation_gaps(spark, sf):
    half_up = lambda unit, text: F.concat(F.floor(F.col("gap_ms") / unit + 0.5).cast("string"), F.lit(text))
    label = F.when(F.col("gap_ms") < 60_000, half_up(1000, " sec")).when(F.col("gap_ms") < 3_600_000, half_up(60_000, " min")).otherwise(half_up(3_600_000, " hr"))
    return sessions.quiet_gaps(samples(spark, sf), "channel").withColumn("label", label)


@query(
    "conversation_window",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT channel, min(start_ms) AS lo, max(end_ms) AS hi FROM samples GROUP BY 1),
 p AS (SELECT channel, lo - CAST(floor(greatest(30000, 0.04 * (hi - lo))) AS BIGINT) AS from_ms, hi + CAST(floor(greatest(30000, 0.04 * (hi - lo))) AS BIGINT) AS to_ms, hi FROM b)
 SELECT p.channel, from_ms, to_ms, count(s.event_id) AS n_all, count(s.event_id) FILTER (WHERE s.end_ms >= p.hi - 86400000 AND s.start_ms <= p.hi) AS n_day FROM p JOIN samples s ON s.channel = p.channel GROUP BY 1, 2, 3""",
)
def conversation_window(spark, sf):
    """Bounds of all of a channel's clips, padded, and how many lie in them and in its last day."""
    rows = samples(spark, sf)
    bounds = rows.groupBy("channel").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    pad = F.floor(F.greatest(F.lit(30_000), F.lit(0.04) * (F.col("hi") - F.col("lo")))).cast("long")
    padded = bounds.select("channel", (F.col("lo") - pad).alias("from_ms"), (F.col("hi") + pad).alias("to_ms"), "hi")
    day = (F.col("end_ms") >= F.col("hi") - 86_400_000) & (F.col("start_ms") <= F.col("hi"))
    return rows.join(padded, "channel").groupBy("channel", "from_ms", "to_ms").agg(F.count("*").alias("n_all"), F.count_if(day).alias("n_day"))


BATCH_MS = 240_000


@query(
    "transcription_batches",
    f"""WITH RECURSIVE {SAMPLES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY channel, slot ORDER BY start_ms, event_id) AS rn, lag(end_ms) OVER (PARTITION BY channel, slot ORDER BY start_ms, event_id) AS p_end FROM samples),
 w AS (SELECT channel, slot, rn, event_id, dur_ms, CAST(1 AS BIGINT) AS batch, dur_ms AS held FROM o WHERE rn = 1
 UNION ALL SELECT o.channel, o.slot, o.rn, o.event_id, o.dur_ms, CASE WHEN w.held >= {BATCH_MS} OR abs(o.start_ms - o.p_end) > 7200000 THEN w.batch + 1 ELSE w.batch END,
 CASE WHEN w.held >= {BATCH_MS} OR abs(o.start_ms - o.p_end) > 7200000 THEN o.dur_ms ELSE w.held + o.dur_ms END FROM w JOIN o ON o.channel = w.channel AND o.slot = w.slot AND o.rn = w.rn + 1)
 SELECT channel, slot, batch, count(*) AS clips, CAST(sum(dur_ms) AS BIGINT) AS duration_ms, min(event_id) AS first_id FROM w GROUP BY 1, 2, 3""",
)
def transcription_batches(spark, sf):
    """Neighbouring clips gathered until they last long enough or a gap comes: the sum starts anew at each cut."""
    order, keys = ["start_ms", "event_id"], ["channel", "slot"]
    linked = with_previous(samples(spark, sf), order, ["end_ms"], sessions.BUCKET_MS, keys=keys)
    gap = F.coalesce(F.abs(F.col("start_ms") - F.col("end_ms_prev")) > 7_200_000, F.lit(False))
    rows = with_running_sum(linked.select("*", gap.alias("gap"), F.lit(1).alias("one")), order, "one", "nth", keys).select(*keys, "nth", "event_id", "dur_ms", "gap")
    found = batches.with_batches(rows, keys, "nth", "dur_ms", "gap", BATCH_MS)
    return found.groupBy(*keys, "batch").agg(F.count("*").alias("clips"), F.sum("dur_ms").alias("duration_ms"), F.min("event_id").alias("first_id"))
