"""Log diagnostics, transcription's progress, keys of kept playback, amended archives and lists with what is new in front."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.functions import notices
from tidewake.operators.ordered import with_previous, with_running_sum, with_sums_by
from tidewake.plans.registry import query
from tidewake.sources import sinks
from tidewake.sources.domain import SAMPLES_SQL, SPANS_SQL, samples, spans, table

DAY_MS = 86_400_000
LINES = (" \r\n ", "\nusb error 5\nexit status 1", "\n usb_claim_interface error -6 \nfailed to open", "\r\nfoo lost\r\nBar DENIED\nrtl_sdr stopped: exit status 2", "\nall quiet\n\n", "\nresource is busy\nusb gone")
_CASES = " ".join(f"WHEN {n} THEN '{line}'" for n, line in enumerate(LINES)).replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")


@query(
    "log_diagnostic",
    f"""WITH t AS (SELECT doc_id, concat(coalesce(text, ''), CASE doc_id % 6 {_CASES} END) AS log FROM documents), l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(log, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM t),
 c AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '(?i){notices.CAUSE}') AND NOT regexp_matches(x, '(?i){notices.EXIT}')) AS causes FROM l), d AS (SELECT *, list_filter(causes, lambda x: regexp_matches(x, '(?i){notices.CLAIMED}')) AS claims FROM c)
 SELECT doc_id, CASE WHEN len(claims) > 0 THEN concat(right(claims[-1], 500), '{notices.IN_USE}') WHEN len(causes) > 1 THEN right(concat(right(causes[-2], 500), chr(10), right(causes[-1], 500)), 1000) WHEN len(causes) = 1 THEN right(causes[1], 500) ELSE right(lines[-1], 500) END AS told FROM d""",
)
def log_diagnostic(spark, sf):
    """Texts as logs with a receiver's last lines behind them, and what is told of them."""
    ends = F.element_at(F.array(*map(F.lit, LINES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", notices.diagnostic(F.concat(F.coalesce("text", F.lit("")), ends)).alias("told"))


@query(
    "transcription_progress",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT channel, dur_ms, start_ms // 10800000 AS batch, row_number() OVER (PARTITION BY channel, start_ms // 10800000 ORDER BY start_ms, event_id) AS nth FROM samples),
 a AS (SELECT channel, batch // 8 AS day, count(*) FILTER (WHERE nth > batch % 3 AND batch % 4 < 3) AS clips, CAST(coalesce(sum(dur_ms) FILTER (WHERE nth > batch % 3 AND batch % 4 < 3), 0) AS BIGINT) AS waiting_ms, count(*) FILTER (WHERE nth > batch % 3 AND batch % 4 = 0) AS processing FROM b GROUP BY 1, 2)
 SELECT channel, day, CASE WHEN day % 7 = 0 THEN 'Off' WHEN day % 7 = 1 THEN 'Needs attention' WHEN day % 7 = 2 THEN 'Unavailable' WHEN clips = 0 THEN 'Caught up' ELSE 'Backlog' END AS label,
 CASE WHEN day % 7 = 0 THEN 'Transcription is switched off.' WHEN day % 7 = 1 THEN concat('no model for ', channel) WHEN day % 7 = 2 THEN 'Transcription status is unavailable.' WHEN clips = 0 THEN 'No clips waiting for transcription.'
 ELSE concat(clips, CASE WHEN clips = 1 THEN ' clip' ELSE ' clips' END, ' unfinished · ', CAST(ceil(waiting_ms / 1000.0) AS BIGINT), ' s of audio', CASE WHEN processing > 0 THEN concat(' · ', processing, ' processing') ELSE ' · waiting to start' END) END AS detail FROM a""",
)
def transcription_progress(spark, sf):
    """Clips of a channel's batches of three hours that aren't done: the overlap that a batch begins with (up to two clips) was counted before."""
    batch, day = F.col("batch"), F.col("day")
    nth = F.row_number().over(Window.partitionBy("channel", "batch").orderBy("start_ms", "event_id"))
    rows = samples(spark, sf).withColumn("batch", F.floor(F.col("start_ms") / 10_800_000)).withColumn("new", nth > batch % 3)
    waiting = F.col("new") & (batch % 4 < 3)
    counts = rows.groupBy("channel", F.floor(batch / 8).alias("day")).agg(F.count_if(waiting).alias("clips"), F.coalesce(F.sum(F.when(waiting, F.col("dur_ms"))), F.lit(0)).alias("waiting_ms"), F.count_if(F.col("new") & (batch % 4 == 0)).alias("processing"))
    error = F.when(day % 7 == 1, F.concat(F.lit("no model for "), "channel"))
    told = notices.progress(day % 7 != 0, error, day % 7 != 2, F.col("clips"), F.col("waiting_ms"), F.col("processing"))
    return counts.select("channel", "day", told.alias("t")).select("channel", "day", "t.label", "t.detail")


@query(
    "cache_key",
    f"""WITH {SPANS_SQL}, s AS (SELECT channel, hour, CAST(sum(bytes // 160) AS BIGINT) AS size, string_agg(concat(bytes // 160, ':', CASE WHEN noise IS NULL THEN 'unknown' WHEN noise = 0 THEN '0' ELSE regexp_replace(CAST(CAST(CAST(noise AS VARCHAR) AS DECIMAL(38, 24)) AS VARCHAR), '\\.?0+$', '') END, ';'), '' ORDER BY span_no) AS told FROM spans GROUP BY 1, 2)
 SELECT channel, hour, CASE WHEN hour % 11 > 0 THEN sha256(concat(channel, ':', hour, 'quieting:', hour % 101, ';', repeat('k', size), told)) END AS key FROM s""",
)
def cache_key(spark, sf):
    """Each segment's key for cleaned playback; every eleventh hour's aren't kept."""
    rows = spans(spark, sf).withColumn("size", F.floor(F.col("bytes") / 160))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span_no", F.col("size").alias("bytes"), "noise"))), lambda s: F.struct(s["bytes"].alias("bytes"), s["noise"].alias("noise")))
    segments = rows.groupBy("channel", "hour").agg(parts.alias("spans"), F.sum("size").cast("int").alias("n"))  # an hour's spans
    key = F.when(F.col("hour") % 11 > 0, F.concat("channel", F.lit(":"), F.col("hour").cast("string")))
    return segments.select("channel", "hour", notices.quality_key(key, F.col("hour") % 101, F.repeat(F.lit("k"), F.col("n")).cast("binary"), F.col("spans")).alias("key"))


@query(
    "archive_amend",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT event_id // 3 AS doc_id, k % 3 AS kind, k, start_ms, event_id, channel FROM samples), n AS (SELECT doc_id, arg_max(kind, (start_ms, event_id)) AS kind, arg_max(k, (start_ms, event_id)) AS k, arg_max(channel, (start_ms, event_id)) AS channel FROM c GROUP BY 1),
 t AS (SELECT doc_id, arg_max(k, (start_ms, event_id)) AS k FROM c WHERE kind = 0 GROUP BY 1)
 SELECT d.doc_id, CASE WHEN t.k IS NOT NULL THEN concat('said ', t.k) ELSE d.text END AS transcript, CASE WHEN n.kind IS NULL THEN CASE WHEN d.doc_id % 2 = 0 THEN 9 ELSE 0 END WHEN n.kind = 1 THEN n.k ELSE 0 END AS narration_bytes,
 CASE WHEN n.kind IS NULL THEN CASE WHEN d.doc_id % 2 = 0 THEN 'base' END WHEN n.kind = 1 THEN n.channel END AS voice, CASE WHEN n.kind = 2 THEN left(repeat(concat('no voice ', n.k, ' '), 120), 1000) END AS error FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def archive_amend(spark, sf):
    """Records with new transcripts, narrations and failures of narration, several for one record; those for records that aren't there do nothing."""
    k, kind = F.col("k"), F.col("k") % 3
    kinds = F.element_at(F.array(*map(F.lit, sinks.AMENDED)), (kind + 1).cast("int"))
    text = F.when(kind == 0, F.concat(F.lit("said "), k.cast("string"))).when(kind == 1, F.col("channel")).otherwise(F.repeat(F.concat(F.lit("no voice "), k.cast("string"), F.lit(" ")), F.lit(120)))
    changes = samples(spark, sf).select(F.floor(F.col("event_id") / 3).alias("id"), F.struct("start_ms", "event_id").alias("at"), kinds.alias("kind"), text.alias("text"), F.when(kind == 1, F.repeat(F.lit("o"), k.cast("int")).cast("binary")).alias("opus"))
    even = F.col("doc_id") % 2 == 0
    archive = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("transcript"), F.when(even, F.lit("narrated!").cast("binary")).alias("opus"), F.when(even, "base").alias("voice"), F.lit(None).cast("string").alias("error"))
    return sinks.amend(archive, changes).select(F.col("id").alias("doc_id"), "transcript", "narration_bytes", "voice", "error")


@query(
    "cache_prepend",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT event_id, start_ms, start_ms // {DAY_MS} AS batch FROM samples), n AS (SELECT batch, sum(count(*)) OVER (ORDER BY batch) - count(*) AS held FROM b GROUP BY 1)
 SELECT event_id, CAST(held + row_number() OVER (PARTITION BY batch ORDER BY start_ms DESC, event_id DESC) AS BIGINT) AS id, row_number() OVER (ORDER BY batch DESC, start_ms DESC, event_id DESC) AS place FROM b JOIN n USING (batch)""",
)
def cache_prepend(spark, sf):
    """Calls a day at a time in front of those held: a batch's latest comes first and has its least number, which goes on from the batches before."""
    rows = samples(spark, sf).select("event_id", "start_ms", F.floor(F.col("start_ms") / DAY_MS).alias("batch"))
    counts = rows.groupBy("batch").agg(F.count("*").alias("n"))
    upto = with_running_sum(with_previous(counts, ["batch"], ["n"], 365), ["batch"], "n", "upto").select("batch", "n", "upto")
    total = counts.agg(F.sum("n").alias("total"))  # one row
    nth = with_sums_by(rows, "batch", ["start_ms", "event_id"], 3_600_000, {"nth": F.lit(1)}).join(upto, "batch").crossJoin(total)
    return nth.select("event_id", (F.col("upto") - F.col("n") + F.col("nth")).alias("id"), (F.col("total") - F.col("upto") + F.col("nth")).alias("place"))
