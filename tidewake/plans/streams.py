"""Queries that run a stream over the stored events to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators.ordered import with_sums_by
from tidewake.plans.activity import SPECTRUM_SQL
from tidewake.plans.registry import query
from tidewake.sources.domain import HOUR_MS, SAMPLES_SQL, SPANS_SQL, samples, samples_of, spans, table
from tidewake.sources.folders import shared_folder
from tidewake.sources.replay import READ, ReplaySource
from tidewake.streaming import calls, stateful


def _stream(spark, sf):
    # a pattern, as the table may be one file or a folder of them
    return samples_of(spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*"))


@query("stream_sessions", f"WITH {SPECTRUM_SQL} SELECT channel, CAST(session AS BIGINT) AS session, min(start_ms) AS started_ms, max(start_ms) + 1000 AS ended_ms, max(score) AS score, count(*) AS n FROM sessions GROUP BY 1, 2")
def stream_sessions(spark, sf):
    rows = _stream(spark, sf).where("score >= 2").select("channel", "event_id", "start_ms", "score")
    return stateful.open_sessions(rows, shared_folder(spark, "sessions"))


def _segments_sql(recovered: str) -> str:
    """The walk over each slot's rows: open segment (st, en, ch), its number and the edge behind which all is closed."""
    return f"""WITH RECURSIVE {SAMPLES_SQL}, o AS (SELECT slot, start_ms AS a, end_ms AS b, {recovered} AS rec, row_number() OVER (PARTITION BY slot ORDER BY start_ms, event_id) AS rn FROM samples),
 w AS (SELECT DISTINCT slot, CAST(0 AS BIGINT) AS rn, CAST(CASE slot WHEN 'A' THEN 1 ELSE 2 END AS BIGINT) AS seg, CAST(-1 AS BIGINT) AS st, CAST(-1 AS BIGINT) AS en, CAST(0 AS BIGINT) AS ch, CAST(-1 AS BIGINT) AS edge, false AS put, false AS closed FROM samples
 UNION ALL SELECT slot, rn, CASE WHEN was THEN seg + 2 ELSE seg END, CASE WHEN skip OR (ch > 0 AND NOT front) THEN st0 ELSE x END, CASE WHEN skip OR front THEN en0 ELSE greatest(en0, b) END, CASE WHEN skip THEN ch ELSE ch + 1 END, edge, NOT skip,
 NOT skip AND (CASE WHEN front THEN en0 ELSE greatest(en0, b) END) - (CASE WHEN ch > 0 AND NOT front THEN st0 ELSE x END) >= 600000 FROM (
 SELECT *, b <= x OR (ch > 0 AND rec AND x >= st0) AS skip, b > x AND ch > 0 AND rec AND x < st0 AS front FROM (
 SELECT o.slot, o.rn, o.b, o.rec, w.seg, w.closed AS was, CASE WHEN w.closed THEN -1 ELSE w.st END AS st0, CASE WHEN w.closed THEN -1 ELSE w.en END AS en0, CASE WHEN w.closed THEN 0 ELSE w.ch END AS ch, CASE WHEN w.closed THEN w.en ELSE w.edge END AS edge,
 greatest(o.a, CASE WHEN w.closed THEN w.en ELSE w.edge END) AS x FROM w JOIN o ON o.slot = w.slot AND o.rn = w.rn + 1)))
 SELECT slot, seg AS segment_id, max_by(st, rn) AS started_ms, max_by(en, rn) AS ended_ms, max_by(ch, rn) AS chunks, max_by(closed, rn) AS closed FROM w WHERE put GROUP BY 1, 2"""


@query("stream_segments", _segments_sql("false"))
def stream_segments(spark, sf):
    rows = _stream(spark, sf).select("slot", "event_id", "start_ms", "end_ms", F.lit(False).alias("recovered"))
    return stateful.run_to_end(stateful.growing_segments(rows, 600_000, {"A": 1, "B": 2}), ["slot", "segment_id"], stateful.SEGMENT, shared_folder(spark, "segments"))


@query("late_prepend", _segments_sql("k % 3 = 0"))
def late_prepend(spark, sf):
    rows = _stream(spark, sf).select("slot", "event_id", "start_ms", "end_ms", (F.col("k") % 3 == 0).alias("recovered"))
    return stateful.run_to_end(stateful.growing_segments(rows, 600_000, {"A": 1, "B": 2}), ["slot", "segment_id"], stateful.SEGMENT, shared_folder(spark, "late"))


#: Events stand for what a receiver (``user_id``) hears: kinds by k, recovered sound as much as a day older than its arrival.
_HEARD = f"""{SAMPLES_SQL}, heard AS (SELECT user_id AS receiver, event_id, start_ms - CASE WHEN k % 11 <> 0 AND k % 4 = 1 THEN (k % 7) * 14400000 ELSE 0 END AS start_ms, 20 * (k + 1) AS dur_ms, coalesce(noise < 0.22, false) AS open,
 CASE WHEN k % 22 = 0 THEN 'reset' WHEN k % 11 = 0 THEN 'target' WHEN k % 4 = 1 THEN 'recovered' ELSE 'live' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS rn FROM samples)"""

#: Row by row: what the row finds (f), what waits then (g), what it does (o), what that leaves.
_RECOVERY_SQL = f"""WITH RECURSIVE {_HEARD},
 w AS (SELECT DISTINCT receiver, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(0 AS BIGINT) AS cutoff, false AS stored, false AS locked, CAST(0 AS BIGINT) AS open_ms, CAST(0 AS BIGINT) AS quiet_ms, CAST(0 AS BIGINT) AS held, CAST([] AS STRUCT(id BIGINT, ms BIGINT)[]) AS roll, CAST([] AS STRUCT(id BIGINT, ms BIGINT)[]) AS sent FROM heard
 UNION ALL
 SELECT receiver, rn, id, outcome, CASE outcome WHEN 'reset' THEN a WHEN 'target' THEN greatest(cutoff, a) WHEN 'ended' THEN a + ms ELSE cutoff END,
  CASE outcome WHEN 'reset' THEN false WHEN 'locked' THEN total >= 4000 WHEN 'prepended' THEN stored OR held + ms >= 4000 WHEN 'stored' THEN stored OR held + ms >= 4000 WHEN 'ended' THEN stored OR held + ms >= 4000 ELSE stored END,
  CASE WHEN outcome IN ('reset', 'ended') THEN false WHEN outcome = 'locked' THEN true ELSE locked END,
  CASE WHEN outcome IN ('reset', 'ended') THEN 0 WHEN outcome = 'locked' OR (outcome = 'buffered' AND kind = 'live') THEN opened ELSE open_ms END,
  CASE WHEN outcome IN ('reset', 'ended', 'locked') THEN 0 WHEN outcome = 'stored' THEN quiet ELSE quiet_ms END,
  CASE WHEN outcome IN ('reset', 'ended') THEN 0 WHEN outcome = 'locked' THEN CASE WHEN total >= 4000 THEN 0 ELSE total END WHEN outcome IN ('prepended', 'stored') THEN CASE WHEN held + ms >= 4000 THEN 0 ELSE held + ms END ELSE held END,
  CASE WHEN outcome IN ('reset', 'locked') THEN [] WHEN outcome = 'buffered' THEN waits ELSE roll END, CASE WHEN outcome = 'locked' THEN waits ELSE [] END
 FROM (SELECT *, CASE WHEN kind IN ('reset', 'target') THEN kind WHEN kind = 'recovered' AND a + ms + 1 < cutoff THEN 'late' WHEN kind = 'recovered' AND locked THEN CASE WHEN stored THEN 'refused' ELSE 'prepended' END
   WHEN kind = 'recovered' OR (NOT locked AND opened < 200) THEN 'buffered' WHEN NOT locked THEN 'locked' WHEN quiet >= 5000 THEN 'ended' ELSE 'stored' END AS outcome, coalesce(list_sum(list_transform(waits, lambda p: p.ms)), 0)::BIGINT AS total
  FROM (SELECT *, list_filter(piled, lambda p, i: i = len(piled) OR list_sum(list_transform(piled[i:], lambda q: q.ms)) <= 7000) AS waits FROM (
   SELECT w.receiver, h.rn, h.event_id AS id, h.kind, h.start_ms AS a, h.dur_ms AS ms, w.cutoff, w.stored, w.locked, w.open_ms, w.quiet_ms, w.held, w.roll,
    list_append(w.roll, {{'id': h.event_id, 'ms': h.dur_ms}}) AS piled, CASE WHEN h.open THEN w.open_ms + h.dur_ms ELSE 0 END AS opened, CASE WHEN h.open THEN 0 ELSE w.quiet_ms + h.dur_ms END AS quiet
   FROM w JOIN heard h ON h.receiver = w.receiver AND h.rn = w.rn + 1))))
 SELECT receiver, event_id, outcome, cutoff AS cutoff_ms, CAST(len(sent) AS BIGINT) AS pieces, sent[1].id AS first_piece, held AS held_ms FROM w WHERE rn > 0"""


def _heard(rows):
    k = F.col("k")
    kind = F.when(k % 22 == 0, "reset").when(k % 11 == 0, "target").when(k % 4 == 1, "recovered").otherwise("live")
    late = F.when(F.col("kind") == "recovered", k % 7 * 14_400_000).otherwise(0)
    return rows.withColumn("kind", kind).select(F.col("user_id").alias("receiver"), "event_id", F.col("start_ms").alias("arrived_ms"), (F.col("start_ms") - late).alias("start_ms"), (20 * (k + 1)).alias("dur_ms"), F.coalesce(F.col("noise") < 0.22, F.lit(False)).alias("open"), "kind")


@query("scan_recovery", _RECOVERY_SQL)
def scan_recovery(spark, sf):
    """What becomes of each piece of sound that a scanning receiver hears or recovers, with the cut-off and the pre-roll in Spark's state."""
    return calls.append_to(calls.call_outcomes(_heard(_stream(spark, sf)), 4_000), shared_folder(spark, "recovery"), calls.OUTCOMES)


IDLE_MS = 21_600_000  # six hours for the reference's six seconds, as the stored events lie hours apart


@query(
    "idle_batches",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT user_id AS receiver, event_id, start_ms, 20 * (k + 1) AS dur_ms, CASE WHEN start_ms - lag(start_ms) OVER w < {IDLE_MS} THEN 0 ELSE 1 END AS brk FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)),
 n AS (SELECT *, sum(brk) OVER (PARTITION BY receiver ORDER BY start_ms, event_id) AS no FROM b), g AS (SELECT receiver, no, min(start_ms) AS started_ms, max(start_ms) AS ended_ms, count(*) AS n, CAST(sum(dur_ms) AS BIGINT) AS dur_ms FROM n GROUP BY 1, 2)
 SELECT receiver, started_ms, ended_ms, n, dur_ms FROM g WHERE ended_ms + {IDLE_MS} < (SELECT max(start_ms) FROM samples) OR no < (SELECT max(no) FROM n WHERE n.receiver = g.receiver)""",
)
def idle_batches(spark, sf):
    """Batches of a receiver's rows that took no more input for a time: those closed by a later row, and those closed by a timer."""
    rows = _stream(spark, sf).withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", "0 seconds").select(F.col("user_id").alias("receiver"), "event_id", "start_ms", (20 * (F.col("k") + 1)).alias("dur_ms"), "at")
    return calls.append_to(calls.closed_when_idle(rows, IDLE_MS), shared_folder(spark, "idle"), calls.CLOSED)


@query(
    "cursor_stream",
    f"""WITH {SPANS_SQL}, s AS (SELECT channel AS slot, hour, 'c' || (hour // 6 % 3) AS tuned, CAST(sum(bytes) AS BIGINT) AS total FROM spans GROUP BY 1, 2), g AS (SELECT *, row_number() OVER w AS id, lead(tuned) OVER w AS behind FROM s WINDOW w AS (PARTITION BY slot ORDER BY hour)),
 r AS (SELECT *, CAST(unnest(range(0, total, 6000)) AS BIGINT) AS begins FROM g), p AS (SELECT r.slot, id, begins, greatest(byte_start, begins) AS a, least(byte_end, begins + 6000) AS b, noise FROM r JOIN spans ON spans.channel = r.slot AND spans.hour = r.hour AND byte_start < begins + 6000 AND byte_end > begins),
 q AS (SELECT slot, id, begins, count(*) AS parts, round(coalesce(sum((b - a) * noise), 0), 6) AS weighted FROM p GROUP BY 1, 2, 3)
 SELECT slot, id, tuned AS channel, begins, least(6000, total - begins) AS n, parts, weighted, CASE WHEN begins + 6000 >= total THEN CASE WHEN behind IS NULL THEN 'edge' WHEN behind = tuned THEN 'advance' ELSE 'channel-change' END END AS after FROM r JOIN q USING (slot, id, begins)""",
)
def cursor_stream(spark, sf):
    """All reads of the stored segments through cursors, as a stream: what each gives, its quality spans, and what follows. Stored channels stand for slots, which change channel every six hours."""
    whole = spans(spark, sf).groupBy("channel", "hour").agg(F.sum("bytes").alias("total"), F.array_sort(F.collect_list(F.struct("span_no", "bytes", "noise"))).alias("s"))  # an hour's spans
    hours = samples(spark, sf).select(F.col("channel").alias("of"), F.floor(F.col("start_ms") / HOUR_MS).alias("at")).distinct().withColumn("back", -F.col("at"))
    numbers = with_sums_by(hours, "of", ["back"], 24 * 30, {"id": F.lit(1).cast("long")})  # without the spans, which would all go to their channel's task
    stored = whole.join(numbers, F.col("channel").eqNullSafe(F.col("of")) & F.col("hour").eqNullSafe(F.col("at")))
    parts = F.transform("s", lambda x: F.struct(x["bytes"].alias("bytes"), x["noise"].alias("noise")))
    rows = stored.select(F.col("channel").alias("slot"), "id", F.concat(F.lit("c"), (F.floor(F.col("hour") / 6) % 3).cast("string")).alias("channel"), (F.col("hour") * 3_600_000).alias("started_ms"), "total", parts.alias("spans"))
    folder = shared_folder(spark, "replay")
    rows.repartitionByRange("slot", "id").sortWithinPartitions("slot", "id").write.parquet(f"{folder}/segments")
    spark.dataSource.register(ReplaySource)
    read = spark.readStream.format("replay").option("path", f"{folder}/segments").option("most", 6_000).load()
    weighted = F.aggregate("spans", F.lit(0.0), lambda s, x: s + F.coalesce(x["bytes"] * x["noise"], F.lit(0.0)))
    found = calls.append_to(read, folder, READ)
    return found.select("slot", "id", "channel", "begins", "n", F.size("spans").cast("long").alias("parts"), F.round(weighted, 6).alias("weighted"), "after")


FULL_MS, OVERLAP_MS, GAP_MS = 4_000, 1_500, 43_200_000  # half a day for the reference's half second
_SETTING = "concat(start_ms // 432000000 % 3, '/', start_ms // 604800000 % 2, '/', start_ms // 950400000 % 2, '/', start_ms // 345600000 % 2)"

_BATCHES_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, c AS (SELECT user_id AS receiver, event_id AS id, start_ms AS a, CAST(20 * (k + 1) AS BIGINT) AS ms, noise IS NOT NULL AS act, {_SETTING} AS setting, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS rn FROM samples),
 w AS (SELECT DISTINCT receiver, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, ms BIGINT)[]) AS pend, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS last_end, '' AS setting, CAST(NULL AS STRUCT(f BIGINT, l BIGINT, n BIGINT, o BIGINT, h BIGINT, w VARCHAR)) AS x, CAST(NULL AS STRUCT(f BIGINT, l BIGINT, n BIGINT, o BIGINT, h BIGINT, w VARCHAR)) AS y FROM c
 UNION ALL
 SELECT receiver, rn, CASE WHEN NOT act THEN [] WHEN is_full THEN keep ELSE p2 END, CASE WHEN NOT act THEN 0 WHEN is_full THEN least(CAST(list_sum(list_transform(keep, lambda q: q.ms)) AS BIGINT), {OVERLAP_MS}) ELSE h2 END, CASE WHEN NOT act THEN 0 WHEN is_full THEN len(keep) ELSE o1 END,
  CASE WHEN act THEN a + ms ELSE last_end END, CASE WHEN act THEN new_setting ELSE setting END, x, CASE WHEN act AND is_full THEN {{'f': p2[o1 + 1].id, 'l': p2[-1].id, 'n': len(p2) - o1, 'o': o1, 'h': h2, 'w': 'full'}} END
 FROM (SELECT *, h2 >= {FULL_MS} AS is_full, list_filter(p2, lambda q, i: coalesce(list_sum(list_transform(p2[i + 1:], lambda r: r.ms)), 0) < {OVERLAP_MS}) AS keep
  FROM (SELECT *, CASE WHEN brk THEN 0 ELSE held END + ms AS h2, list_append(CASE WHEN brk THEN [] ELSE pend END, {{'id': id, 'ms': ms}}) AS p2, CASE WHEN brk THEN 0 ELSE over END AS o1,
    CASE WHEN brk AND len(pend) > over THEN {{'f': pend[over + 1].id, 'l': pend[-1].id, 'n': len(pend) - over, 'o': over, 'h': held, 'w': CASE WHEN act THEN 'break' ELSE 'quiet' END}} END AS x
   FROM (SELECT w.receiver, c.rn, c.id, c.a, c.ms, c.act, c.setting AS new_setting, w.pend, w.held, w.over, w.last_end, w.setting, NOT c.act OR (len(w.pend) > 0 AND (w.setting <> c.setting OR abs(c.a - w.last_end) > {GAP_MS})) AS brk
    FROM w JOIN c ON c.receiver = w.receiver AND c.rn = w.rn + 1))))
 SELECT receiver, b.f AS first_id, b.l AS last_id, b.n AS clips, b.o AS overlap, b.h AS held_ms, b.w AS closed FROM (SELECT receiver, x AS b FROM w UNION ALL SELECT receiver, y FROM w) WHERE b IS NOT NULL"""


@query("clip_batches", _BATCHES_SQL)
def clip_batches(spark, sf):
    """Batches to transcribe, closed by another setting, by a gap, by a clip without signal, or full; after a full one its newest clips are heard again with the next."""
    turn = lambda days, n: (F.floor(F.col("start_ms") / (days * 86_400_000)) % n).cast("string")
    setting = F.concat_ws("/", turn(5, 3), turn(7, 2), turn(11, 2), turn(4, 2))
    rows = _stream(spark, sf).select(F.col("user_id").alias("receiver"), "event_id", "start_ms", (20 * (F.col("k") + 1)).alias("dur_ms"), F.col("noise").isNotNull().alias("active"), setting.alias("setting"))
    return calls.append_to(calls.batched_clips(rows, FULL_MS, OVERLAP_MS, GAP_MS), shared_folder(spark, "batched"), calls.BATCHES)


@query("vessel_stream", f"WITH {SAMPLES_SQL} SELECT event_id, user_id AS mmsi, c_name AS vessel, CAST(c_nationkey AS BIGINT) AS flag FROM samples LEFT JOIN customer ON c_custkey = user_id")
def vessel_stream(spark, sf):
    """Calls with what is known of their vessels (customers stand for these) at the time of the batch."""
    vessels = lambda: table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("mmsi"), F.col("c_name").alias("vessel"), F.col("c_nationkey").cast("long").alias("flag"))
    calls_ = _stream(spark, sf).select("event_id", F.col("user_id").cast("long").alias("mmsi"))
    return stateful.enriched(calls_, vessels, "mmsi", shared_folder(spark, "vessels"), "event_id long, mmsi long, vessel string, flag long")
