"""Retention rules, archive status and updates, queues and backlogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import retention
from tidewake.operators.ordered import with_sums_by
from tidewake.plans.registry import query
from tidewake.sources.domain import SAMPLES_SQL, samples, table

DAY = 86_400_000
ORDERS_SQL = "orders_ms AS (SELECT o_orderkey, o_custkey % 50 AS shelf, o_totalprice, epoch_us(o_orderdate) // 1000 AS ended_ms FROM orders)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("shelf"), "o_totalprice", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ended_ms"))


REFERENCE, TTL = 883_612_800_000, 3 * 365 * DAY  # the start of 1998


@query(
    "retention_ttl_bytes",
    f"WITH {ORDERS_SQL}, t AS (SELECT *, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY shelf ORDER BY ended_ms DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS held FROM orders_ms WHERE ended_ms >= {REFERENCE - TTL}) SELECT o_orderkey, shelf, ended_ms FROM t WHERE held <= 3000000",
)
def retention_ttl_bytes(spark, sf):
    fresh = retention.keep_ttl(_orders(spark, sf), "ended_ms", REFERENCE, TTL, inclusive=True).withColumn("size", F.floor("o_totalprice"))
    return retention.keep_newest_bytes(fresh, "shelf", ["ended_ms", "o_orderkey"], "size", 3_000_000).select("o_orderkey", "shelf", "ended_ms")


@query(
    "retention_keep_one",
    f"WITH {ORDERS_SQL}, t AS (SELECT *, row_number() OVER w AS rn, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER w AS held FROM orders_ms WHERE ended_ms > {REFERENCE - TTL} WINDOW w AS (PARTITION BY shelf ORDER BY ended_ms DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING)) SELECT o_orderkey, shelf, ended_ms FROM t WHERE held <= 100000 OR rn = 1",
)
def retention_keep_one(spark, sf):
    fresh = retention.keep_ttl(_orders(spark, sf), "ended_ms", REFERENCE, TTL, inclusive=False).withColumn("size", F.floor("o_totalprice"))
    return retention.keep_newest_bytes(fresh, "shelf", ["ended_ms", "o_orderkey"], "size", 100_000, keep_one=True).select("o_orderkey", "shelf", "ended_ms")


@query(
    "retention_skip_fit",
    f"""WITH RECURSIVE {ORDERS_SQL}, o AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY shelf ORDER BY ended_ms DESC, o_orderkey DESC) AS rn FROM orders_ms),
 w AS (SELECT shelf, rn, o_orderkey, ended_ms, size <= 1000000 AS kept, CASE WHEN size <= 1000000 THEN size ELSE 0 END AS used FROM o WHERE rn = 1
 UNION ALL SELECT o.shelf, o.rn, o.o_orderkey, o.ended_ms, w.used + o.size <= 1000000, CASE WHEN w.used + o.size <= 1000000 THEN w.used + o.size ELSE w.used END FROM w JOIN o ON o.shelf = w.shelf AND o.rn = w.rn + 1)
 SELECT o_orderkey, shelf, ended_ms FROM w WHERE kept""",
)
def retention_skip_fit(spark, sf):
    rows = _orders(spark, sf).withColumn("size", F.floor("o_totalprice"))
    return retention.keep_fitting(rows, "shelf", ["ended_ms", "o_orderkey"], "size", 1_000_000).select("o_orderkey", "shelf", "ended_ms")


@query(
    "retention_json_bytes",
    f"""WITH {ORDERS_SQL}, j AS (SELECT *, strlen(concat('{{"id":', o_orderkey, ',"at":', ended_ms, '}}')) + 1 AS size FROM orders_ms), r AS (SELECT *, row_number() OVER w AS rn, sum(size) OVER w AS held FROM j WINDOW w AS (PARTITION BY shelf ORDER BY ended_ms DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING))
 SELECT o_orderkey, shelf, CAST(size AS BIGINT) AS size FROM r WHERE rn <= 200 AND held + 26 <= 4000""",
)
def retention_json_bytes(spark, sf):
    """The newest rows whose JSON list, with its commas and wrapper, stays within the limit."""
    text = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("ended_ms").alias("at")))
    rows = retention.keep_count(_orders(spark, sf).withColumn("size", (F.octet_length(text) + 1).cast("long")), "shelf", ["ended_ms", "o_orderkey"], 200)
    return retention.keep_newest_bytes(rows, "shelf", ["ended_ms", "o_orderkey"], "size", 4000 - 26).select("o_orderkey", "shelf", "size")


LOG_TTL, LOG_NOW = 20 * DAY, 1_706_745_600_000  # the start of February 2024, when the stored events end


@query(
    "retention_count_open",
    f"""WITH {SAMPLES_SQL}, e AS (SELECT channel, event_id, start_ms, CASE WHEN noise IS NOT NULL THEN end_ms END AS ended FROM samples), f AS (SELECT * FROM e WHERE ended IS NULL OR ended >= {LOG_NOW - LOG_TTL}),
 r AS (SELECT *, count(ended) OVER (PARTITION BY channel ORDER BY start_ms DESC, event_id DESC) AS newer, count(*) FILTER (WHERE ended IS NULL) OVER (PARTITION BY channel) AS opened FROM f)
 SELECT channel, event_id, CASE WHEN ended IS NULL THEN 1 ELSE 0 END AS is_open FROM r WHERE ended IS NULL OR newer + opened <= 300""",
)
def retention_count_open(spark, sf):
    """An activity log: closed events go by the age of their end, then the oldest closed ones while there are more than 300; open (here unmeasured) ones stay."""
    rows = samples(spark, sf).select("channel", "event_id", "start_ms", F.when(F.col("noise").isNotNull(), F.col("end_ms")).alias("ended"))
    kept = retention.keep_closed(rows, "channel", ["start_ms", "event_id"], "ended", LOG_NOW, LOG_TTL, 300)
    return kept.select("channel", "event_id", F.col("ended").isNull().cast("int").alias("is_open"))


@query(
    "archive_status",
    "SELECT lang, count(*) AS records, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, CAST(coalesce(sum(CASE WHEN doc_id % 3 = 0 THEN strlen(text) END), 0) AS BIGINT) AS narration_bytes, count(*) FILTER (WHERE doc_id % 7 = 0) AS errors FROM documents GROUP BY lang",
)
def archive_status(spark, sf):
    size = F.when(F.col("doc_id") % 3 == 0, F.octet_length("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("records"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("narration_bytes"), F.count_if(F.col("doc_id") % 7 == 0).alias("errors"))


@query("archive_topn", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 500")
def archive_topn(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").orderBy(F.col("n_chars").desc(), F.col("doc_id").desc()).limit(500)


@query(
    "archive_update",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE 100 * l.quality END AS n_chars, CASE WHEN l.doc_id IS NULL AND d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS narrated FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def archive_update(spark, sf):
    """A new transcript for labelled records, whose narration is thereby reset."""
    hit = F.col("quality").isNotNull()
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.when(hit, 100 * F.col("quality")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"), (~hit & (F.col("doc_id") % 3 == 0)).cast("int").alias("narrated"))


@query(
    "backlog",
    f"""WITH {SAMPLES_SQL}, s AS (SELECT channel, dur_ms, CASE k % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'transcribing' WHEN 2 THEN 'error' ELSE 'done' END AS status FROM samples),
 a AS (SELECT channel, count(*) FILTER (WHERE status IN ('queued', 'transcribing')) AS clips, CAST(coalesce(sum(dur_ms) FILTER (WHERE status IN ('queued', 'transcribing')), 0) AS BIGINT) AS waiting_ms, count(*) FILTER (WHERE status = 'transcribing') AS processing, count(*) FILTER (WHERE status IN ('queued', 'transcribing', 'error')) AS listed FROM s GROUP BY channel)
 SELECT *, CASE WHEN clips = 0 THEN 'caught up' ELSE concat(clips, CASE WHEN clips = 1 THEN ' clip, ' ELSE ' clips, ' END, CAST(ceil(waiting_ms / 1000.0) AS BIGINT), ' s') END AS label FROM a""",
)
def backlog(spark, sf):
    status = F.element_at(F.array(F.lit("queued"), F.lit("transcribing"), F.lit("error"), F.lit("done")), (F.col("k") % 4 + 1).cast("int"))
    waiting = F.col("status").isin("queued", "transcribing")
    rows = samples(spark, sf).withColumn("status", status).groupBy("channel").agg(
        F.count_if(waiting).alias("clips"), F.coalesce(F.sum(F.when(waiting, F.col("dur_ms"))), F.lit(0)).cast("long").alias("waiting_ms"), F.count_if(F.col("status") == "transcribing").alias("processing"), F.count_if(waiting | (F.col("status") == "error")).alias("listed")
    )
    text = F.concat(F.col("clips").cast("string"), F.when(F.col("clips") == 1, " clip, ").otherwise(" clips, "), F.ceil(F.col("waiting_ms") / 1000).cast("string"), F.lit(" s"))
    return rows.withColumn("label", F.when(F.col("clips") == 0, "caught up").otherwise(text))


@query(
    "processing_queue",
    f"WITH {SAMPLES_SQL}, r AS (SELECT channel, event_id, row_number() OVER (PARTITION BY channel ORDER BY start_ms DESC, event_id DESC) AS rn FROM samples WHERE k % 4 IN (0, 1, 2)) SELECT channel, event_id, CASE WHEN rn <= 8 THEN 'queued' ELSE 'Transcription queue full' END AS status FROM r",
)
def processing_queue(spark, sf):
    """At most the eight newest of each channel wait; older ones are turned away."""
    waiting = samples(spark, sf).where(F.col("k") % 4 != 3).select("channel", "event_id", "start_ms")
    return with_sums_by(waiting, "channel", ["start_ms", "event_id"], DAY, {"rn": F.lit(1)}).select("channel", "event_id", F.when(F.col("rn") <= 8, "queued").otherwise("Transcription queue full").alias("status"))


@query("vad_failopen", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unavailable' WHEN l.quality = 0 THEN 'no-speech' ELSE 'speech' END AS vad, CASE WHEN l.quality = 0 THEN 0 ELSE 1 END AS transcribed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def vad_failopen(spark, sf):
    """Only a certain "no speech" skips a record; without a verdict it is transcribed."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    vad = F.when(F.col("quality").isNull(), "unavailable").when(F.col("quality") == 0, "no-speech").otherwise("speech")
    return rows.select("doc_id", vad.alias("vad"), F.coalesce(F.col("quality") != 0, F.lit(True)).cast("int").alias("transcribed"))


@query(
    "two_phase_rebuild",
    """WITH v AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), o AS (SELECT CASE WHEN quality = 0 THEN 'no-speech' WHEN quality IS NULL THEN 'vad-error' WHEN n_chars > 8000 THEN 'base-error' ELSE 'rebuilt' END AS outcome, n_chars FROM v)
 SELECT outcome, count(*) AS records, CAST(sum(CASE outcome WHEN 'rebuilt' THEN n_chars // 2 WHEN 'no-speech' THEN 0 ELSE n_chars END) AS BIGINT) AS chars_after FROM o GROUP BY outcome""",
)
def two_phase_rebuild(spark, sf):
    """Speech is looked for first; only where there is some is a text remade. Silence empties it, failures leave it."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    outcome = F.when(F.col("quality") == 0, "no-speech").when(F.col("quality").isNull(), "vad-error").when(F.col("n_chars") > 8000, "base-error").otherwise("rebuilt")
    after = F.when(F.col("outcome") == "rebuilt", F.floor(F.col("n_chars") / 2)).when(F.col("outcome") == "no-speech", 0).otherwise(F.col("n_chars"))
    return rows.withColumn("outcome", outcome).groupBy("outcome").agg(F.count("*").alias("records"), F.sum(after).cast("long").alias("chars_after"))
