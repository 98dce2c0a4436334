"""What is stored and read back: snapshots, admissions, checked copies, files of chunks; features of frames before playback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import features, gates, signal
from tidewake.operators.ordered import with_previous, with_running_sum, with_trailing
from tidewake.plans.activity import SQUELCH
from tidewake.plans.registry import query
from tidewake.plans.signals import CLIPS_SQL, _clips
from tidewake.sources import frames, sinks
from tidewake.sources.domain import SAMPLES_SQL, samples, samples_of, table
from tidewake.sources.folders import shared_folder
from tidewake.streaming import lookahead

DAY_MS = 86_400_000


@query(
    "snapshot_sink",
    "WITH p AS (SELECT doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS text FROM documents WHERE text <> '' AND doc_id % 5 <> 0) SELECT key, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CASE WHEN key % 7 = 0 THEN 2 ELSE 1 END AS stored, sha256(text) AS digest FROM p",
)
def snapshot_sink(spark, sf):
    """Two snapshots: in the second every seventh payload has changed and every fifth is gone. Read back, the stored bytes have the digests listed."""
    folder = shared_folder(spark, "snapshots")
    rows = table(spark, sf, "documents").where("text <> ''").select(F.col("doc_id").alias("key"), "text")
    first = sinks.snapshot(rows.select("key", F.col("text").cast("binary").alias("payload")), folder, 1)
    changed = F.when(F.col("key") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    second = sinks.snapshot(rows.where("key % 5 <> 0").select("key", changed.cast("binary").alias("payload")), folder, 2, first)
    read = sinks.payloads(spark, folder, second).select("key", F.sha2("payload", 256).alias("digest"))
    return second.join(read, ["key", "digest"]).select("key", "bytes", F.col("stored").cast("int").alias("stored"), "digest")


@query(
    "payload_sweep",
    "SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS stored, sha256(CASE WHEN doc_id % 3 = 0 THEN concat(text, '!?') WHEN doc_id % 7 <> 0 THEN concat(text, '!') ELSE text END) AS digest, 'payloads/stored=1 versions/000000000001 versions/000000000002' AS swept FROM documents WHERE text <> ''",
)
def payload_sweep(spark, sf):
    """Three snapshots and a sweep. The second changes six payloads of seven, so the rest of the first's are written again with it; the third changes one of three."""
    folder = shared_folder(spark, "swept")
    rows = table(spark, sf, "documents").where("text <> ''").select(F.col("doc_id").alias("key"), "text")
    as_payload = lambda text: rows.select("key", text.cast("binary").alias("payload"))
    second = F.when(F.col("key") % 7 != 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    third = F.when(F.col("key") % 3 == 0, F.concat("text", F.lit("!?"))).otherwise(second)
    manifest = None
    for version, text in enumerate((F.col("text"), second, third), 1):
        manifest = sinks.snapshot(as_payload(text), folder, version, manifest, worth=0.4)
    swept = sinks.sweep(spark, folder)
    read = sinks.payloads(spark, folder, manifest).select("key", F.sha2("payload", 256).alias("digest"))
    return manifest.join(read, ["key", "digest"]).select("key", F.col("stored").cast("int").alias("stored"), "digest", F.lit(" ".join(swept)).alias("swept"))


@query(
    "snapshot_stream",
    f"WITH {SAMPLES_SQL} SELECT channel, count(*) AS n, max(start_ms) AS newest_ms, CAST(sum(bytes) AS BIGINT) AS bytes FROM samples GROUP BY 1",
)
def snapshot_stream(spark, sf):
    """Each channel's standing, published as the stream goes on; the newest version is what a reader sees."""
    folder = shared_folder(spark, "standing")
    stream = samples_of(spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*"))
    standing = stream.groupBy("channel").agg(F.count("*").alias("n"), F.max("start_ms").alias("newest_ms"), F.sum("bytes").alias("bytes"))
    sinks.publish_stream(standing, folder).awaitTermination()
    return sinks.newest(spark, folder, "channel string, n long, newest_ms long, bytes long")


@query(
    "archive_insert",
    f"""WITH {SAMPLES_SQL}, e AS (SELECT event_id AS id, start_ms, CASE WHEN k % 8 = 0 THEN 700 * bytes ELSE bytes END AS bytes FROM samples), r AS (SELECT id, bytes, sum(bytes) OVER (ORDER BY start_ms DESC, id DESC ROWS UNBOUNDED PRECEDING) AS held FROM e WHERE bytes <= 20000000 AND start_ms >= (SELECT max(start_ms) FROM samples) - 20 * {DAY_MS}::BIGINT)
 SELECT id, bytes FROM r WHERE held <= 20000000""",
)
def archive_insert(spark, sf):
    """A quarter of the records is new, and some of those are too large; then age and bytes decide."""
    iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = samples(spark, sf).select(F.col("event_id").alias("id"), iso(F.col("start_ms")).alias("started"), iso(F.col("end_ms")).alias("ended"), F.when(F.col("k") % 8 == 0, 700 * F.col("bytes")).otherwise(F.col("bytes")).alias("bytes"), "k")
    now = samples(spark, sf).agg(F.max("start_ms").alias("now")).first().now  # one number
    kept = sinks.admit(rows.where("k % 4 <> 0").drop("k"), rows.where("k % 4 = 0").drop("k"), F.lit(now), 20, 20_000_000)
    return kept.select("id", "bytes")


@query("verified_backup", f"WITH {SAMPLES_SQL} SELECT event_id, channel, start_ms FROM samples")
def verified_backup(spark, sf):
    return sinks.verified_copy(samples(spark, sf).select("event_id", "channel", "start_ms"), "event_id", shared_folder(spark, "backup"))


@query("progress_sink", f"WITH {SAMPLES_SQL} SELECT 'base' AS phase, count(*) AS total, count(*) FILTER (WHERE k % 5 <> 4) AS completed, count(*) FILTER (WHERE k % 5 IN (0, 1)) AS speech, count(*) FILTER (WHERE k % 5 = 2) AS no_speech, count(*) FILTER (WHERE k % 5 = 3) AS vad_errors FROM samples")
def progress_sink(spark, sf):
    """Counts of a rebuild, and nothing else of its records, as a published line of JSON."""
    folder = shared_folder(spark, "progress")
    n = lambda *of: F.count_if((F.col("k") % 5).isin(*of))
    counts = samples(spark, sf).agg(F.count("*").alias("total"), n(0, 1, 2, 3).alias("completed"), n(0, 1).alias("speech"), n(2).alias("no_speech"), n(3).alias("vad_errors")).select(F.lit("base").alias("phase"), "*")
    sinks.publish(counts, folder, 1, "json")
    return sinks.newest(spark, folder, "phase string, total long, completed long, speech long, no_speech long, vad_errors long", "json")


@query(
    "wav_chunks",
    f"WITH {SAMPLES_SQL} SELECT event_id, CAST(k % 4 = 0 OR k % 4 = 3 AS INTEGER) AS strict, CAST(k % 4 IN (0, 2) AS INTEGER) AS playable, CAST(k % 4 IN (0, 3) AS INTEGER) AS mono, CASE WHEN k % 4 = 1 THEN NULL ELSE 2 * k + CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END END AS data_bytes FROM samples",
)
def wav_chunks(spark, sf):
    """Files whose format follows an odd, padded chunk: whole ones, cut ones, stereo ones and ones with an odd number of bytes, by three readers' rules."""
    n = lambda v, size: frames.little_endian(v if not isinstance(v, int) else F.lit(v), size)
    tag = lambda h: F.unhex(F.lit(h))
    kind = F.col("k") % 4
    size = 2 * F.col("k") + F.when(kind == 3, 1).otherwise(0)
    channels = F.when(kind == 2, 2).otherwise(1)
    note = F.concat(F.encode(F.lit("LIST"), "UTF-8"), n(3, 4), F.encode(F.lit("abc\0"), "UTF-8"))
    form = F.concat(tag(frames.FMT), n(16, 4), n(1, 2), n(channels, 2), n(24_000, 4), n(48_000, 4), n(2, 2), n(16, 2))
    sound = F.concat(tag(frames.DATA), n(size, 4), F.encode(F.repeat(F.lit("s"), size.cast("int")), "UTF-8"), F.when(kind == 3, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    file = F.concat(tag(frames.RIFF), n(size + 56, 4), tag(frames.WAVE), note, form, sound)
    cut = F.when(kind == 1, F.substring(file, F.lit(1), F.octet_length(file) - F.least(F.lit(1), size))).otherwise(file)
    rows = samples(spark, sf).select("event_id", cut.alias("data"))
    parts = frames.wav_parts(rows, "event_id")
    return parts.select("event_id", frames.strict_wav(24_000).cast("int").alias("strict"), frames.playable_wav().cast("int").alias("playable"), frames.mono_wav().cast("int").alias("mono"), F.col("first_bytes").alias("data_bytes"))


@query(
    "energy_window",
    f"""WITH {CLIPS_SQL}, e AS (SELECT vec_id, s, round(sum(x * x), 9) AS energy FROM clips, range(0, 49, 8) AS r(s) WHERE n >= s AND n < s + 16 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY energy DESC, s) AS rn FROM e)
 SELECT vec_id, s AS start, round(energy, 6) AS energy FROM r WHERE rn = 1""",
)
def energy_window(spark, sf):
    """The stretch by which two signals are aligned: the loudest sixteenth of a second, looked for every eighth sample."""
    return _clips(spark, sf).where(F.size("x") == 64).select("vec_id", signal.loudest_window(F.col("x"), 16, 8).alias("w")).select("vec_id", "w.start", F.round("w.energy", 6).alias("energy"))


@query(
    "band_ratio",
    f"""WITH {CLIPS_SQL}, t AS (SELECT vec_id, f, pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * cos(2 * pi() * f / 16000 * n)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * sin(2 * pi() * f / 16000 * n)), 2) AS p FROM clips, range(400, 7001, 100) AS r(f) WHERE f <= 3000 OR f >= 4000 GROUP BY 1, 2)
 SELECT vec_id, round(10 * log10(((sum(p) FILTER (WHERE f <= 3000)) / 27 + 1e-20) / ((sum(p) FILTER (WHERE f >= 4000)) / 31 + 1e-20)), 5) AS ratio FROM t GROUP BY 1""",
)
def band_ratio(spark, sf):
    """How much stronger the voice's band is than the one above it."""
    return signal.band_ratio(_clips(spark, sf).where(F.size("x") == 64), "vec_id", 16_000, (400, 3000), (4000, 7000)).select("vec_id", F.round("ratio", 5).alias("ratio"))


FRAMES_SQL = SAMPLES_SQL + f", d AS (SELECT channel, start_ms // {DAY_MS} AS day, row_number() OVER (PARTITION BY channel, start_ms // {DAY_MS} ORDER BY start_ms, event_id) AS n, event_id, score AS level, (k % 20) / 4.0 AS ratio FROM samples)"


@query(
    "frame_candidates",
    f"""WITH {FRAMES_SQL}, s AS (SELECT *, median(ratio) OVER w AS smooth, median(level) OVER w AS smooth_level, lead(n, 17) OVER (PARTITION BY channel, day ORDER BY n) AS ahead FROM d WINDOW w AS (PARTITION BY channel, day ORDER BY n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
 m AS (SELECT *, mad(smooth) OVER (PARTITION BY channel, day ORDER BY n ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS off FROM s)
 SELECT event_id, round(smooth, 9) AS smooth, round(off, 9) AS mad, CAST(n > 17 AND ahead IS NOT NULL AND level >= 3 AND smooth_level >= 3 AND abs(smooth - 2) <= 2.5 AND off <= 1.5 AS INTEGER) AS candidate, CAST(ahead IS NULL AS INTEGER) AS open_tail FROM m""",
)
def frame_candidates(spark, sf):
    """Frames that sound like the noise template: level and smoothed ratio near it, and the ratio steady around. The last frames, without a whole window, are open."""
    first = Window.partitionBy("channel", "day").orderBy("start_ms", "event_id")
    rows = samples(spark, sf).withColumn("day", F.floor(F.col("start_ms") / DAY_MS))
    rows = rows.select("channel", "day", (F.row_number().over(first) - 1).cast("long").alias("n"), "event_id", F.col("score").alias("level"), (F.col("k") % 20 / 4).alias("ratio"))
    found = features.candidates(rows, ["channel", "day"], 6.0, 2.0)
    return found.select("event_id", F.round("smooth", 9).alias("smooth"), F.round("mad", 9).alias("mad"), F.col("candidate").cast("int").alias("candidate"), (~F.col("ahead")).cast("int").alias("open_tail"))


@query(
    "stream_candidates",
    f"""WITH {CLIPS_SQL}, d AS (SELECT vec_id AS stream, n, 40 * x AS level, 10 * x AS ratio FROM clips), s AS (SELECT *, median(ratio) OVER w AS smooth, median(level) OVER w AS smooth_level, lead(n, 17) OVER (PARTITION BY stream ORDER BY n) AS ahead FROM d WINDOW w AS (PARTITION BY stream ORDER BY n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
 m AS (SELECT *, mad(smooth) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS off FROM s)
 SELECT stream, CAST(n AS BIGINT) AS n, round(smooth, 6) + 0.0 AS smooth, round(off, 6) + 0.0 AS mad, CAST(n >= 17 AND ahead IS NOT NULL AND level >= -1 AND smooth_level >= -1 AND abs(smooth) <= 2.5 AND off <= 1.5 AS INTEGER) AS candidate, CAST(ahead IS NULL AS INTEGER) AS open_tail FROM m""",
)
def stream_candidates(spark, sf):
    """The same over a stream of frames: each is decided when the frames that it needs have come."""
    source = spark.readStream.schema(table(spark, sf, "embeddings").schema).parquet(f"{sf}/embeddings.parquet*")
    x = F.posexplode(F.col("embedding").cast("array<double>")).alias("n", "x")
    rows = source.select(F.col("vec_id").cast("long").alias("stream"), x).select("stream", F.col("n").cast("long").alias("n"), (40 * F.col("x")).alias("level"), (10 * F.col("x")).alias("ratio"))
    found = lookahead.decide(rows, shared_folder(spark, "frames"), 2.0, 0.0)
    return found.select("stream", "n", (F.round("smooth", 6) + 0.0).alias("smooth"), (F.round("mad", 6) + 0.0).alias("mad"), F.col("candidate").cast("int").alias("candidate"), F.col("open_tail").cast("int").alias("open_tail"))


ROLL_MS = 1_800_000  #: for samples minutes apart; a receiver's chunks go back seven seconds
_OPEN_SQL = "(noise IS NULL OR noise < CAST(0.22 AS DOUBLE))"


@query(
    "pre_roll",
    f"""WITH {SAMPLES_SQL}, r AS (SELECT slot, event_id, {_OPEN_SQL} AS open, coalesce(lag({_OPEN_SQL}) OVER (PARTITION BY slot ORDER BY start_ms, event_id), false) AS before, count(*) OVER w AS chunks, CAST(sum(bytes) OVER w AS BIGINT) AS bytes FROM samples WINDOW w AS (PARTITION BY slot ORDER BY start_ms RANGE BETWEEN {ROLL_MS} PRECEDING AND CURRENT ROW))
 SELECT slot, event_id, chunks, bytes FROM r WHERE open AND NOT before""",
)
def pre_roll(spark, sf):
    """Where a slot's gate opens: what was heard shortly before is put into the new segment with it."""
    rows = samples(spark, sf).withColumn("open", gates.open_for_playback(F.col("noise"), gates.threshold(F.lit(SQUELCH))))
    linked = with_previous(rows.select("slot", "event_id", "start_ms", "bytes", "open"), ["start_ms", "event_id"], ["open"], DAY_MS, keys=["slot"]).drop("__bucket")
    held = with_trailing(linked, "slot", "start_ms", ROLL_MS, {"chunks": F.lit(1).cast("long"), "held": F.col("bytes")})
    return held.where(F.col("open") & ~F.coalesce("open_prev", F.lit(False))).select("slot", "event_id", "chunks", F.col("held").alias("bytes"))


@query(
    "rolling_templates",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT row_number() OVER (ORDER BY start_ms, event_id) - 1 AS n, 4 * score AS level, k % 20 / CAST(4 AS DOUBLE) AS ratio FROM samples), t AS (SELECT n FROM f WHERE n >= 199 AND n % 100 = 0),
 l AS (SELECT t.n, count(*) AS frames, list_sort(list(level)) AS v FROM t JOIN f ON f.n <= t.n AND f.n > t.n - 2000 GROUP BY 1), q AS (SELECT n, frames, v[CAST(floor(0.25 * (frames - 1)) AS INTEGER) + 1] AS q25, v[CAST(floor(0.75 * (frames - 1)) AS INTEGER) + 1] AS q75 FROM l),
 c AS (SELECT q.n, any_value(frames) AS frames, any_value(q25) AS q25, any_value(q75) AS q75, count(*) AS loud, median(ratio) AS mid, mad(ratio) AS off FROM q JOIN f ON f.n <= q.n AND f.n > q.n - 2000 AND level >= q75 GROUP BY 1)
 SELECT n, round(CASE WHEN frames >= 200 AND loud >= 50 THEN mid ELSE 0 END, 9) AS ratio, round(q75, 9) AS level, frames, loud, CAST(frames >= 200 AND loud >= 50 AND q75 - q25 >= 8 AND off <= 2 AS INTEGER) AS valid FROM c""",
)
def rolling_templates(spark, sf):
    """The noise template renewed at every hundredth frame over the last two thousand, with all that makes it valid."""
    order = ["start_ms", "event_id"]
    rows = with_previous(samples(spark, sf).select("event_id", "start_ms", (4 * F.col("score")).alias("level"), (F.col("k") % 20 / 4).alias("ratio"), F.lit(1).alias("one")), order, ["one"], DAY_MS)
    numbered = with_running_sum(rows, order, "one", "nth").select(F.lit(0).cast("long").alias("stream"), (F.col("nth") - 1).alias("n"), "level", "ratio")
    found = features.templates(numbered, "stream")
    return found.select("n", F.round("ratio", 9).alias("ratio"), F.round("level", 9).alias("level"), "frames", "loud", F.col("valid").cast("int").alias("valid"))
