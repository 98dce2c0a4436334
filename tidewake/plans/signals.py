"""Levels, tones, fits, quantiles, envelopes and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.operators import signal
from tidewake.operators.ordered import quantiles_by
from tidewake.plans.registry import query
from tidewake.sources.domain import SAMPLES_SQL, samples, table

CLIPS_SQL = "clips AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _clips(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query("pcm_rms", f"WITH {CLIPS_SQL} SELECT vec_id, round(sqrt(sum(x * x) / count(*)), 9) AS rms, round(20 * log10(greatest(sqrt(sum(x * x) / count(*)), 1e-12)), 6) AS rms_db, round(20 * log10(greatest(max(abs(x)), 1e-12)), 6) AS peak_db FROM clips GROUP BY 1")
def pcm_rms(spark, sf):
    x = F.col("x")
    return _clips(spark, sf).select("vec_id", F.round(signal.rms(x), 9).alias("rms"), F.round(signal.dbfs(signal.rms(x)), 6).alias("rms_db"), F.round(signal.dbfs(signal.peak(x)), 6).alias("peak_db"))


@query("pcm_peaks", f"WITH {CLIPS_SQL}, p AS (SELECT vec_id, n // 4 AS bin, max(abs(x)) AS peak FROM clips WHERE n % 4 IN (0, 2) GROUP BY 1, 2) SELECT vec_id, CAST(bin AS BIGINT) AS bin, round(peak / max(peak) OVER (PARTITION BY vec_id), 9) AS peak FROM p")
def pcm_peaks(spark, sf):
    """The loudest of every second sample in each of 16 parts, against the clip's loudest part."""
    loud = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.greatest(F.abs(F.get("x", b * 4)), F.abs(F.get("x", b * 4 + 2))))
    rows = _clips(spark, sf).withColumn("p", loud).withColumn("top", F.array_max("p"))
    return rows.select("vec_id", F.posexplode("p").alias("bin", "peak"), "top").select("vec_id", F.col("bin").cast("long").alias("bin"), F.round(F.col("peak") / F.col("top"), 9).alias("peak"))


@query("activity_downsample", f"WITH {CLIPS_SQL} SELECT vec_id, CAST(b AS BIGINT) AS bin, round(max(x), 9) AS activity FROM clips, range(10) AS r(b) WHERE n >= floor(b * 6.4) AND n < greatest(floor((b + 1) * 6.4), floor(b * 6.4) + 1) GROUP BY 1, 2")
def activity_downsample(spark, sf):
    """64 bins to 10 of fractional width, by the maximum of each."""
    low = lambda b: F.floor(b * F.lit(6.4)).cast("int")
    bins = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: F.array_max(F.slice("x", low(b) + 1, F.greatest(F.lit(1), low(b + 1) - low(b)))))
    return _clips(spark, sf).select("vec_id", F.posexplode(bins).alias("bin", "activity")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("activity", 9).alias("activity"))


@query("goertzel_bands", f"WITH {CLIPS_SQL}, t AS (SELECT vec_id, f, sum(x * cos(2 * pi() * f / 64 * n)) AS re, sum(x * sin(2 * pi() * f / 64 * n)) AS im FROM clips, (VALUES (3), (7), (12), (20)) AS v(f) GROUP BY 1, 2) SELECT vec_id, CAST(f AS BIGINT) AS band, round(re * re + im * im, 6) AS power FROM t")
def goertzel_bands(spark, sf):
    bands = F.array(*[F.struct(F.lit(f).cast("long").alias("band"), F.round(signal.tone_power(F.col("x"), f / 64), 6).alias("power")) for f in (3, 7, 12, 20)])
    return _clips(spark, sf).select("vec_id", F.explode(bands).alias("b")).select("vec_id", "b.*")


@query("hann_window", f"WITH {CLIPS_SQL} SELECT vec_id, round(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63))), 9) AS weighted FROM clips GROUP BY 1")
def hann_window(spark, sf):
    return _clips(spark, sf).select("vec_id", F.round(signal.dot(F.col("x"), signal.hann(64)), 9).alias("weighted"))


@query(
    "fsk_bits",
    f"""WITH {CLIPS_SQL}, e AS (SELECT vec_id, n, count(*) OVER w AS c, sum(x * cos(2 * pi() * 13 / 240 * n)) OVER w AS mi, sum(x * sin(2 * pi() * 13 / 240 * n)) OVER w AS mq, sum(x * cos(2 * pi() * 21 / 240 * n)) OVER w AS si, sum(x * sin(2 * pi() * 21 / 240 * n)) OVER w AS sq FROM clips WINDOW w AS (PARTITION BY vec_id ORDER BY n ROWS 19 PRECEDING))
 SELECT vec_id, CAST(n AS BIGINT) AS n, round(mi * mi + mq * mq, 6) AS mark, round(si * si + sq * sq, 6) AS space FROM e WHERE c = 20""",
)
def fsk_bits(spark, sf):
    """Energy of the two keyed tones over the last twenty samples."""
    w = Window.partitionBy("vec_id").orderBy("n").rowsBetween(-19, 0)
    rows = _clips(spark, sf).select("vec_id", F.posexplode("x").alias("n", "x"))
    part = lambda f, turn: F.sum(F.col("x") * turn(2 * F.pi() * f / 240 * F.col("n"))).over(w)
    power = lambda f: F.round(part(f, F.cos) ** 2 + part(f, F.sin) ** 2, 6)
    return rows.select("vec_id", F.col("n").cast("long").alias("n"), power(13).alias("mark"), power(21).alias("space")).where("n >= 19")


@query(
    "quantiles_both",
    f"""WITH {SAMPLES_SQL}, v AS (SELECT channel, noise, row_number() OVER (PARTITION BY channel ORDER BY noise, event_id) - 1 AS i, count(*) OVER (PARTITION BY channel) AS n FROM samples WHERE noise IS NOT NULL)
 SELECT channel, round(quantile_cont(noise, 0.25), 9) AS q25, round(quantile_cont(noise, 0.75), 9) AS q75, min(CASE WHEN i = CAST(floor(0.25 * (n - 1)) AS BIGINT) THEN noise END) AS t25, min(CASE WHEN i = CAST(floor(0.75 * (n - 1)) AS BIGINT) THEN noise END) AS t75 FROM v GROUP BY 1""",
)
def quantiles_both(spark, sf):
    """Quartiles by interpolation and by truncation: they differ."""
    q = quantiles_by(samples(spark, sf).select("channel", "noise"), "channel", "noise", {"q25": 0.25, "q75": 0.75}, 0.01)
    return q.select("channel", F.round("q25", 9).alias("q25"), F.round("q75", 9).alias("q75"), F.col("q25_low").alias("t25"), F.col("q75_low").alias("t75"))


@query("median_mad", f"WITH {SAMPLES_SQL}, m AS (SELECT channel, median(score) AS med FROM samples GROUP BY 1) SELECT s.channel, round(any_value(med), 9) AS med, round(median(abs(score - med)), 9) AS mad FROM samples s JOIN m ON m.channel = s.channel GROUP BY 1")
def median_mad(spark, sf):
    rows = samples(spark, sf).select("channel", "score")
    med = quantiles_by(rows, "channel", "score", {"med": 0.5}, 0.1).select("channel", "med")
    off = rows.join(med, "channel").select("channel", F.abs(F.col("score") - F.col("med")).alias("off"))
    mad = quantiles_by(off, "channel", "off", {"mad": 0.5}, 0.1).select("channel", "mad")
    return med.join(mad, "channel").select("channel", F.round("med", 9).alias("med"), F.round("mad", 9).alias("mad"))


@query(
    "noise_template",
    f"""WITH {SAMPLES_SQL}, d AS (SELECT channel, start_ms // 86400000 AS day, score, bytes FROM samples), q AS (SELECT channel, day, count(*) AS n, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.75) AS q75 FROM d GROUP BY 1, 2),
 u AS (SELECT d.channel, d.day, any_value(n) AS n, any_value(q25) AS q25, any_value(q75) AS q75, count(*) AS m, median(bytes) AS med FROM d JOIN q ON q.channel = d.channel AND q.day = d.day WHERE score >= q75 GROUP BY 1, 2),
 v AS (SELECT d.channel, d.day, median(abs(bytes - med)) AS mad FROM d JOIN u ON u.channel = d.channel AND u.day = d.day WHERE score >= q75 GROUP BY 1, 2)
 SELECT u.channel, u.day, u.n, u.m, round(q25, 9) AS q25, round(q75, 9) AS q75, med, mad, CASE WHEN n >= 40 AND m >= 10 AND q75 - q25 >= 2 THEN 1 ELSE 0 END AS valid FROM u JOIN v ON v.channel = u.channel AND v.day = u.day""",
)
def noise_template(spark, sf):
    """Per channel and day: quartiles of level; median and deviation of the ratio among the loudest quarter; whether they can be trusted."""
    keys = ["channel", "day"]
    rows = samples(spark, sf).select("channel", F.floor(F.col("start_ms") / 86_400_000).alias("day"), "score", "bytes")
    q = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("score", 0.25).alias("q25"), F.percentile("score", 0.75).alias("q75"))
    loud = rows.join(q, keys).where("score >= q75")
    med = loud.groupBy(*keys, "n", "q25", "q75").agg(F.count("*").alias("m"), F.median("bytes").alias("med"))
    mad = loud.join(med.select(*keys, "med"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("bytes") - F.col("med"))).alias("mad"))
    valid = ((F.col("n") >= 40) & (F.col("m") >= 10) & (F.col("q75") - F.col("q25") >= 2)).cast("int")
    return med.join(mad, keys).select(*keys, "n", "m", F.round("q25", 9).alias("q25"), F.round("q75", 9).alias("q75"), "med", "mad", valid.alias("valid"))


DAYS_SQL = SAMPLES_SQL + ", d AS (SELECT channel, start_ms // 86400000 AS day, row_number() OVER (PARTITION BY channel, start_ms // 86400000 ORDER BY start_ms, event_id) AS n, event_id, score, noise FROM samples)"


def _days(spark, sf):
    rows = samples(spark, sf).withColumn("day", F.floor(F.col("start_ms") / 86_400_000))
    return rows.select("channel", "day", F.row_number().over(Window.partitionBy("channel", "day").orderBy("start_ms", "event_id")).cast("long").alias("n"), "event_id", "score", "noise")


@query("centred_median", f"WITH {DAYS_SQL} SELECT event_id, round(median(score) OVER (PARTITION BY channel, day ORDER BY n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS med FROM d")
def centred_median(spark, sf):
    near = F.array_sort(F.collect_list("score").over(Window.partitionBy("channel", "day").orderBy("n").rowsBetween(-5, 5)))
    rows = _days(spark, sf).select("event_id", near.alias("v")).withColumn("m", F.size("v"))
    return rows.select("event_id", F.round((F.get("v", F.floor((F.col("m") - 1) / 2).cast("int")) + F.get("v", F.floor(F.col("m") / 2).cast("int"))) / 2, 9).alias("med"))


@query(
    "sustained_runs",
    f"""WITH {DAYS_SQL}, c AS (SELECT *, score < 6 AS hit, n - row_number() OVER (PARTITION BY channel, day, score < 6 ORDER BY n) AS island FROM d), r AS (SELECT *, count(*) OVER (PARTITION BY channel, day, hit, island) AS size, row_number() OVER (PARTITION BY channel, day, hit, island ORDER BY n) AS place FROM c)
 SELECT event_id, CASE WHEN hit AND size >= 4 THEN 1 ELSE 0 END AS whole_run, CASE WHEN hit AND place > 3 THEN 1 ELSE 0 END AS after_three FROM r""",
)
def sustained_runs(spark, sf):
    """Candidates in runs of four or more: the whole run, or only what follows three earlier candidates."""
    keys = ["channel", "day", "hit"]
    rows = _days(spark, sf).withColumn("hit", F.col("score") < 6)
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy(*keys).orderBy("n")))
    run = Window.partitionBy(*keys, "island")
    return rows.select("event_id", (F.col("hit") & (F.count("*").over(run) >= 4)).cast("int").alias("whole_run"), (F.col("hit") & (F.row_number().over(run.orderBy("n")) > 3)).cast("int").alias("after_three"))


@query(
    "gate_envelope",
    f"""WITH {DAYS_SQL}, o AS (SELECT *, score >= 12 AS open FROM d), e AS (SELECT *, max(CASE WHEN open THEN n END) OVER (PARTITION BY channel, day ORDER BY n ROWS UNBOUNDED PRECEDING) AS before, min(CASE WHEN open THEN n END) OVER (PARTITION BY channel, day ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM o),
 r AS (SELECT event_id, CASE WHEN before IS NULL OR n - before >= 8 THEN 0.0 WHEN n - before <= 3 THEN 1.0 ELSE 0.5 + 0.5 * cos(pi() * (n - before - 3) / 5) END AS release, CASE WHEN after IS NULL OR after - n >= 3 THEN 0.0 ELSE 0.5 + 0.5 * cos(pi() * (after - n) / 3) END AS attack FROM e)
 SELECT event_id, round(0.0562 + (1 - 0.0562) * greatest(release, attack), 6) AS gain FROM r""",
)
def gate_envelope(spark, sf):
    """Full gain at and shortly after open frames, raised-cosine ramps on either side, a floor elsewhere."""
    w = Window.partitionBy("channel", "day").orderBy("n")
    at = F.when(F.col("score") >= 12, F.col("n"))
    since = F.col("n") - F.max(at).over(w.rowsBetween(Window.unboundedPreceding, 0))
    until = F.min(at).over(w.rowsBetween(0, 2)) - F.col("n")  # frames further off don't count; a frame without end is gone through anew for each row
    rows = _days(spark, sf).select("event_id", since.alias("since"), until.alias("until"))
    ramp = lambda x: 0.5 + 0.5 * F.cos(F.pi() * x)
    release = F.when(F.col("since").isNull() | (F.col("since") >= 8), 0.0).when(F.col("since") <= 3, 1.0).otherwise(ramp((F.col("since") - 3) / 5))
    attack = F.when(F.col("until").isNull() | (F.col("until") >= 3), 0.0).otherwise(ramp(F.col("until") / 3))
    return rows.select("event_id", F.round(0.0562 + (1 - 0.0562) * F.greatest(release, attack), 6).alias("gain"))


PAIRS_SQL = CLIPS_SQL + ", p AS (SELECT a.vec_id, a.n, a.x, b.x AS y FROM clips a JOIN clips b ON b.vec_id = a.vec_id + 1 AND b.n = a.n)"


def _pairs(spark, sf):
    clips = _clips(spark, sf)
    return clips.join(clips.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query("linear_fit", f"WITH {PAIRS_SQL} SELECT vec_id, round(regr_slope(y, x), 6) AS gain, round(regr_intercept(y, x), 6) AS shift, round(corr(y, x), 6) AS pearson FROM p GROUP BY 1")
def linear_fit(spark, sf):
    x, y, n = F.col("x"), F.col("y"), F.size("x")
    sx, sy, sxx, sxy, syy = signal.total(x), signal.total(y), signal.dot(x, x), signal.dot(x, y), signal.dot(y, y)
    rows = _pairs(spark, sf).select("vec_id", (sxy - sx * sy / n).alias("c"), (sxx - sx * sx / n).alias("vx"), (syy - sy * sy / n).alias("vy"), (sx / n).alias("mx"), (sy / n).alias("my"))
    gain = F.try_divide(F.col("c"), F.col("vx"))
    return rows.select("vec_id", F.round(gain, 6).alias("gain"), F.round(F.col("my") - gain * F.col("mx"), 6).alias("shift"), F.round(F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))), 6).alias("pearson"))


@query("si_sdr", f"WITH {PAIRS_SQL}, s AS (SELECT vec_id, sum(x * x) AS rr, sum(x * y) AS re, sum(y * y) AS ee FROM p GROUP BY 1) SELECT vec_id, round(10 * log10((re * re / rr) / (ee - re * re / rr)), 5) AS si_sdr FROM s WHERE rr > 0 AND ee - re * re / rr > 1e-12 AND re * re / rr > 0")
def si_sdr(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(signal.si_sdr(F.col("x"), F.col("y")), 5).alias("si_sdr")).where("si_sdr is not null")


@query(
    "lag_argmax",
    f"""WITH {CLIPS_SQL}, c AS (SELECT a.vec_id, l.lag, sum(a.x * b.x) AS corr FROM clips a, range(-8, 9) AS l(lag) JOIN clips b ON b.vec_id = a.vec_id + 1 AND b.n = a.n + l.lag GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(corr, 9) DESC, lag) AS rn FROM c) SELECT vec_id, CAST(lag AS BIGINT) AS lag, round(round(corr, 9), 6) AS corr FROM r WHERE rn = 1""",
)
def lag_argmax(spark, sf):
    """The shift at which a clip agrees best with the next."""
    def at(lag):
        n = F.size("x")
        left, right = F.slice("x", F.greatest(F.lit(1), 1 - lag), n - F.abs(lag)), F.slice("y", F.greatest(F.lit(1), 1 + lag), n - F.abs(lag))
        return F.struct((-F.round(signal.dot(left, right), 9)).alias("c"), lag.alias("lag"))

    best = F.array_min(F.transform(F.sequence(F.lit(-8), F.lit(8)), at))
    return _pairs(spark, sf).select("vec_id", best.alias("b")).select("vec_id", F.col("b.lag").cast("long").alias("lag"), F.round(-F.col("b.c"), 6).alias("corr"))


@query(
    "fm_discriminate",
    f"""WITH {CLIPS_SQL}, z AS (SELECT vec_id, n // 2 AS t, max(CASE WHEN n % 2 = 0 THEN x END) AS i, max(CASE WHEN n % 2 = 1 THEN x END) AS q FROM clips GROUP BY 1, 2), l AS (SELECT *, lag(i) OVER w AS pi_, lag(q) OVER w AS pq FROM z WHERE i * i + q * q > 1e-6 WINDOW w AS (PARTITION BY vec_id ORDER BY t))
 SELECT vec_id, CAST(t AS BIGINT) AS t, round(atan2(pi_ * q - pq * i, pi_ * i + pq * q), 9) AS phase FROM l WHERE pi_ IS NOT NULL""",
)
def fm_discriminate(spark, sf):
    """Phase steps between neighbouring complex samples; those of hardly any size are passed over."""
    rows = _clips(spark, sf).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.struct(F.get("x", 2 * t).alias("i"), F.get("x", 2 * t + 1).alias("q")))).alias("t", "z")).select("vec_id", "t", "z.*").where("i * i + q * q > 1e-6")
    w = Window.partitionBy("vec_id").orderBy("t")
    rows = rows.withColumn("a", F.lag("i").over(w)).withColumn("b", F.lag("q").over(w)).where("a is not null")
    return rows.select("vec_id", F.col("t").cast("long").alias("t"), F.round(F.atan2(F.expr("a * q - b * i"), F.expr("a * i + b * q")), 9).alias("phase"))


@query(
    "fir_decimate",
    f"""WITH {CLIPS_SQL}, g AS (SELECT j, CASE WHEN j = 7 THEN 1 ELSE sin(pi() * 0.2 * (j - 7)) / (pi() * 0.2 * (j - 7)) END * (0.42 - 0.5 * cos(2 * pi() * j / 14) + 0.08 * cos(4 * pi() * j / 14)) AS g FROM range(15) AS r(j)), h AS (SELECT j, g / (SELECT sum(g) FROM g) AS h FROM g)
 SELECT vec_id, CAST(n // 5 AS INTEGER) AS t, round(sum(h * y), 9) + 0.0 AS y FROM (SELECT a.vec_id, a.n, h.h, coalesce(b.x, 0) AS y FROM clips a, h LEFT JOIN clips b ON b.vec_id = a.vec_id AND b.n = a.n - h.j WHERE a.n % 5 = 0) GROUP BY 1, 2""",
)
def fir_decimate(spark, sf):
    rows = signal.decimate(_clips(spark, sf), "vec_id", 15, 0.1, 5)
    return rows.select("vec_id", F.posexplode("y").alias("t", "y")).select("vec_id", "t", (F.round("y", 9) + 0.0).alias("y"))


@query(
    "limiter",
    f"""WITH RECURSIVE {CLIPS_SQL}, g AS (SELECT vec_id, n, 4 * x AS x, least(CAST(1 AS DOUBLE), CAST(0.891 AS DOUBLE) / greatest(max(abs(4 * x)) OVER (PARTITION BY vec_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING), 1e-12)) AS goal FROM clips),
 w AS (SELECT vec_id, n, x, goal AS gain FROM g WHERE n = 0 UNION ALL SELECT g.vec_id, g.n, g.x, CASE WHEN g.goal < w.gain THEN g.goal ELSE w.gain + (g.goal - w.gain) * CAST(0.05 AS DOUBLE) END FROM w JOIN g ON g.vec_id = w.vec_id AND g.n = w.n + 1)
 SELECT vec_id, CAST(n AS INTEGER) AS t, round(greatest(CAST(-0.891 AS DOUBLE), least(CAST(0.891 AS DOUBLE), x * gain)), 9) + 0.0 AS y FROM w""",
)
def limiter(spark, sf):
    rows = signal.limit_ahead(_clips(spark, sf).select("vec_id", F.transform("x", lambda x: x * 4).alias("x")), "vec_id", 8, 0.05, 0.891)
    return rows.select("vec_id", F.posexplode("y").alias("t", "y")).select("vec_id", "t", (F.round("y", 9) + 0.0).alias("y"))
