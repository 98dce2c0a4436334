"""Queries over one long stream of samples: the stored vectors laid end to end, two components a sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators import alignment, channelizer
from tidewake.plans.registry import query
from tidewake.sources.domain import table

RATE = 2_400_000
STREAM_SQL = "z AS (SELECT 32 * vec_id + t AS n, CAST(embedding[2 * t + 1] AS DOUBLE) AS i, CAST(embedding[2 * t + 2] AS DOUBLE) AS q FROM embeddings, range(32) AS r(t))"


def _stream(spark, sf):
    part = lambda k: F.transform(F.sequence(F.lit(k), F.lit(62 + k), F.lit(2)), lambda at: F.get("embedding", at).cast("double"))
    return table(spark, sf, "embeddings").select(F.lit(0).cast("long").alias("stream"), (32 * F.col("vec_id")).alias("at"), part(0).alias("i"), part(1).alias("q"))


def _taps_sql(name: str, taps: int, cutoff: float, rate: float) -> str:
    c, f = (taps - 1) // 2, cutoff / rate
    return f"""{name}_g AS (SELECT j, CASE WHEN j = {c} THEN 1 ELSE sin(2 * pi() * {f!r}::DOUBLE * (j - {c})) / (2 * pi() * {f!r}::DOUBLE * (j - {c})) END * (0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {taps - 1}) + 0.08::DOUBLE * cos(4 * pi() * j / {taps - 1})) AS g FROM range({taps}) AS r(j)),
 {name} AS (SELECT j, g / (SELECT sum(g) FROM {name}_g) AS h FROM {name}_g)"""


def _fir_sql(taps: str, source: str) -> str:
    return f"(SELECT m, sum(h * i) AS i, sum(h * q) AS q FROM (SELECT n // 5 AS m, n FROM {source} WHERE n % 5 = 4) o, {taps} JOIN {source} s ON s.n = o.n - j GROUP BY m)"


@query(
    "oscillator_mix",
    f"WITH {STREAM_SQL}, p AS (SELECT n, i, q, -2 * pi() * ((25000 * n) % {RATE}) / {RATE} AS a FROM z) SELECT n, round(i * cos(a) - q * sin(a), 9) + 0.0 AS i, round(i * sin(a) + q * cos(a), 9) + 0.0 AS q FROM p",
)
def oscillator_mix(spark, sf):
    """Each sample turned by an oscillator whose phase is its number's, so it goes on wherever the stream is cut."""
    rows = channelizer.channelize(_stream(spark, sf), RATE, 25_000, stages=[])
    return rows.select("at", F.posexplode(F.arrays_zip("i", "q")).alias("k", "z")).select((F.col("at") + F.col("k")).alias("n"), (F.round("z.i", 9) + 0.0).alias("i"), (F.round("z.q", 9) + 0.0).alias("q"))


@query(
    "channelize_stream",
    f"""WITH {STREAM_SQL}, p AS (SELECT n, i, q, -2 * pi() * ((25000 * n) % {RATE}) / {RATE} AS a FROM z), x AS (SELECT n, i * cos(a) - q * sin(a) AS i, i * sin(a) + q * cos(a) AS q FROM p),
 {_taps_sql("ha", 63, 120_000, RATE)}, {_taps_sql("hb", 511, 9_000, RATE / 5)}, y AS (SELECT m AS n, i, q FROM {_fir_sql("ha", "x")}), w AS (SELECT m AS n, i, q FROM {_fir_sql("hb", "y")})
 SELECT n, round(i, 9) + 0.0 AS i, round(q, 9) + 0.0 AS q FROM w""",
)
def channelize_stream(spark, sf):
    """A channel of the stream, mixed down, filtered by 63 and then 511 taps, one sample in five kept each time."""
    rows = channelizer.channelize(_stream(spark, sf), RATE, 25_000)
    return rows.select("at", F.posexplode(F.arrays_zip("i", "q")).alias("k", "z")).select((F.col("at") + F.col("k")).alias("n"), (F.round("z.i", 9) + 0.0).alias("i"), (F.round("z.q", 9) + 0.0).alias("q"))


OFFSETS = [-300_000, 0, 25_000]
STRIDE = 6_144  # the reference's is 32,768, of which the small tables hold one at most


@query(
    "framed_spectrum",
    f"""WITH {STREAM_SQL}, f AS (SELECT n // {STRIDE} AS frame, n % {STRIDE} AS t, i, q, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (n % {STRIDE}) / 4095) AS w FROM z WHERE n % {STRIDE} < 4096), whole AS (SELECT frame FROM f GROUP BY 1 HAVING count(*) = 4096),
 o AS (SELECT off, CASE WHEN off < 0 THEN -1 ELSE 1 END * CAST(floor(abs(off) * 4096 / {RATE} + 0.5) AS BIGINT) AS mid FROM (VALUES {", ".join(f"({f})" for f in OFFSETS)}) v(off)),
 b AS (SELECT off, mid, d, (mid + d + 4096) % 4096 AS bin FROM o, range(-20, 21) AS r(d) WHERE (abs(d) <= 7 OR abs(d) >= 12) AND NOT (mid = 0 AND abs(d) <= 1)), bins AS (SELECT DISTINCT bin FROM b),
 dft AS (SELECT frame, bin, sum(w * (i * cos(a) + q * sin(a))) AS re, sum(w * (q * cos(a) - i * sin(a))) AS im FROM (SELECT frame, bin, w, i, q, 2 * pi() * ((bin * t) % 4096) / 4096 AS a FROM f SEMI JOIN whole USING (frame), bins) GROUP BY 1, 2)
 SELECT frame, CAST(off AS BIGINT) AS offset_hz, round(greatest(0, avg(re * re + im * im) FILTER (WHERE abs(d) <= 7) / avg(re * re + im * im) FILTER (WHERE abs(d) >= 12) - 1), 6) + 0.0 AS excess FROM dft JOIN b USING (bin) GROUP BY 1, 2""",
)
def framed_spectrum(spark, sf):
    """How far channels rise above their surroundings, frame by frame of 4096 samples, cut across the stored pieces."""
    rows = channelizer.framed_spectrum(_stream(spark, sf), RATE, OFFSETS, STRIDE)
    return rows.select("frame", "offset_hz", (F.round("excess", 6) + 0.0).alias("excess"))


#: Clips of 6400 samples: a hundred vectors each. The second of a pair is the first a shift later, half as loud, with the next clip's sound over it.
_SHIFT = "(137 * (clip % 5) - 250)"


@query("best_alignment")  # in SQL, all lags against all samples take minutes; tests try all lags by hand
def best_alignment(spark, sf):
    """The shift of each clip against a later, weaker copy of it, by the correlation of its loudest window at all lags."""
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("clip"), (F.col("vec_id") % 100).alias("part"), F.col("embedding").cast("array<double>").alias("v"))
    clips = rows.groupBy("clip").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "v"))), lambda s: s["v"])).alias("x")).where(F.size("x") == 6400)  # a hundred vectors each
    later = clips.select((F.col("clip") - 1).alias("clip"), F.col("x").alias("over"))
    shift = F.expr(_SHIFT).cast("int")
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)))
    moved = F.concat(zeros(shift), F.slice("x", F.greatest(1 - shift, F.lit(1)), 6400 - F.abs(shift)), zeros(-shift))
    pairs = clips.join(later, "clip", "left").select("clip", "x", F.zip_with(moved, F.coalesce("over", zeros(F.lit(6400))), lambda a, b: a / 2 + b / 4).alias("y"))
    return alignment.align(pairs, "clip", 1600, 800, 1000).select("clip", "lag", F.round("score", 6).alias("score"))
