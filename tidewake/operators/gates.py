"""Squelch thresholds, open and closed runs, and activity bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 48
MIN_OPEN_BYTES = 6400  #: 0.20 s at 16 kHz
HANG_BYTES = 4800  #: 0.15 s at 16 kHz


def threshold(squelch: Column) -> Column:
    """No gate at 0 or less; then lower with the setting, never under 0.04."""
    return F.when(squelch <= 0, F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.04), 0.38 - 0.008 * squelch))


def open_for_playback(noise: Column, limit: Column) -> Column:
    """What wasn't measured is open."""
    return noise.isNull() | (noise < limit)


def active_for_transcription(noise: Column, limit: Column) -> Column:
    """What wasn't measured is not active."""
    return F.coalesce(noise < limit, F.lit(False))


def gate_runs(spans: DataFrame, keys: list[str], is_open: Column) -> DataFrame:
    """Equal neighbours merged: keys, run_no (from 0), open, bytes, byte_start."""
    order = Window.partitionBy(*keys).orderBy("span_no")
    flagged = spans.withColumn("open", is_open)
    run = F.sum(F.coalesce((F.col("open") != F.lag("open").over(order)).cast("long"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("run_no", run).groupBy(*keys, "run_no", "open").agg(F.sum("bytes").alias("bytes"), F.min("byte_start").alias("byte_start"))


def hysteresis(runs: DataFrame, keys: list[str], min_open: int = MIN_OPEN_BYTES, hang: int = HANG_BYTES) -> DataFrame:
    """A closed gate opens only on a long enough open run; while open, a short closed run before an open one is bridged.

    Adds ``gate``. Runs alternate, so a chain is what no long closed run cuts: in it the gate opens with the
    first open run that is long enough and stays.
    """
    order = Window.partitionBy(*keys).orderBy("run_no")
    cut = (~F.col("open") & (F.col("bytes") > hang)).cast("long")
    chained = runs.withColumn("chain", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "chain").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max((F.col("open") & (F.col("bytes") >= min_open)).cast("long")).over(within) == 1
    more = F.coalesce(F.lead("open").over(order), F.lit(False))
    return chained.withColumn("gate", opened & (F.col("open") | ((F.col("bytes") <= hang) & more))).drop("chain")


def activity_bins(pieces: DataFrame, keys: list[str], active: Column, bins: int = BINS) -> DataFrame:
    """Share of each of ``bins`` equal parts of a segment that active pieces cover, 1 at most: keys, bin, activity (3 places, halves up).

    Each piece is unfolded to the bins it touches, so the interval join is an explode and an aggregate.
    """
    total = F.max("byte_end").over(Window.partitionBy(*keys)).alias("total")
    sized = pieces.select(*keys, "byte_start", "byte_end", active.alias("active"), total)
    width = F.col("total") / bins
    last = F.least(F.lit(bins - 1), F.floor((F.col("byte_end") - 1) * bins / F.col("total")))
    touched = sized.withColumn("bin", F.explode(F.sequence(F.floor(F.col("byte_start") * bins / F.col("total")), last)))
    shared = F.least("byte_end", (F.col("bin") + 1) * width) - F.greatest("byte_start", F.col("bin") * width)
    share = F.when(F.col("active"), F.greatest(F.lit(0.0), shared) / width).otherwise(0.0)
    return touched.groupBy(*keys, "bin").agg((F.floor(F.least(F.lit(1.0), F.sum(share)) * 1000 + 0.5) / 1000).alias("activity"))
