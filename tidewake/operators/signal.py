"""Levels, tones, windows, filters and quality of sampled signals.

A clip's samples are one array of doubles in its row, so what concerns one clip is a fold over that array;
what concerns neighbours across clips is a window over exploded samples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def rms(xs: Column) -> Column:
    """0 for an empty clip."""
    return F.when(F.size(xs) > 0, F.sqrt(total(F.transform(xs, lambda x: x * x)) / F.size(xs))).otherwise(0.0)


def dbfs(level: Column) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(1e-12)))


def peak(xs: Column) -> Column:
    return F.array_max(F.transform(xs, lambda x: F.abs(x)))


def tone_power(xs: Column, cycles_per_sample: float) -> Column:
    """Squared magnitude of the clip against one tone, by its two sums."""
    w = 2 * math.pi * cycles_per_sample
    re = total(F.transform(xs, lambda x, i: x * F.cos(F.lit(w) * i)))
    im = total(F.transform(xs, lambda x, i: x * F.sin(F.lit(w) * i)))
    return re * re + im * im


def hann(n: int) -> Column:
    """The window's weights, for sizes above 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1)))


def dot(xs: Column, ys: Column) -> Column:
    return total(F.zip_with(xs, ys, lambda a, b: a * b))


def si_sdr(reference: Column, estimate: Column) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB; null if either carries no energy."""
    rr, re, ee = dot(reference, reference), dot(reference, estimate), dot(estimate, estimate)
    signal = F.try_divide(re * re, rr)
    return F.when((rr > 0) & (ee - signal > 1e-12) & (signal > 0), 10 * F.log10(F.try_divide(signal, ee - signal)))


def fit(xs: Column, ys: Column) -> Column:
    """Least squares of ``ys`` by ``xs`` of one length: n, pearson, gain_db, shift, and the rest's level over either's in dB; null without samples or spread."""
    n = F.size(xs)
    mx, my = F.try_divide(total(xs), n), F.try_divide(total(ys), n)
    xx, xy, yy = dot(xs, xs), dot(xs, ys), dot(ys, ys)
    vx, c, vy = xx - n * mx * mx, xy - n * mx * my, yy - n * my * my
    gain = F.try_divide(c, vx)
    rest = F.greatest(F.lit(0.0), vy - gain * c)
    level = lambda power: F.when(power > 0, 10 * F.log10(F.greatest(F.try_divide(rest, power), F.lit(1e-30))))
    return F.when(
        (n > 0) & (vx > 0) & (vy > 0),
        F.struct(
            n.cast("long").alias("n"), F.try_divide(c, F.sqrt(F.greatest(F.lit(0.0), vx * vy))).alias("pearson"), (20 * F.log10(F.greatest(F.abs(gain), F.lit(1e-15)))).alias("gain_db"), (my - gain * mx).alias("shift"),
            level(yy).alias("rest_over_output_db"), level(xx).alias("rest_over_input_db"),
        ),
    )


def follow(xs: Column, rise: float, fall: float | None = None) -> Column:
    """The last value of what follows ``xs`` from 0: each step takes ``rise`` of the way up, or ``fall`` of the way down; 0 for an empty clip."""
    part = lambda s, x: F.lit(rise) if fall is None else F.when(x > s, rise).otherwise(fall)
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - s) * part(s, x))


def speech_metrics(rows: DataFrame, key: str) -> DataFrame:
    """Of samples (r meant, e enhanced, z noisy, speech, tail): one row a key by sums alone. A key whose speech carries no energy has no row.

    key, speech_samples, snr, input_snr, gained, si_sdr (both without their mean), rms_change, projected_gain, quiet_tail, all in dB.
    """
    r, e, z = F.col("r"), F.col("e"), F.col("z")
    within = lambda c: F.coalesce(F.sum(F.when(F.col("speech"), c)), F.lit(0.0))
    quiet = F.col("tail") & ~F.col("speech")
    sums = rows.groupBy(key).agg(
        F.count_if("speech").alias("n"), within(r).alias("sr"), within(e).alias("se"), within(r * r).alias("rr"), within(e * e).alias("ee"), within(r * e).alias("re"),
        within((e - r) * (e - r)).alias("err"), within((z - r) * (z - r)).alias("was"), F.coalesce(F.avg(F.when(quiet, e * e)), F.lit(0.0)).alias("quiet"),
    ).where("rr > 0")
    n, some = F.col("n"), lambda c, least=1e-30: F.greatest(c, F.lit(least))
    spread, shared, heard = F.col("rr") - F.col("sr") * F.col("sr") / n, F.col("re") - F.col("sr") * F.col("se") / n, F.col("ee") - F.col("se") * F.col("se") / n
    part = shared / some(spread)
    return sums.select(
        key, n.alias("speech_samples"), (10 * F.log10(F.col("rr") / some(F.col("err")))).alias("snr"), (10 * F.log10(F.col("rr") / some(F.col("was")))).alias("input_snr"),
        (10 * F.log10(some(F.col("was")) / some(F.col("err")))).alias("gained"), (10 * F.log10(some(part * shared) / some(heard - part * shared))).alias("si_sdr"),
        (20 * F.log10(some(F.sqrt(F.col("ee") / n), 1e-12) / some(F.sqrt(F.col("rr") / n), 1e-12))).alias("rms_change"), (20 * F.log10(some(F.abs(part), 1e-12))).alias("projected_gain"),
        (20 * F.log10(some(F.sqrt("quiet"), 1e-12))).alias("quiet_tail"),
    )


def loudest_window(xs: Column, size: int, hop: int) -> Column:
    """Where the window with the most energy starts (from 0): of windows every ``hop`` samples, the first of the loudest, with its energy to nine places."""
    last = F.greatest(F.lit(0), F.size(xs) - size)
    energy = lambda at: F.round(total(F.transform(F.slice(xs, at + 1, size), lambda x: x * x)), 9)
    best = F.array_min(F.transform(F.sequence(F.lit(0), last, F.lit(hop)), lambda at: F.struct((-energy(at)).alias("quiet"), at.alias("start"))))
    return F.struct(best["start"].cast("long").alias("start"), (-best["quiet"]).alias("energy"))


def band_ratio(clips: DataFrame, key: str, rate: int, low: tuple[int, int], high: tuple[int, int], step: int = 100) -> DataFrame:
    """key, ratio: mean power of the low band's tones over that of the high band's in dB, of each windowed clip."""
    bands = [np.arange(a, b + 1, step) for a, b in (low, high)]

    def power(x, tones):
        n = np.arange(len(x))
        window = 0.5 - 0.5 * np.cos(2 * np.pi * n / max(1, len(x) - 1))
        return (np.abs(np.exp(-2j * np.pi / rate * np.outer(tones, n)) @ (x * window)) ** 2).mean()

    def run(batches):
        for batch in batches:
            heard = (np.asarray(v.values, dtype=float) for v in batch.column(1))
            out = [float(10 * np.log10((power(x, bands[0]) + 1e-20) / (power(x, bands[1]) + 1e-20))) for x in heard]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [key, "ratio"])

    return clips.select(key, "x").mapInArrow(run, f"{key} long, ratio double")


def middle(sorted_values: Column) -> Column:
    """Of an ordered array: its median."""
    n = F.size(sorted_values)
    return (F.get(sorted_values, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_values, F.floor(n / 2).cast("int"))) / 2


def low_pass(taps: int, cutoff: float) -> np.ndarray:
    """Symmetric windowed-sinc coefficients that add up to one; ``cutoff`` in cycles per sample."""
    n = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * np.blackman(taps)
    return h / h.sum()


def decimate(clips: DataFrame, key: str, taps: int, cutoff: float, factor: int) -> DataFrame:
    """key, y: each clip filtered (zeros before its start) and every ``factor``-th sample kept."""
    h = low_pass(taps, cutoff)

    def run(batches):
        for batch in batches:
            out = [np.convolve(np.asarray(v.values, dtype=float), h)[: len(v)][::factor] for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o.tolist() for o in out], pa.list_(pa.float64()))], [key, "y"])

    return clips.select(key, "x").mapInArrow(run, f"{key} long, y array<double>")


def limit_ahead(clips: DataFrame, key: str, ahead: int, release: float, ceiling: float) -> DataFrame:
    """key, y: gain falls at once to what the loudest of the next ``ahead`` samples allows, and rises again slowly."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = np.asarray(v.values, dtype=float)
                ahead_of = np.concatenate([np.abs(x), np.zeros(ahead)])
                loud = np.lib.stride_tricks.sliding_window_view(ahead_of, ahead + 1).max(axis=1) if len(x) else x
                target = np.minimum(1.0, ceiling / np.maximum(loud, 1e-12))
                gain, y = 1.0, np.empty(len(x))
                for i, t in enumerate(target):
                    gain = t if t < gain else gain + (t - gain) * release
                    y[i] = max(-ceiling, min(ceiling, x[i] * gain))
                out.append(y.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "y"])

    return clips.select(key, "x").mapInArrow(run, f"{key} long, y array<double>")
