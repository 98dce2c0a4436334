"""Long sampled streams, filtered and measured in blocks that overlap.

A stream is rows of (stream, at, i, q): arrays of samples and the number of the first. A block takes the pieces that touch it or lie within
reach of its filters before it, so one grouping by block makes all blocks independent, whatever the stream's length: what a block
puts out equals what one pass over the whole stream would. An oscillator's phase follows from a sample's number, so it is
continuous over blocks without being carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples in a block; a multiple of what the two decimations keep one of.
BLOCK = 102_400
FRAME = 4096


def low_pass(taps: int, cutoff_hz: float, rate: float) -> np.ndarray:
    """Symmetric coefficients that add up to one: a sinc under a Blackman window."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff_hz / rate * n) * np.blackman(taps)
    h = (h + h[::-1]) / 2
    return h / h.sum()


def every(x: np.ndarray, h: np.ndarray, factor: int) -> np.ndarray:
    """``x`` filtered, of which the last of each ``factor`` samples stays; the first ``len(h) - 1`` samples are history only."""
    windows = np.lib.stride_tricks.sliding_window_view(x, len(h))[factor - 1 :: factor]
    return windows @ h[::-1]


def _pieces(stream: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row for each piece and number between ``first`` and ``last``."""
    return stream.where(F.size("i") > 0).withColumn("block", F.explode(F.sequence(first, last)))


def _filled(table: pa.Table, begin: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Complex samples from number ``begin`` on, and which of them there are."""
    x, there = np.zeros(size, complex), np.zeros(size, bool)
    i, q = (table.column(c).combine_chunks() for c in ("i", "q"))
    lengths = i.value_lengths().to_numpy()
    first = table.column("at").to_numpy() - begin - (np.cumsum(lengths) - lengths)
    place = np.repeat(first, lengths) + np.arange(lengths.sum())
    near = (place >= 0) & (place < size)
    x[place[near]] = i.flatten().to_numpy()[near] + 1j * q.flatten().to_numpy()[near]
    there[place[near]] = True
    return x, there


def channelize(stream: DataFrame, rate: int, offset_hz: int, stages: list[tuple[int, float, int]] = ((63, 120_000, 5), (511, 9_000, 5)), block: int = BLOCK) -> DataFrame:
    """stream, at, i, q: the channel ``offset_hz`` beside the middle, mixed down, then filtered and thinned by each stage (taps, cut-off, factor).

    ``at`` counts the samples that stay. Missing samples, those before the first too, are zeros; an output whose newest sample isn't there is left out.
    """
    factor = math.prod(f for _, _, f in stages)
    if block % factor:
        raise ValueError(f"a block must hold a multiple of {factor} samples")
    filters, reach, step = [], 0, 1
    for taps, cutoff, by in stages:
        filters.append((low_pass(taps, cutoff, rate / step), by))
        reach += (taps - 1) * step
        step *= by
    history = -(-reach // factor) * factor  # whole outputs, so that each stage's phase is the stream's
    period = rate // math.gcd(rate, abs(offset_hz)) if offset_hz else 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[1].as_py()
        begin = number * block - history
        x, there = _filled(table, begin, history + block)
        # whole periods are left out before a sample's number becomes a phase, so it stays exact far into a stream
        x = x * np.exp(-2j * np.pi * (offset_hz * ((begin + np.arange(len(x))) % period) % rate) / rate)
        for h, by in filters:
            # one output more than is needed at the front has no whole history: it is cut off below
            x = every(np.concatenate([np.zeros(len(h) - 1, complex), x]), h, by)
        new = x[history // factor :]
        keep = np.flatnonzero(there[history + factor - 1 :: factor])
        runs = np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1) if len(keep) else []
        columns = [[key[0].as_py()] * len(runs), [number * (block // factor) + int(r[0]) for r in runs], [new[r].real.tolist() for r in runs], [new[r].imag.tolist() for r in runs]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (key[0].type, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["stream", "at", "i", "q"])

    last = F.floor((F.col("at") + F.size("i") - 1 + history) / block)
    kind = stream.schema["stream"].dataType.simpleString()
    return _pieces(stream, F.floor(F.col("at") / block), last).groupBy("stream", "block").applyInArrow(run, f"stream {kind}, at long, i array<double>, q array<double>")


def channel_ratio(power: np.ndarray, centre: int) -> float | None:
    """Mean power within 7 bins of ``centre`` over that of the bins 12 to 20 beside it; in the middle of the band the innermost three are left out."""
    away = np.arange(-20, 21)
    size = np.abs(away)
    signal, noise = (size <= 7) & ((centre != 0) | (size > 1)), size >= 12
    at = power[(centre + away) % len(power)]
    return float(at[signal].mean() / at[noise].mean()) if at[noise].sum() > 0 else None


def framed_spectrum(stream: DataFrame, rate: int, offsets_hz: list[int], stride: int = 8 * FRAME) -> DataFrame:
    """stream, frame, offset_hz, excess: how far a channel's power is above its surroundings (0 at least), in a frame each ``stride`` samples.

    A frame is ``FRAME`` samples under a Hann window, from as many stored pieces as it takes; frames with a missing sample are left out.
    Pieces that lie in no frame are dropped before the shuffle.
    """
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))
    bins = [(f, int(math.copysign(math.floor(abs(f) * FRAME / rate + 0.5), f))) for f in offsets_hz]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, there = _filled(table, key[1].as_py() * stride, FRAME)
        power = np.abs(np.fft.fft(x * window)) ** 2
        found = [(f, max(0.0, r - 1)) for f, b in bins if (r := channel_ratio(power, b)) is not None] if there.all() else []
        columns = [[key[0].as_py()] * len(found), [key[1].as_py()] * len(found), [f for f, _ in found], [e for _, e in found]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (key[0].type, pa.int64(), pa.int64(), pa.float64()), strict=True)], ["stream", "frame", "offset_hz", "excess"])

    first = F.floor(F.greatest(F.col("at") - FRAME + 1, F.lit(0)) / stride)
    near = _pieces(stream, first, F.floor((F.col("at") + F.size("i") - 1) / stride)).where((F.col("block") * stride < F.col("at") + F.size("i")) & (F.col("block") * stride + FRAME > F.col("at")))
    kind = stream.schema["stream"].dataType.simpleString()
    return near.groupBy("stream", "block").applyInArrow(run, f"stream {kind}, frame long, offset_hz long, excess double")
