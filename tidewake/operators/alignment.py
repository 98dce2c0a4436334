"""At which shift one sound agrees best with another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE = 16_000


def loudest(x: np.ndarray, size: int, hop: int) -> tuple[int, int]:
    """The window of ``size`` samples, one each ``hop``, with the most energy; the first of equal ones (to nine places)."""
    size = min(size, len(x))
    upto = np.concatenate([[0.0], np.cumsum(x * x)])
    starts = np.arange(0, max(1, len(x) - size + 1), hop)
    start = int(starts[np.argmax(np.round(upto[starts + size] - upto[starts], 9))])
    return start, start + size


def best_lag(x: np.ndarray, y: np.ndarray, size: int, hop: int, most: int) -> tuple[int, float] | None:
    """The lag (y against x, up to ``most`` either way) with the highest normalised correlation of x's loudest window, to nine places, the smallest of equal ones.

    All products come from one Fourier transform and all energies from running sums, so it takes time in proportion to the samples and lags
    beside each other, not to their product. Where nothing overlaps the score is -1; a clip without samples has no lag.
    """
    if not len(x) or not len(y):
        return None
    begin, end = loudest(x, size, hop)
    lags = np.arange(-most, most + 1)
    a, b = np.maximum(begin, -lags), np.minimum(end, len(y) - lags)
    n = 1 << int(np.ceil(np.log2(end - begin + len(y))))
    product = np.fft.irfft(np.conj(np.fft.rfft(x[begin:end], n)) * np.fft.rfft(y, n), n)  # at k: the window's start against y[k]
    at = begin + lags
    xy = np.where((at > begin - end) & (at < len(y)), product[at % n], 0.0)
    xs, ys = (np.concatenate([[0.0], np.cumsum(v * v)]) for v in (x, y))
    some = b > a
    a, b = np.where(some, a, 0), np.where(some, b, 0)
    score = np.where(some, xy / np.sqrt(np.maximum((xs[b] - xs[a]) * (ys[np.clip(b + lags, 0, len(y))] - ys[np.clip(a + lags, 0, len(y))]), 1e-30)), -1.0)
    best = int(np.argmax(np.round(score, 9)))
    return int(lags[best]), float(score[best])


def align(pairs: DataFrame, key: str, size: int = RATE // 2, hop: int = RATE // 4, most: int = 3_200) -> DataFrame:
    """``pairs``: key, x, y (arrays of samples, of any lengths). key, lag, score; null ones without samples."""

    def run(batches):
        for batch in batches:
            xs, ys = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))
            values = lambda v: np.asarray(v.values, float) if v.is_valid else np.zeros(0)
            found = [best_lag(values(x), values(y), size, hop, most) or (None, None) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], [key, "lag", "score"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "x", "y").mapInArrow(run, f"{key} {kind}, lag long, score double")
