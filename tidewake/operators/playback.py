"""Band-limited, squelched and levelled play-back of clips: a recursion along each clip's samples.

A clip is one array in its row, so a filter's state lives and ends within a row.
"""

from __future__ import annotations

import math
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.folds import strong_gain

HOLD_BLOCKS = 20
# Pass band in Hz and boost of each mode.
BANDS = {"voice": (250, 3200, 1.2), "strong": (350, 2400, 1.45)}


def band_limited(xs: list[float], rate: int, low: float, high: float) -> list[float]:
    """Two one-pole high passes, then two one-pole low passes."""
    step = 1 / rate
    high_pass = 1 / (1 + 2 * math.pi * low * step)
    low_pass = step / (1 / (2 * math.pi * high) + step)
    for _ in range(2):
        y, before, out = 0.0, 0.0, []
        for x in xs:
            y = high_pass * (y + x - before)
            before = x
            out.append(y)
        xs = out
    for _ in range(2):
        y, out = 0.0, []
        for x in xs:
            y += low_pass * (x - y)
            out.append(y)
        xs = out
    return xs


def cleaned(xs: list[float], rate: int, mode: str, squelch: float) -> list[float]:
    """Blocks of 10 ms below the squelch are closed after a hold; the gain glides, up faster than down. Values stay within -1 and 1.

    Without a mode of ``BANDS`` nothing is filtered or boosted; an empty clip stays empty.
    """
    limit = max(0.0, min(100.0, squelch)) * 0.00075
    low, high, boost = BANDS.get(mode, (0, 0, 1.0))
    if mode not in BANDS and limit == 0:
        return xs
    samples = iter(band_limited(xs, rate, low, high) if mode in BANDS else xs)
    gain, held, floor, out = 1.0, 0, None, []
    while block := list(islice(samples, max(1, round(rate / 100)))):
        level = math.sqrt(sum(x * x for x in block) / len(block))
        held = HOLD_BLOCKS if level >= limit else max(0, held - 1)
        wanted = 1.0 if limit == 0 or held else 0.0
        if mode == "strong":
            floor, (_, above) = strong_gain(floor, {"level": level})
            wanted *= above
        for x in block:
            gain += (wanted - gain) * (0.18 if wanted > gain else 0.08)
            out.append(max(-1.0, min(1.0, x * gain * boost)))
    return out


def clean(clips: DataFrame, column: str, rate: int, mode: str = "voice", squelch: float = 0.0) -> DataFrame:
    """``clips`` with the samples in ``column`` cleaned; null clips stay null, null samples count as silence."""
    at = clips.columns.index(column)

    def run(batches):
        for batch in batches:
            done = [None if c is None else cleaned([x or 0.0 for x in c], rate, mode, squelch) for c in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(done, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    doubles = clips.withColumn(column, F.col(f"`{column}`").cast("array<double>"))
    return doubles.mapInArrow(run, doubles.schema)
