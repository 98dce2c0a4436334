"""Finding frames in bit streams: a fold over each stream's ordered symbols."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions import dsc

PHASING = 125
ENDS = dsc.ENDS
LONGEST = 40
STRIDE = 20


def bit_streams(samples: DataFrame) -> DataFrame:
    """One stream per sample: stray bits, then phasing, a short message and its end, each symbol followed by a filler word; every third is inverted, every seventh has a damaged symbol."""
    k = F.col("k")
    symbols = F.array(F.lit(PHASING), F.lit(PHASING), F.lit(120), F.lit(120), k.cast("int"), (k % 50).cast("int"), F.lit(24), F.lit(7), F.lit(100), F.lit(117))
    damage = lambda i: F.when((k % 7 == 0) & (i == 6), 8).otherwise(0)
    word = lambda s, i: F.concat(F.lpad(F.bin(dsc.codeword(s).bitwiseXOR(damage(i))), 10, "0"), F.lpad(F.bin(dsc.codeword(F.lit(0))), 10, "0"))
    stray = F.repeat(F.lit("0"), (k % 20).cast("int"))
    bits = F.concat(stray, F.array_join(F.transform(symbols, word), ""))
    return samples.select(F.col("event_id").alias("stream"), F.when(k % 3 == 0, F.translate(bits, "01", "10")).otherwise(bits).alias("bits"))


def read_frames(bits: str) -> list[tuple[list[int], bool]]:
    """(symbols, whether all were valid). Phasing met twice, twenty bits apart and of one polarity, locks; a frame ends with its end symbol.

    What follows the phasing must be valid, or the search goes on; so it does after ``LONGEST`` symbols without an end.
    """
    x = np.frombuffer(bits.encode(), np.uint8).astype(np.int64) - 48
    n = len(x) - 9
    if n <= 0:
        return []
    data = sum(x[i : i + n] << i for i in range(7))  # of the word that begins at each bit, lowest bit first
    check = sum(x[7 + i : 7 + i + n] << (2 - i) for i in range(3))
    ones = np.bitwise_count(data.astype(np.uint64)).astype(np.int64)
    valid = {False: check == 7 - ones, True: 7 - check == ones}  # inverted words have ones for zeros
    data = {False: data, True: 127 - data}
    phasing = sorted((int(at), inverted) for inverted in (False, True) for at in np.flatnonzero(valid[inverted] & (data[inverted] == PHASING)))
    found, seen, after = [], None, -1
    for at, inverted in phasing:
        if at <= after:
            continue
        if seen != (at - STRIDE, inverted):
            seen = (at, inverted)
            continue
        seen, frame, clean, start = None, [], True, at
        after = n  # unless the frame ends before
        for at in range(start + STRIDE, n, STRIDE):
            symbol, good = int(data[inverted][at]), bool(valid[inverted][at])
            if not frame and symbol == PHASING:
                continue
            if frame or good:
                frame.append(symbol)
                clean &= good
            if symbol in ENDS and frame:
                found.append((frame, clean))
            if not frame or symbol in ENDS or len(frame) >= LONGEST:
                after = at
                break
    return found


def frames(streams: DataFrame) -> DataFrame:
    """stream, frame (from 0), symbols, valid: one row per frame found."""

    def run(batches):
        for batch in batches:
            rows = [(s, n, *f) for s, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, f in enumerate(read_frames(bits))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_()), strict=True)], ["stream", "frame", "symbols", "valid"])

    return streams.select("stream", "bits").mapInArrow(run, "stream long, frame int, symbols array<int>, valid boolean")
