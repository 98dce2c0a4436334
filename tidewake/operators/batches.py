"""Batches that close once they are full, where each begins depends on where the one before ended.

A key's rows are cut into pieces of a fixed number of rows. What a piece does to the batch that it receives is a short table: an open
batch can end at few places, and from each place on all cuts are known. Only these tables meet, in order, as a stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.folds import fold_sorted
from tidewake.operators.ordered import _attach
from tidewake.sources.folders import shared_folder

PIECE = 1 << 18


def _next_starts(size: np.ndarray, broken: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray]:
    """What lies before each row, and where the next batch begins if one begins at the row (the number of rows, if beyond them)."""
    n, upto = len(size), np.cumsum(size)
    before, gaps = upto - size, np.append(np.flatnonzero(broken), len(size))
    by_gap = gaps[np.searchsorted(gaps[:-1], np.arange(n), side="right")]
    by_size = np.searchsorted(upto, before + full) + 1
    return before, np.minimum(np.minimum(by_gap, by_size), n)


def _first_start(before: np.ndarray, broken: np.ndarray, full: int, held: int) -> int:
    """Where a batch that holds ``held`` when the rows begin ends."""
    gap = int(np.argmax(broken)) if broken.any() else len(before)
    return min(gap, int(np.searchsorted(before, full - held)))


def with_batches(rows: DataFrame, keys: list[str], nth: str, size: str, broken: str, full: int, piece: int = PIECE) -> DataFrame:
    """Adds ``batch`` (from 1 within each key): a row begins one if it is ``broken`` or if the batch before it holds ``full`` or more.

    ``nth`` numbers a key's rows from 1 and ``size`` is a whole number of 0 or more (null: 0); ``full`` is above 0. Null keys are keys; an empty table stays empty.
    No task holds more than ``piece`` rows of a key. A key's pieces, one row each, stream through one task.
    """
    folder, names = shared_folder(rows.sparkSession, "batches"), rows.columns
    rows.withColumn("__piece", F.floor((F.col(nth) - 1) / piece)).write.parquet(f"{folder}/rows")
    cut = rows.sparkSession.read.parquet(f"{folder}/rows")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    kind_of = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "__piece"])

    def read(t: pa.Table):
        t = t.sort_by(nth)
        return t, t.column(size).fill_null(0).to_numpy().astype(np.int64), t.column(broken).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)

    def outline(t: pa.Table) -> pa.Table:
        t, sizes, breaks = read(t)
        before, follow = _next_starts(sizes, breaks, full)
        n, total = len(sizes), int(sizes.sum())
        left, new = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            to = int(follow[i])
            left[i], new[i] = (total - int(before[i]), 1) if to == n else (left[to], new[to] + 1)
        ends = min(_first_start(before, breaks, full, 0) + 1, n)
        parts = [t.column(k).slice(0, 1) for k in [*keys, "__piece"]]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (before[:ends].tolist(), left[:ends], new[:ends])]
        ended = pa.array([ends < n or bool(breaks[-1]) or int(before[-1]) >= full])
        return pa.table([*parts, *lists, ended, pa.array([total])], [*keys, "__piece", "before", "left", "new", "ended", "total"])

    def step(state, row):
        held, batch = state or (full, 0)
        at = int(np.searchsorted(row["before"], full - held))
        if at == len(row["before"]):
            if not row["ended"]:
                return (held + row["total"], batch), (held, batch)
            at -= 1  # at a break
        return (row["left"][at], batch + row["new"][at]), (held, batch)

    def number(t: pa.Table) -> pa.Table:
        t, sizes, breaks = read(t)
        before, follow = _next_starts(sizes, breaks, full)
        begins, at = np.zeros(len(sizes), np.int64), _first_start(before, breaks, full, t.column("__held")[0].as_py())
        while at < len(sizes):
            begins[at], at = 1, int(follow[at])
        batch = t.column("__batch")[0].as_py() + np.cumsum(begins)
        return t.select(names).append_column("batch", pa.array(batch))

    tables = cut.groupBy(*keys, "__piece").applyInArrow(outline, f"{kind_of}, before array<long>, left array<long>, new array<long>, ended boolean, total long")
    plain = ", ".join(f"{k} {kinds[k].replace('bigint', 'long')}" for k in [*keys, "__piece"])
    entered = fold_sorted(tables, keys, ["__piece"], [*keys, "__piece"], step, f"{plain}, __held long, __batch long")
    found = _attach(cut, entered, [*keys, "__piece"])
    every = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return found.groupBy(*keys, "__piece").applyInArrow(number, f"{every}, batch long")
