"""Recursions over ordered rows: what each row gives depends on a small state that the rows before it left.

Rows stream past in order, so what is held is the state. The daily ones start anew each day (of a channel, of a slot), so they spread over tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

FLOOR_TOP, FLOOR_LEAST = 0.012, 1 / 32768
RETRY_MS, REJECT_MS, LEAST_SCORE = 1500, 8000, 2
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
FAVOURITE, FAVOURED = "view", 1.2


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], ids: list[str], step, fields: str) -> DataFrame:
    """``step(state, row)`` gives the next state and the row's values (or None for no row), named as in ``fields`` behind ``ids``; a key's first state is None.

    A key's rows stream through one task in order and only the state is held, so memory is that of an Arrow batch however many rows a key has.
    """
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)

    def run(batches):
        key, state = (), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (of := tuple(r[k] for k in keys)) != key:
                    key, state = of, None
                state, values = step(state, r)
                if values is not None:
                    out.append((*(r[c] for c in ids), *values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)


def fold_days(rows: DataFrame, keys: list[str], order: list[str], step, fields: str) -> DataFrame:
    """``step(state, row)`` gives the next state and the row's values, named as in ``fields`` behind event_id; the first state is None."""
    return fold_sorted(rows, keys, order, ["event_id"], step, fields)


def strong_gain(floor: float | None, row: dict):
    """Follows the noise floor, quickly down and slowly up to a limit; the gain rises with the level above it."""
    level = row["level"]
    if floor is None:
        floor = min(FLOOR_TOP, max(level, FLOOR_LEAST))
    elif level < floor:
        floor = floor * 0.8 + level * 0.2
    else:
        floor = min(FLOOR_TOP, floor * 0.995 + level * 0.005)
    above = level / max(floor, FLOOR_LEAST)
    return floor, (floor, min(1.0, max(0.16, 0.16 + (above - 1.25) / 1.25 * 0.84)))


def newest_wins(busy_ms: int):
    """One worker and one waiting place: a chunk that comes while another waits takes its place, and the other is lost."""

    def step(state, row):
        free_at, waits = state or (0, False)
        now = row["start_ms"]
        if waits and free_at <= now:
            free_at, waits = free_at + busy_ms, False
        if free_at <= now:
            return (now + busy_ms, False), (0, now + busy_ms)
        return (free_at, True), (int(waits), free_at)

    return step


def lost_chunks(busy_ms: int):
    """The same worker: how many chunks (0 or 1) each arrival pushes out, and how many bytes; what waits is always the arrival before."""
    admit = newest_wins(busy_ms)

    def step(state, row):
        inner, before = state or (None, 0)
        inner, (lost, _) = admit(inner, row)
        return (inner, row["bytes"]), (lost, before if lost else 0)

    return step


def new_call(within_ms: int):
    """A call that says what the last accepted one said, sooner than ``within_ms`` after it, isn't accepted."""

    def step(state, row):
        again = state is not None and row["raw"] == state[0] and row["start_ms"] - state[1] < within_ms
        return (state if again else (row["raw"], row["start_ms"])), (int(not again),)

    return step


def retarget(state, row):
    """Each row brings its channel's score and whether its slot is locked; then slot A's scan and slot B's each go to the best channel allowed.

    Allowed is a score of ``LEAST_SCORE`` or more, not rejected by the slot, and not what the other slot is on. A target that stays unlocked for
    ``RETRY_MS`` is rejected for ``REJECT_MS``. Of equal scores the first name wins.
    """
    slots, scores = state or ({s: (None, None, {}, False) for s in ("A", "B")}, {})
    now, scores = row["start_ms"], scores | {row["channel"]: row["score"]}
    slots = slots | {row["slot"]: (*slots[row["slot"]][:3], row["locked"])}
    for slot, other in (("A", "B"), ("B", "A")):
        target, since, rejected, locked = slots[slot]
        if locked:
            continue
        if since is not None and now - since >= RETRY_MS:
            rejected, since = rejected | {target: now + REJECT_MS}, None
        raised = [(-s * (FAVOURED if c == FAVOURITE else 1), c) for c, s in scores.items() if c != slots[other][0] and rejected.get(c, 0) <= now]
        able = [x for x in raised if -x[0] >= LEAST_SCORE]
        if able and (since is None or min(able)[1] != target):
            target, since = min(able)[1], now
        slots = slots | {slot: (target, since, rejected, locked)}
    return (slots, scores), (slots[row["slot"]][0],)
