"""Packs token pieces into as few fixed-length sequences as it can.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at most ``capacity``
counts, whatever the corpus. On it, the reduction procedure by dominance fixes small sets for good: a
set for an item dominates another if the other's items can be shared out among its own without
outgrowing any. What can't be decided so is packed best-fit, longest first. The outcome is a bounded list
of rules "pieces number i to j of length n stand in sequences s to s + j - i at offset o", and each piece
looks up its own by its number among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.bpe import codec
from tidewake.llm.shared import column, materialize

CAPACITY = 2048
END = 0
#: Text that the tokenizer's file lists as a special token, and its id.
SPECIAL = ("<|endoftext|>", 50256)


class Plan:
    """rules: (length, first, stop, sequence, offset), for pieces numbered first to stop - 1 of their length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c}
        self.used, self.rules, self.sequences, self.fixed = dict.fromkeys(self.left, 0), [], 0, 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _take(self, length: int, times: int, sequence: int, offset: int) -> None:
        self.rules.append((length, self.used[length], self.used[length] + times, sequence, offset))
        self.used[length] += times
        self.left[length] -= times
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int]) -> None:
        times = min(self.left[n] // lengths.count(n) for n in set(lengths))
        offset = 0
        for n in lengths:
            self._take(n, times, self.sequences, offset)
            offset += n
        self.sequences += times

    def _reduce(self) -> None:
        """For each length from the longest: fix what dominates all other sets with such a piece, as often as there are pieces."""
        for j in sorted(self.left, reverse=True):
            while j in self.left:
                chosen = self._dominant(j)
                if chosen is None or any(self.left[n] < chosen.count(n) for n in set(chosen)):
                    break
                self._fix(chosen)

    def _dominant(self, j: int) -> list[int] | None:
        room = self.capacity - j
        free = sorted(n for n in self.left if n != j or self.left[j] > 1)
        spare = lambda n: self.left[n] - (n == j)
        at = bisect_right(free, room)
        if not at:
            return [j]  # nothing else fits
        k = free[at - 1]
        if k == room:
            return [j, k]  # k takes as much as any others could
        low = [n for n in free[:3] for _ in range(min(3, spare(n)))][:3]
        if len(low) < 2 or low[0] + low[1] > room:
            return [j, k]  # only single pieces fit: the longest one dominates
        if len(low) > 2 and sum(low) <= room:
            return None
        best, lo, hi = 0, 0, at - 1  # two at most fit: the largest sum of two
        while lo <= hi:
            if free[lo] + free[hi] > room or (lo == hi and spare(free[lo]) < 2):
                hi -= 1
            else:
                best = max(best, free[lo] + free[hi])
                lo += 1
        if best <= k:
            return [j, k]
        s = free[bisect_right(free, room - k) - 1] if free[0] <= room - k else 0
        if s and (s != k or spare(k) > 1):
            beyond = [n for n in free[bisect_right(free, s) :][:2] for _ in range(min(2, spare(n)))][:2]
            if len(beyond) < 2 or sum(beyond) > room:
                return [j, k, s]  # of any other two, one is at most k and the other at most s
        return None

    def _best_fit(self) -> None:
        open_at: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
        rooms: list[int] = []

        def put(room, first, times):
            if room and times:
                if room not in open_at:
                    open_at[room] = []
                    insort(rooms, room)
                open_at[room].append((first, times))

        for n in sorted(self.left, reverse=True):
            while n in self.left:
                at = bisect_left(rooms, n)
                if at < len(rooms):
                    room = rooms[at]
                    first, have = open_at[room].pop()
                    if not open_at[room]:
                        del open_at[room], rooms[at]
                    times = min(have, self.left[n])
                    self._take(n, times, first, self.capacity - room)
                    put(room, first + times, have - times)
                    put(room - n, first, times)
                    continue
                each = self.capacity // n
                for held, times in ((each, self.left[n] // each), (self.left[n] % each, 1)):
                    if held and times:
                        for layer in range(held):
                            self._take(n, times, self.sequences, layer * n)
                        put(self.capacity - held * n, self.sequences, times)
                        self.sequences += times


def _token_ids(c, text: str) -> list[int]:
    """As the tokenizers library gives them for the vocabulary's file: its special text is one id of its own."""
    if SPECIAL[0] not in text:
        return c.encode(text)
    ids: list[int] = []
    for k, part in enumerate(text.split(SPECIAL[0])):
        ids += [SPECIAL[1]] * (k > 0) + c.encode(part)
    return ids


def cut_pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with the task and the number of the piece among those of its length in the task."""

    def run(batches):
        c, task, numbers = codec(vocabulary, pattern, 16_384, 512), TaskContext.get().partitionId(), {}
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc_id, text in zip(*batch.columns, strict=True):
                ids = np.array([*_token_ids(c, text.as_py() or ""), END], "<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    number = numbers[b - a] = numbers.get(b - a, -1) + 1
                    row = (doc_id.as_py(), piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, number, ids[a:b].tolist() if keep_ids else None)
                    for values, value in zip(out, row, strict=True):
                        values.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    picked = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    pieces = picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long, ids array<int>")
    return pieces if keep_ids else pieces.drop("ids")


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, keep_ids: bool = False, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids, if asked for), sequence_id, offset: one row per piece.

    A null text is empty and so one token long. Repeated rows are packed as often as they stand; null ids stay
    null. An empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs, vocabulary, pattern, capacity, keep_ids, **columns), "pieces")
    tallies = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "tallies")
    plan = Plan({r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # capacity rows at most
    before = tallies.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = pieces.join(before, ["length", "task"]).withColumn("number", F.col("number") + F.col("before")).drop("before", "task")
    rules = np.array(sorted(plan.rules), np.int64).reshape(-1, 5)
    by_length = {n: rules[rules[:, 0] == n] for n in np.unique(rules[:, 0]).tolist()}
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches):
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                r = by_length[n]
                at = np.searchsorted(r[:, 1], number[mine], "right") - 1
                sequence[mine], offset[mine] = r[at, 3] + number[mine] - r[at, 1], r[at, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ids = "ids array<int>, " if keep_ids else ""
    return numbered.select(*names, "number").mapInArrow(place, f"doc_id long, piece int, start long, length long, ids_crc32 long, {ids}sequence_id long, offset long")
