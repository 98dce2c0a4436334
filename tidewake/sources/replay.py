"""Retained segments as a stream that is read through cursors.

The table has a row a segment: slot, id (ascending within a slot), channel, started_ms, total (bytes) and spans (array of bytes, noise, in
order). An offset is a cursor for each slot: a segment, when it started and how many of its bytes are consumed. Segments may grow, be added or be
retired between two reads; a query that starts again goes on from its cursors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

READ = "slot string, id long, channel string, begins long, n long, spans array<struct<bytes: long, noise: double>>, after string"
#: Segments that one task reads at most.
TOGETHER = 64
_INDEX = ["slot", "id", "channel", "started_ms", "total"]


@dataclass
class Stretch(InputPartition):
    """Segments of one slot that follow each other, from a place in the first on; ``then`` is the segment behind the last, if any."""

    slot: str
    segments: list[dict]
    consumed: int
    then: dict | None
    retired: dict | None = None


def reads(segment: dict, spans: list[dict], consumed: int, most: int, then: dict | None) -> Iterator[tuple]:
    """The reads of a segment from ``consumed`` on, ``most`` bytes each. The one that empties it says what follows: edge, advance or channel-change.

    A read has its quality spans only if they cover it whole. The spans are gone through once, however many reads they make.
    """
    most = max(2, most // 2 * 2)
    at = k = 0  # where span k begins
    for begin in range(consumed, segment["total"], most):
        end, part = min(segment["total"], begin + most), []
        while k < len(spans) and at < end:
            stop = at + spans[k]["bytes"]
            a, b = max(at, begin), min(stop, end)
            if a < b:
                part.append({"bytes": b - a, "noise": spans[k]["noise"]})
            if stop > end:
                break  # the next read goes on in it
            at, k = stop, k + 1
        after = None if end < segment["total"] else "edge" if then is None else "advance" if then["channel"] == segment["channel"] else "channel-change"
        yield segment["slot"], segment["id"], segment["channel"], begin, end - begin, part if sum(s["bytes"] for s in part) == end - begin else None, after


class ReplaySource(DataSource):
    """Options: ``path`` of the table (a file system that Arrow reads), ``most`` bytes a read (64,000)."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return READ

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ReplayReader(self.options["path"], int(self.options.get("most", 64_000)))


class ReplayReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def _rows(self, columns: list[str], where=None) -> Iterator[dict]:
        """A few rows at a time, as a segment has as many spans as its sound has."""
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(self.path)
        found = dataset.dataset(path, filesystem=system, format="parquet")
        for batch in found.to_batches(columns=columns, filter=where, batch_size=8, batch_readahead=1, fragment_readahead=1):
            yield from batch.to_pylist()

    def _index(self) -> dict[str, list[dict]]:
        """Each slot's segments without their sound: what is retained at a time has a bound."""
        found: dict[str, list[dict]] = {}
        for row in sorted(self._rows(_INDEX), key=lambda r: (r["slot"], r["id"])):
            found.setdefault(row["slot"], []).append(row)
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last = {slot: rows[-1] for slot, rows in self._index().items()}
        return {slot: json.dumps([r["id"], r["started_ms"], r["total"]]) for slot, r in last.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found, index = [], self._index()
        for slot, stop in sorted(end.items()):
            last, _, upto = json.loads(stop)
            rows = [r for r in index.get(slot, []) if r["id"] <= last]
            if rows and rows[-1]["id"] == last:
                rows[-1] = rows[-1] | {"total": min(rows[-1]["total"], upto)}  # it may have grown since
            consumed, retired = 0, None
            if slot in start:
                at, began, consumed = json.loads(start[slot])
                if not any(r["id"] == at and r["started_ms"] == began and r["total"] >= consumed for r in rows):
                    retired, consumed = {"id": at}, 0
                rows = [r for r in rows if r["id"] >= at + (retired is not None)]
            for k in range(0, len(rows), TOGETHER):
                then = rows[k + TOGETHER] if k + TOGETHER < len(rows) else None
                found.append(Stretch(slot, rows[k : k + TOGETHER], consumed if k == 0 else 0, then, retired if k == 0 else None))
            if retired and not rows:
                found.append(Stretch(slot, [], 0, None, retired))
        return found

    def read(self, partition: Stretch) -> Iterator[tuple]:
        from pyarrow import compute as pc

        if partition.retired:  # the cursor's segment is gone, or another one has its number: reading goes on with what is left
            yield partition.slot, partition.retired["id"], None, None, 0, None, "retired"
        if not partition.segments:
            return
        first, last = partition.segments[0]["id"], partition.segments[-1]["id"]
        where = (pc.field("slot") == partition.slot) & (pc.field("id") >= first) & (pc.field("id") <= last)
        left = {s["id"]: (s, partition.consumed if k == 0 else 0, then) for k, (s, then) in enumerate(zip(partition.segments, [*partition.segments[1:], partition.then], strict=True))}
        for r in self._rows(["id", "spans"], where):
            if r["id"] in left:
                segment, consumed, then = left.pop(r["id"])
                yield from reads(segment, r["spans"] or [], consumed, self.most, then)
        for segment, consumed, then in left.values():  # retired since they were listed
            yield from reads(segment, [], consumed, self.most, then)
