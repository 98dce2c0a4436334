"""Calls of scanning receivers in Spark's state: what is recovered late, what is buffered before a call, and what closes by itself.

A receiver is a key. Its state is a row of numbers and a list with a bound, kept by Spark between micro-batches; a micro-batch's rows of one
receiver are put in order before they are taken, and how many these can be is the stream's trigger to say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

LOCK_MS, QUIET_MS, ROLL_MS = 200, 5_000, 7_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "receiver long, event_id long, outcome string, cutoff_ms long, pieces long, first_piece long, held_ms long"


@dataclass
class Call:
    """cutoff_ms: what ends before comes too late. stored: a segment of this call is complete, so nothing goes in front of it any more."""

    cutoff_ms: int = 0
    stored: bool = False
    locked: bool = False
    open_ms: int = 0
    quiet_ms: int = 0
    held_ms: int = 0

    def hold(self, ms: int, segment_ms: int) -> None:
        self.held_ms += ms
        if self.held_ms >= segment_ms:
            self.stored, self.held_ms = True, 0


def taken(call: Call, roll: list[tuple[int, int]], row: Row, segment_ms: int) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """What becomes of a row: its outcome, the pieces that wait after it, and those that it sends on. Changes ``call``.

    ``target`` moves the cut-off forward only, ``reset`` sets it and forgets the call. Recovered sound that ends before the cut-off (by more than a
    millisecond) is late; during a call it goes in front until a segment is stored. Before a call all sound waits, the newest ``ROLL_MS`` of it at
    most, and is sent on when the signal has been open for ``LOCK_MS``. Quiet of ``QUIET_MS`` ends the call and moves the cut-off to its end.
    """
    end = row.start_ms + row.dur_ms
    if row.kind in ("target", "reset"):
        if row.kind == "reset":
            call.__init__(cutoff_ms=row.start_ms)
            return row.kind, [], []
        call.cutoff_ms = max(call.cutoff_ms, row.start_ms)
        return row.kind, roll, []
    if row.kind == "recovered":
        if end + 1 < call.cutoff_ms:
            return "late", roll, []
        if call.locked:
            if call.stored:
                return "refused", roll, []
            call.hold(row.dur_ms, segment_ms)
            return "prepended", roll, []
    if not call.locked:
        roll = [*roll, (row.event_id, row.dur_ms)]
        while len(roll) > 1 and sum(ms for _, ms in roll) > ROLL_MS:
            roll = roll[1:]
        if row.kind == "live":
            call.open_ms = call.open_ms + row.dur_ms if row.open else 0
        if row.kind != "live" or call.open_ms < LOCK_MS:
            return "buffered", roll, []
        call.locked, call.stored, call.quiet_ms, call.held_ms = True, False, 0, 0
        call.hold(sum(ms for _, ms in roll), segment_ms)
        return "locked", [], roll
    call.hold(row.dur_ms, segment_ms)
    call.quiet_ms = 0 if row.open else call.quiet_ms + row.dur_ms
    if call.quiet_ms >= QUIET_MS:
        call.__init__(cutoff_ms=end, stored=call.stored)
        return "ended", roll, []
    return "stored", roll, []


class _Calls(StatefulProcessor):
    def __init__(self, segment_ms: int):
        self.segment_ms = segment_ms

    def init(self, handle) -> None:
        self.call = handle.getValueState("call", "cutoff_ms long, stored boolean, locked boolean, open_ms long, quiet_ms long, held_ms long")
        self.roll = handle.getListState("roll", "event_id long, dur_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        call = Call(*self.call.get()) if self.call.exists() else Call()
        roll = [tuple(piece) for piece in self.roll.get()] if self.roll.exists() else []
        for row in sorted(rows, key=lambda r: (r.arrived_ms, r.event_id)):
            outcome, roll, sent = taken(call, roll, row, self.segment_ms)
            yield Row(receiver=key[0], event_id=row.event_id, outcome=outcome, cutoff_ms=call.cutoff_ms, pieces=len(sent), first_piece=sent[0][0] if sent else None, held_ms=call.held_ms)
        self.call.update(astuple(call))
        if roll:
            self.roll.put(roll)
        else:
            self.roll.clear()


def call_outcomes(stream: DataFrame, segment_ms: int) -> DataFrame:
    """``stream``: receiver, event_id, arrived_ms, start_ms, dur_ms, open, kind (live, recovered, target or reset). A row for each: OUTCOMES."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy("receiver").transformWithState(_Calls(segment_ms), OUTCOMES, "Append", "None")


CLOSED = "receiver long, started_ms long, ended_ms long, n long, dur_ms long"


class _Idle(StatefulProcessor):
    """A batch that is open: its first and last row's times, how many rows, and how long they are."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started_ms long, ended_ms long, n long, dur_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self.open.get()) if self.open.exists() else None
        for row in sorted(rows, key=lambda r: (r.start_ms, r.event_id)):
            if now and row.start_ms - now[1] >= self.idle_ms:
                yield self._row(key, now)
                now = None
            now = (min(now[0], row.start_ms), max(now[1], row.start_ms), now[2] + 1, now[3] + row.dur_ms) if now else (row.start_ms, row.start_ms, 1, row.dur_ms)
        self.open.update(now)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now[1] + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            yield self._row(key, tuple(self.open.get()))
            self.open.clear()

    def _row(self, key, now) -> Row:
        return Row(receiver=key[0], started_ms=now[0], ended_ms=now[1], n=now[2], dur_ms=now[3])


def closed_when_idle(stream: DataFrame, idle_ms: int, at: str = "at") -> DataFrame:
    """``stream``: receiver, event_id, start_ms, dur_ms and ``at``, their time as a timestamp with a watermark. Batches (CLOSED) that took no input for
    ``idle_ms``: closed by the next row of the receiver, or, without any, by a timer when the watermark passes."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy("receiver").transformWithState(_Idle(idle_ms), CLOSED, "Append", "EventTime")


BATCHES = "receiver long, first_id long, last_id long, clips long, overlap long, held_ms long, closed string"


@dataclass
class Pending:
    """Clips that wait to be transcribed together. The first ``overlap`` of them were in the batch before; ``held_ms`` counts these at most as long as the overlap."""

    held_ms: int = 0
    overlap: int = 0
    last_end: int = 0
    setting: str = ""


def gathered(pending: Pending, clips: list[tuple[int, int]], row: Row, full_ms: int, overlap_ms: int, gap_ms: int) -> tuple[list[tuple[int, int]], list[tuple]]:
    """The clips (id, length) that wait after ``row``, and the batches that it closes. Changes ``pending``.

    A clip with too little signal closes what waits and isn't taken. Another setting (channel, model, threads or squelch), or a start that is more than ``gap_ms``
    off the last end, closes it too. A batch that is full closes with the clip that fills it, and then only its newest clips stay, as many
    as cover the overlap; they are heard again with the next batch and never close as one of their own.
    """
    closed = []

    def close(why: str) -> None:
        if len(clips) > pending.overlap:
            new = clips[pending.overlap :]
            closed.append((new[0][0], new[-1][0], len(new), pending.overlap, pending.held_ms, why))

    apart = clips and (pending.setting != row.setting or abs(row.start_ms - pending.last_end) > gap_ms)
    if not row.active or apart:
        close("break" if row.active else "quiet")
        clips, pending.held_ms, pending.overlap = [], 0, 0
    if not row.active:
        return clips, closed
    clips = [*clips, (row.event_id, row.dur_ms)]
    pending.held_ms, pending.last_end, pending.setting = pending.held_ms + row.dur_ms, row.start_ms + row.dur_ms, row.setting
    if pending.held_ms >= full_ms:
        close("full")
        kept, reach = 0, 0
        while kept < len(clips) and reach < overlap_ms:
            kept += 1
            reach += clips[-kept][1]
        clips = clips[len(clips) - kept :]
        pending.held_ms, pending.overlap = min(reach, overlap_ms), kept
    return clips, closed


class _Batches(StatefulProcessor):
    def __init__(self, *bounds: int):
        self.bounds = bounds

    def init(self, handle) -> None:
        self.pending = handle.getValueState("pending", "held_ms long, overlap long, last_end long, setting string")
        self.clips = handle.getListState("clips", "event_id long, dur_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pending = Pending(*self.pending.get()) if self.pending.exists() else Pending()
        clips = [tuple(c) for c in self.clips.get()] if self.clips.exists() else []
        for row in sorted(rows, key=lambda r: (r.start_ms, r.event_id)):
            clips, closed = gathered(pending, clips, row, *self.bounds)
            for first, last, n, overlap, held, why in closed:
                yield Row(receiver=key[0], first_id=first, last_id=last, clips=n, overlap=overlap, held_ms=held, closed=why)
        self.pending.update(astuple(pending))
        if clips:
            self.clips.put(clips)
        else:
            self.clips.clear()


def batched_clips(stream: DataFrame, full_ms: int, overlap_ms: int, gap_ms: int) -> DataFrame:
    """``stream``: receiver, event_id, start_ms, dur_ms, active, setting. Closed batches (BATCHES); what waits is bounded by ``full_ms`` and stays in the state."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy("receiver").transformWithState(_Batches(full_ms, overlap_ms, gap_ms), BATCHES, "Append", "None")


def append_to(rows: DataFrame, folder: str, schema: str) -> DataFrame:
    """Runs ``rows`` over what is there now into ``folder`` and returns all that is there. Called again with the same folder, it goes on."""
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(schema).parquet(f"{folder}/out")
