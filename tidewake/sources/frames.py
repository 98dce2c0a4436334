"""Byte streams: tagged frames cut out of ordered chunks, spans within them, and WAV headers."""

from __future__ import annotations

import json
import math
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 16 << 20
FLUSH = 1 << 24  #: bytes read after which what was found is handed on
# A WAV header's tags, in hexadecimal.
RIFF, WAVE, FMT, DATA = "52494646", "57415645", "666D7420", "64617461"
# The kinds of a receiver's frames. "late" ones tell when and where they were received, "spanned" ones each part's noise too.
VOICE_A, CALLS, STATE, VOICE_B, LATE_A, LATE_B, SPANNED_A, SPANNED_B = range(1, 9)
SAFE = (1 << 53) - 1  #: times and frequencies that JSON's numbers hold exactly
SPAN = "struct<bytes: long, noise: double>"
TYPED = f"captured_ms long, frequency long, noise double, spans array<{SPAN}>, pcm binary, state string, error string"
STATE_FIELDS = "voice_level double, slot_b_level double, dsc_level double, voice_carrier_offset_hz double, slot_b_carrier_offset_hz double, iq_edge_fraction double, spectrum_activity map<string, double>"


def little_endian(value: Column, size: int) -> Column:
    """An unsigned number as ``size`` bytes, lowest first."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * (size - k) - 1, 2) for k in range(size)]))


def number(data: Column, at: int, size: int) -> Column:
    """The unsigned little-endian number of ``size`` bytes that starts at byte ``at`` (from 0)."""
    return sum(F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("long") * (1 << (8 * k)) for k in range(size))


def frame(kind: Column, payload: Column) -> Column:
    return F.concat(little_endian(kind, 1), little_endian(F.octet_length(payload), 4), payload)


def cut_frames(data: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """Whole frames, and what is left of one that isn't. A frame beyond the largest size is an error."""
    out, at = [], 0
    while at + 5 <= len(data):
        kind, size = struct.unpack_from("<BI", data, at)
        if size > LARGEST:
            raise ValueError(f"a frame of {size} bytes")
        if at + 5 + size > len(data):
            break
        out.append((kind, data[at + 5 : at + 5 + size]))
        at += 5 + size
    return out, data[at:]


def _in_order(rows: DataFrame, order: list[str], data: str, step, end, schema: str) -> DataFrame:
    """A stream's rows in order: ``step(stream, bytes, state)`` gives rows and the next state (None at first), ``end(stream, state)`` the last rows. The state alone is held, and streams of any number and length share tasks."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    def run(batches):
        begun, of, state = False, None, None
        for batch in batches:
            found, size = [], 0
            for stream, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and stream != of:
                    found += end(of, state)
                    state = None
                begun, of = True, stream
                new, state = step(stream, value or b"", state)
                found += new
                size += len(value or b"")
                if size > FLUSH:
                    if found:
                        yield table(found)
                    found, size = [], 0
            if found:
                yield table(found)
        if begun and (last := list(end(of, state))):
            yield table(last)

    return rows.repartition("stream").sortWithinPartitions("stream", *order).select("stream", data).mapInArrow(run, schema)


def chunked(rows: DataFrame, order: list[str], data: str, size: int) -> DataFrame:
    """``rows``: stream, order and bytes. A stream's bytes, one after the other, in chunks of ``size``: stream, seq, data."""

    def step(stream, value, state):
        seq, rest = state or (0, b"")
        whole = rest + value
        n = len(whole) // size
        return [(stream, seq + k, whole[k * size : (k + 1) * size]) for k in range(n)], (seq + n, whole[n * size :])

    def end(stream, state):
        return [(stream, *state)] if state[1] else []

    return _in_order(rows, order, data, step, end, "stream long, seq long, data binary")


def deframe(chunks: DataFrame) -> DataFrame:
    """``chunks``: stream, seq, data. Returns stream, frame_no, kind, payload; a frame may run over several chunks."""

    def step(stream, value, state):
        number, parts, held, wanted = state or (0, [], 0, 5)  # bytes that no frame has taken, and how many the next one needs at least
        parts.append(value)
        held += len(value)
        if held < wanted:
            return [], (number, parts, held, wanted)
        found, rest = cut_frames(b"".join(parts))
        wanted = 5 + (struct.unpack_from("<I", rest, 1)[0] if len(rest) >= 5 else 0)
        return [(stream, number + k, *f) for k, f in enumerate(found)], (number + len(found), [rest], len(rest), wanted)

    return _in_order(chunks, ["seq"], "data", step, lambda stream, state: [], "stream long, frame_no long, kind int, payload binary")


def pack_payload(kind: int, part: dict) -> bytes:
    """A frame's payload of its fields; what a kind doesn't have isn't looked at."""
    pcm = part["pcm"] or b""
    if kind in (VOICE_A, VOICE_B):
        return struct.pack("<d", part["noise"]) + pcm
    if kind == STATE:
        return (part["state"] or "").encode()
    if kind in (LATE_A, LATE_B):
        return struct.pack("<qqd", part["captured_ms"], part["frequency"], part["noise"]) + pcm
    if kind in (SPANNED_A, SPANNED_B):
        head = struct.pack("<qqI", part["captured_ms"], part["frequency"], len(part["spans"]))
        return head + b"".join(struct.pack("<Id", s["bytes"], s["noise"]) for s in part["spans"]) + pcm
    return pcm


def read_payload(kind: int, data: bytes) -> dict:
    """The fields of a frame's payload; a payload that breaks its kind's rules, or a kind that isn't known, is an error."""

    def at_least(n: int) -> None:
        if len(data) < n:
            raise ValueError("truncated")

    if kind in (VOICE_A, VOICE_B):
        at_least(8)
        return {"noise": struct.unpack_from("<d", data)[0], "pcm": data[8:]}
    if kind == CALLS:
        return {"pcm": data}
    if kind == STATE:
        try:
            state = json.loads(data.decode("utf-8", "replace"), parse_constant=int)  # int refuses NaN and Infinity, which aren't JSON
        except (ValueError, RecursionError):
            state = None
        if state is None:
            raise ValueError("state")
        return {"state": json.dumps(state) if isinstance(state, dict) else "{}"}
    if kind in (LATE_A, LATE_B):
        at_least(24)
        captured, frequency, noise = struct.unpack_from("<qqd", data)
        return {"captured_ms": captured, "frequency": frequency, "noise": noise, "pcm": data[24:]}
    if kind in (SPANNED_A, SPANNED_B):
        at_least(20)
        captured, frequency, n = struct.unpack_from("<qqI", data)
        if abs(captured) > SAFE or abs(frequency) > SAFE or n > (len(data) - 20) // 12:
            raise ValueError("header")
        pcm = data[20 + 12 * n :]
        spans = [{"bytes": size, "noise": noise} for size, noise in struct.iter_unpack("<Id", data[20 : 20 + 12 * n])]
        if any(s["bytes"] == 0 or s["bytes"] % 2 or not math.isfinite(s["noise"]) for s in spans):
            raise ValueError("span")
        total = sum(s["bytes"] for s in spans)
        if not spans or total != len(pcm):
            raise ValueError("cover")
        return {"captured_ms": captured, "frequency": frequency, "noise": sum(s["bytes"] * s["noise"] for s in spans) / total, "spans": spans, "pcm": pcm}
    raise ValueError("kind")


def packed(rows: DataFrame) -> DataFrame:
    """``rows``: kind and the fields of TYPED (but for the error), with any other columns. Adds payload; what belongs to the fields goes."""
    fields = ["captured_ms", "frequency", "noise", "spans", "pcm", "state"]
    kept = [c for c in rows.columns if c not in fields]
    schema = rows.select(*kept).schema

    def run(batches):
        for batch in batches:
            parts = batch.select(fields).to_pylist()
            payload = [pack_payload(kind, part) for kind, part in zip(batch.column("kind").to_pylist(), parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(payload, pa.binary())], [*kept, "payload"])

    return rows.mapInArrow(run, schema.add("payload", "binary"))


def typed(frames: DataFrame) -> DataFrame:
    """``frames``: stream, frame_no, kind, payload. Adds the fields of each kind in place of the payload, or what is wrong with it.

    A null payload counts as empty, a null kind as one that isn't known. Each frame is read by itself, whatever its stream.
    """
    names = [f.split()[0] for f in TYPED.replace(f"array<{SPAN}>", "array").split(", ")]
    span = pa.struct([("bytes", pa.int64()), ("noise", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(span), pa.binary(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                try:
                    rows.append(read_payload(kind, data or b""))
                except ValueError as wrong:
                    rows.append({"error": str(wrong)})
            found = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("stream", "frame_no", "kind")), *found], ["stream", "frame_no", "kind", *names])

    return frames.select("stream", "frame_no", "kind", "payload").mapInArrow(run, f"stream long, frame_no long, kind int, {TYPED}")


def until_error(frames: DataFrame) -> DataFrame:
    """Typed frames of each stream before its first wrong one, at which a receiver is started anew."""
    stop = frames.where("error is not null").groupBy("stream").agg(F.min("frame_no").alias("__stop"))
    return frames.join(stop, "stream", "left").where("__stop is null or frame_no < __stop").drop("__stop")


def span_rows(frames: DataFrame) -> DataFrame:
    """stream, frame_no, span_no, byte_start, bytes, noise: the parts of typed frames' sound. Frames without spans are one of their noise."""
    one = F.array(F.struct(F.octet_length("pcm").cast("long").alias("bytes"), "noise"))
    every = F.coalesce("spans", F.when(F.col("noise").isNotNull() & (F.octet_length("pcm") > 0), one))
    before = F.aggregate(F.slice("s", F.lit(1), F.col("span_no")), F.lit(0).cast("long"), lambda n, x: n + x["bytes"])
    rows = frames.where("error is null").withColumn("s", every).select("stream", "frame_no", "s", F.posexplode("s").alias("span_no", "part"))
    return rows.select("stream", "frame_no", "span_no", before.alias("byte_start"), "part.bytes", "part.noise")


def routed(frames: DataFrame, slot_a: Column, slot_b: Column, threshold: Column) -> DataFrame:
    """Typed frames with ``target``: slot A's or B's sound, calls, state, or null where a frame came late for a frequency that its slot has left. ``heard``: whether live sound passes the gate.

    ``slot_b`` is null while that slot listens to the digital channel: then no late frame is its.
    """
    kind, frequency = F.col("kind"), F.col("frequency")
    late_a, late_b = kind.isin(LATE_A, SPANNED_A), kind.isin(LATE_B, SPANNED_B)
    target = F.when((kind == VOICE_A) | (late_a & (frequency == slot_a)), "A").when((kind == VOICE_B) | (late_b & (frequency == slot_b)), "B").when(kind == CALLS, "calls").when(kind == STATE, "state")
    return frames.withColumn("target", target).withColumn("heard", F.when(kind == VOICE_A, F.coalesce(F.col("noise") < threshold, F.lit(False))))


def states(frames: DataFrame) -> DataFrame:
    """stream, frame_no and a receiver's measures of typed frames that tell its state; a measure that isn't there is null."""
    return frames.where((F.col("kind") == STATE) & F.col("error").isNull()).select("stream", "frame_no", F.from_json("state", STATE_FIELDS).alias("s")).select("stream", "frame_no", "s.*")


def wav(pcm: Column, rate: int) -> Column:
    """A mono 16-bit file: 44 bytes of header, then the samples."""
    size = F.octet_length(pcm)
    tag = lambda h: F.unhex(F.lit(h))
    n = lambda v, k: little_endian(F.lit(v), k)
    return F.concat(tag(RIFF), little_endian(size + 36, 4), tag(WAVE), tag(FMT), n(16, 4), n(1, 2), n(1, 2), n(rate, 4), n(2 * rate, 4), n(2, 2), n(16, 2), tag(DATA), little_endian(size, 4), pcm)


def canonical_wav(data: Column, rate: int) -> Column:
    """Whether a file is a mono 16-bit one of this rate, with sizes that agree."""
    at = lambda k: F.hex(F.substring(data, k + 1, 4))
    return (
        (F.octet_length(data) > 44) & (at(0) == RIFF) & (at(8) == WAVE) & (at(12) == FMT) & (at(36) == DATA) & (number(data, 16, 4) == 16) & (number(data, 20, 2) == 1) & (number(data, 22, 2) == 1)
        & (number(data, 24, 4) == rate) & (number(data, 28, 4) == 2 * rate) & (number(data, 32, 2) == 2) & (number(data, 34, 2) == 16) & (number(data, 4, 4) == F.octet_length(data) - 8) & (number(data, 40, 4) == F.octet_length(data) - 44) & (number(data, 40, 4) % 2 == 0)
    )


WAV_PARTS = "encoding int, channels int, rate int, bits int, header_rate long, first_at long, first_bytes long, last_bytes long, whole boolean, reached boolean"


def walk_wav(data: bytes | None) -> dict:
    """A file's chunks, one after the other, odd ones padded. ``whole``: none runs past the end; ``reached``: none did before the first data."""
    found = dict.fromkeys((f.split()[0] for f in WAV_PARTS.split(", ")), None) | {"whole": False, "reached": False}
    if data is None or data[:4] != bytes.fromhex(RIFF) or data[8:12] != bytes.fromhex(WAVE):
        return found
    found["header_rate"] = struct.unpack_from("<I", data, 24)[0] if len(data) >= 28 else None
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        at += 8
        if at + size > len(data):
            return found
        if kind == bytes.fromhex(FMT) and size >= 16:
            found["encoding"], found["channels"], found["rate"], found["bits"] = struct.unpack_from("<HHI6xH", data, at)
        elif kind == bytes.fromhex(DATA):
            if not found["reached"]:
                found |= {"first_at": at, "first_bytes": size, "reached": True}
            found["last_bytes"] = size
        at += size + size % 2
    return found | {"whole": True}


def wav_parts(files: DataFrame, key: str) -> DataFrame:
    """``files``: key (long), data. Returns key and its parts; null parts are those that aren't there."""
    names = [f.split()[0] for f in WAV_PARTS.split(", ")]

    def run(batches):
        for batch in batches:
            walked = [walk_wav(v.as_py()) for v in batch.column(1)]
            kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
            columns = [pa.array([w[n] for w in walked], kinds[f.split()[1]]) for n, f in zip(names, WAV_PARTS.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *names])

    return files.select(key, "data").mapInArrow(run, f"{key} long, {WAV_PARTS}")


def strict_wav(rate: int) -> Column:
    """Of parts: all chunks whole, 16-bit mono samples of this rate. The last data counts."""
    c = F.col
    return F.coalesce(c("whole") & (c("last_bytes") >= 0) & (c("encoding") == 1) & (c("channels") == 1) & (c("rate") == rate) & (c("bits") == 16), F.lit(False))


def playable_wav() -> Column:
    """Of parts: the first data is whole and even, and the rate where plain headers have it isn't zero. The format isn't looked at."""
    return F.coalesce(F.col("reached") & (F.col("first_bytes") % 2 == 0) & (F.col("header_rate") > 0), F.lit(False))


def mono_wav() -> Column:
    """Of parts: first data, 16-bit mono, any rate."""
    return F.coalesce(F.col("reached") & (F.col("encoding") == 1) & (F.col("channels") == 1) & (F.col("bits") == 16), F.lit(False))
