import struct

import pytest
from pyspark.sql import functions as F

from tidewake.sources import frames


def spanned(parts, pcm, n=None, at=1_000, hz=156_800_000):
    return struct.pack("<qqI", at, hz, len(parts) if n is None else n) + b"".join(struct.pack("<Id", *p) for p in parts) + pcm


def test_spans_cover_the_sound():
    found = frames.read_payload(7, spanned([(2, 0.1), (6, 0.3)], b"12345678"))
    assert found["noise"] == pytest.approx(0.25) and found["pcm"] == b"12345678"
    assert [s["bytes"] for s in found["spans"]] == [2, 6]
    wrong = {
        "truncated": [b"", b"x" * 19],
        "header": [spanned([], b"", n=1), spanned([(2, 0.1)], b"12", at=1 << 53), spanned([(2, 0.1)], b"12", n=9)],
        "span": [spanned([(0, 0.1)], b""), spanned([(3, 0.1)], b"123"), spanned([(2, float("nan"))], b"12")],
        "cover": [spanned([], b""), spanned([(2, 0.1)], b"1234"), spanned([(4, 0.1)], b"12")],
    }
    for error, payloads in wrong.items():
        for payload in payloads:
            with pytest.raises(ValueError, match=error):
                frames.read_payload(8, payload)


def test_states():
    for payload in (b"", b"{", b"null", b'{"voice_level": NaN}', b"\xff"):
        with pytest.raises(ValueError, match="state"):
            frames.read_payload(3, payload)
    assert frames.read_payload(3, b"[1]") == {"state": "{}"}


def test_frames_of_all_kinds_come_back(spark):
    parts = [(k, 1_000 + k, 156_800_000 if k % 2 else 157_100_000, 0.25 * k, [(2, 0.5), (4, 0.5)], b"abcdef", '{"voice_level": 0.5}') for k in range(1, 9)]
    rows = spark.createDataFrame(parts, f"kind int, captured_ms long, frequency long, noise double, spans array<{frames.SPAN}>, pcm binary, state string")
    sent = frames.packed(rows).withColumn("stream", F.lit(1).cast("long")).withColumn("frame_no", F.col("kind").cast("long"))
    more = spark.createDataFrame([(2, 1, 2, b"a"), (2, 2, 9, b"b"), (2, 3, 2, b"c"), (3, 1, None, None), (4, 1, 1, None), (5, 1, 2, None)], "stream long, frame_no long, kind int, payload binary")
    got = frames.typed(sent.unionByName(more)).cache()
    found = {(r.stream, r.kind if r.stream == 1 else r.frame_no): r for r in got.collect()}
    assert all(found[1, k].error is None and found[1, k].pcm == (None if k == 3 else b"abcdef") for k in range(1, 9))
    assert [found[1, k].noise for k in (1, 4, 5, 6, 7, 8)] == [0.25, 1.0, 1.25, 1.5, 0.5, 0.5]
    assert [found[1, k].captured_ms for k in (1, 5, 8)] == [None, 1005, 1008]
    assert [found[s, n].error for s, n in ((2, 1), (2, 2), (3, 1), (4, 1), (5, 1))] == [None, "kind", "kind", "truncated", None]
    assert frames.states(got).collect()[0].voice_level == 0.5
    kept = sorted((r.stream, r.frame_no) for r in frames.until_error(got).collect())
    assert kept == [*((1, k) for k in range(1, 9)), (2, 1), (5, 1)]
    route = lambda b: {r.kind: r.target for r in frames.routed(got.where("stream = 1"), F.lit(156_800_000), b, F.lit(0.3)).collect()}
    assert route(F.lit(157_100_000)) == {1: "A", 2: "calls", 3: "state", 4: "B", 5: "A", 6: "B", 7: "A", 8: "B"}
    assert route(F.lit(None)) == {1: "A", 2: "calls", 3: "state", 4: "B", 5: "A", 6: None, 7: "A", 8: None}
    spans = sorted((r.frame_no, r.span_no, r.byte_start, r.bytes) for r in frames.span_rows(got.where("stream = 1")).collect())
    assert spans == [(1, 0, 0, 6), (4, 0, 0, 6), (5, 0, 0, 6), (6, 0, 0, 6), (7, 0, 0, 2), (7, 1, 2, 4), (8, 0, 0, 2), (8, 1, 2, 4)]
    assert frames.typed(more.limit(0)).count() == 0
