import pytest

from tidewake.sources import replay
from tidewake.streaming import calls

SEGMENTS = "slot string, id long, channel string, started_ms long, total long, spans array<struct<bytes: long, noise: double>>"


def segment(slot, number, channel, *sizes, started=None):
    return slot, number, channel, number * 1000 if started is None else started, sum(sizes), [(n, n / 100) for n in sizes]


@pytest.fixture
def run(spark, tmp_path):
    spark.dataSource.register(replay.ReplaySource)

    def again(*rows):
        spark.createDataFrame(rows, SEGMENTS).repartition(2).write.mode("overwrite").parquet(f"file://{tmp_path}/segments")
        stream = spark.readStream.format("replay").option("path", f"file://{tmp_path}/segments").option("most", 5).load()
        found = calls.append_to(stream, f"file://{tmp_path}/run", replay.READ).collect()
        new = [r for r in found if tuple(r)[:5] + (r.after,) not in again.seen]
        again.seen |= {tuple(r)[:5] + (r.after,) for r in found}
        return sorted(((r.slot, r.id, r.begins, r.n, [tuple(s) for s in r.spans] if r.spans is not None else None, r.after) for r in new), key=lambda r: (r[:2], r[2] or 0))

    again.seen = set()
    return again


def test_a_stream_of_cursors(run):
    first = run(segment("A", 1, "16", 3, 6), segment("A", 3, "16", 4), segment("B", 2, "70", 2))
    # four bytes a read, as five is odd
    assert first == [
        ("A", 1, 0, 4, [(3, 0.03), (1, 0.06)], None), ("A", 1, 4, 4, [(4, 0.06)], None), ("A", 1, 8, 1, [(1, 0.06)], "advance"), ("A", 3, 0, 4, [(4, 0.04)], "edge"),
        ("B", 2, 0, 2, [(2, 0.02)], "edge"),
    ]
    # A's open segment grows and a new one follows on another channel; nothing comes twice
    assert run(segment("A", 1, "16", 3, 6), segment("A", 3, "16", 4, 2), segment("A", 5, "68", 1), segment("B", 2, "70", 2)) == [("A", 3, 4, 2, [(2, 0.02)], "channel-change"), ("A", 5, 0, 1, [(1, 0.01)], "edge")]
    # A's segments are retired up to 7; B's number is another segment now
    assert run(segment("A", 7, "68", 2), segment("B", 2, "70", 3, started=9)) == [("A", 5, None, 0, None, "retired"), ("A", 7, 0, 2, [(2, 0.02)], "edge"), ("B", 2, None, 0, None, "retired")]


def test_spans_that_do_not_cover_a_read_are_left_out():
    whole = {"slot": "A", "id": 1, "channel": "16", "total": 10}
    got = list(replay.reads(whole, [{"bytes": 6, "noise": None}], 0, 4, {"channel": "16"}))
    assert [(r[3], r[4], r[5], r[6]) for r in got] == [(0, 4, [{"bytes": 4, "noise": None}], None), (4, 4, None, None), (8, 2, None, "advance")]
    assert list(replay.reads(whole, [], 10, 4, None)) == []


def test_long_slots_are_many_tasks(tmp_path, spark):
    rows = [segment("A", k, "16", 2) for k in range(1, 201)]
    spark.createDataFrame(rows, SEGMENTS).write.parquet(f"file://{tmp_path}/s")
    reader = replay.ReplayReader(f"file://{tmp_path}/s", 64)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [len(p.segments) for p in parts] == [64, 64, 64, 8]
    out = [r for p in parts for r in reader.read(p)]
    assert [r[1] for r in out] == list(range(1, 201)) and [r[6] for r in out] == ["advance"] * 199 + ["edge"]
