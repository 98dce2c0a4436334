from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewake.streaming import calls

HEARD = "receiver long, event_id long, arrived_ms long, start_ms long, dur_ms long, open boolean, kind string"
TIMED = "receiver long, event_id long, start_ms long, dur_ms long"


def _run(spark, source, folder, rows, schema, made, out):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return sorted(map(tuple, calls.append_to(made(spark.readStream.schema(schema).parquet(source)), folder, out).collect()))


def test_a_call_goes_on_in_the_next_run(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/run"
    live = lambda i, at, ms, is_open=True: (1, i, at, at, ms, is_open, "live")
    made = lambda s: calls.call_outcomes(s, 2_000)
    first = [live(1, 0, 100), live(2, 100, 5_000, False), live(3, 5_100, 3_000, False), (2, 4, 0, 0, 0, False, "target"), (1, 5, 5_200, 1, 50, False, "recovered")]
    got = _run(spark, source, folder, first, HEARD, made, calls.OUTCOMES)
    assert [g[2] for g in got] == ["buffered", "buffered", "buffered", "buffered", "target"]
    second = [live(6, 8_100, 250), (1, 7, 8_200, 4_000, 100, False, "recovered"), live(8, 8_350, 100)]
    got = [g for g in _run(spark, source, folder, second, HEARD, made, calls.OUTCOMES) if g[1] >= 6]
    # the oldest 5.1 s of the pre-roll went when 7 s were full; what was sent on completes a segment, so nothing goes in front
    assert got == [(1, 6, "locked", 0, 3, 3, 0), (1, 7, "refused", 0, 0, None, 0), (1, 8, "stored", 0, 0, None, 100)]
    third = [live(9, 8_500, 5_000, False), (1, 10, 13_600, 13_000, 498, False, "recovered"), (1, 11, 13_700, 13_000, 499, False, "recovered"), (1, 12, 20_000, 20_000, 0, False, "target"), (1, 13, 20_001, 15_000, 900, True, "recovered"), (1, 14, 21_000, 7, 0, False, "reset"), (1, 15, 21_001, 0, 50, True, "recovered")]
    got = [g for g in _run(spark, source, folder, third, HEARD, made, calls.OUTCOMES) if g[1] >= 9]
    assert [(g[1], g[2], g[3]) for g in got] == [(9, "ended", 13_500), (10, "late", 13_500), (11, "buffered", 13_500), (12, "target", 20_000), (13, "late", 20_000), (14, "reset", 7), (15, "buffered", 7)]


def test_recovered_sound_goes_in_front_until_a_segment_is_stored():
    call, row = calls.Call(), lambda kind, at, ms, is_open=True: Row(event_id=at, start_ms=at, dur_ms=ms, open=is_open, kind=kind)
    outcome, roll, sent = calls.taken(call, [], row("live", 10, 200), 1_000)
    assert (outcome, roll, sent) == ("locked", [], [(10, 200)])
    assert [calls.taken(call, [], row("recovered", at, 300), 1_000)[0] for at in (1, 2, 3, 4)] == ["prepended", "prepended", "prepended", "refused"]


def test_a_batch_closes_by_a_timer_in_a_later_run(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/run"
    made = lambda s: calls.closed_when_idle(s.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", "0 seconds"), 6_000)
    assert _run(spark, source, folder, [(1, 1, 1_000, 10), (1, 2, 6_999, 20), (2, 3, 2_000, 5)], TIMED, made, calls.CLOSED) == []
    # the first receiver stays silent: the second one's rows move the watermark past its timer
    got = _run(spark, source, folder, [(2, 4, 8_000, 5), (2, 5, 12_000, 5)], TIMED, made, calls.CLOSED)
    assert got == [(2, 2_000, 2_000, 1, 5)]
    got = _run(spark, source, folder, [(3, 6, 13_000, 1)], TIMED, made, calls.CLOSED)
    assert got == [(1, 1_000, 6_999, 2, 30), (2, 2_000, 2_000, 1, 5)]


def test_batches_keep_their_overlap_and_go_on_in_the_next_run(spark, tmp_path):
    schema, source, folder = "receiver long, event_id long, start_ms long, dur_ms long, active boolean, setting string", f"{tmp_path}/in", f"file://{tmp_path}/run"
    made = lambda s: calls.batched_clips(s, 1_000, 300, 500)
    clip = lambda i, at, ms, setting="a", active=True: (1, i, at, ms, active, setting)
    got = _run(spark, source, folder, [clip(1, 0, 600), clip(2, 600, 200), clip(3, 800, 250), clip(4, 1_050, 100)], schema, made, calls.BATCHES)
    assert got == [(1, 1, 3, 3, 0, 1_050, "full")]  # clips 2 and 3 stay, counted as 300 ms
    got = _run(spark, source, folder, [clip(5, 1_650, 599), clip(6, 2_249, 1)], schema, made, calls.BATCHES)
    assert got[1:] == [(1, 4, 6, 3, 2, 1_000, "full")]
    # only what was heard before waits: another setting closes nothing; then a gap, a clip without signal, and one that is full alone
    got = _run(spark, source, folder, [clip(7, 2_250, 10, "b"), clip(8, 2_761, 10, "b"), clip(9, 2_771, 5, "b", False), clip(10, 2_776, 5_000, "b"), clip(11, 7_776, 5, "c")], schema, made, calls.BATCHES)
    assert got[2:] == [(1, 7, 7, 1, 0, 10, "break"), (1, 8, 8, 1, 0, 10, "quiet"), (1, 10, 10, 1, 0, 5_000, "full")]
