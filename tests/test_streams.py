from tidewake.streaming import stateful

FIELDS = "slot string, event_id long, start_ms long, end_ms long, recovered boolean"


def test_state_goes_on_between_runs(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/run"
    batches = [
        [("A", 1, 1000, 2000, False), ("B", 2, 0, 500, False)],
        [("A", 3, 0, 1500, True), ("A", 4, 2000, 4000, False)],  # recovered sound goes in front of the open segment
        [("A", 5, 500, 900, True), ("A", 6, 4000, 4500, False), ("B", 7, 500, 900, False)],  # too late: closed by then
    ]
    for rows in batches:
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FIELDS).parquet(source)
        out = stateful.run_to_end(stateful.growing_segments(stream, 3500, {"A": 1, "B": 2}), ["slot", "segment_id"], stateful.SEGMENT, folder)
    got = sorted(map(tuple, out.collect()))
    assert got == [("A", 1, 0, 4000, 3, True), ("A", 3, 4000, 4500, 1, False), ("B", 2, 0, 900, 2, False)]


def test_sessions_go_on_between_runs(spark, tmp_path):
    fields, source, folder = "channel string, event_id long, start_ms long, score double", f"{tmp_path}/in", f"file://{tmp_path}/run"
    batches = [
        [("a", 1, 5_000, 2.0), ("a", 2, 5_400, 3.0), ("b", 3, 0, 1.0), (None, 9, 0, 1.0)],
        [("a", 4, 4_500, 4.0), ("a", 5, 3_000, 9.0), ("a", 6, 7_000, 1.0)],  # before the open session: one near enough, one not
        [("b", 7, 900, 1.0), ("a", 8, 5_500, 8.0), (None, 10, 2_000, 1.0)],  # a's open session starts at 7000 by now
    ]
    for rows in batches:
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)
        out = stateful.open_sessions(spark.readStream.schema(fields).parquet(source), folder, 1_000)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == [("a", 1, 4_500, 6_400, 4.0, 3), ("a", 2, 7_000, 8_000, 1.0, 1), ("b", 1, 0, 1_900, 1.0, 2), (None, 1, 0, 1_000, 1.0, 1), (None, 2, 2_000, 3_000, 1.0, 1)]


def test_rows_that_fit(spark):
    from tidewake.operators import retention

    sizes = [3, 9, 4, 2, 4, 8, 1, None, 1, 1, 5, 0]  # newest first
    df = spark.createDataFrame([(key, 1000 - i, i, s, "x") for key in ("a", None) for i, s in enumerate(sizes)], "key string, at long, id long, size long, extra string")
    got = retention.keep_fitting(df, "key", ["at", "id"], "size", 12, width=4)
    want, used = [], 0
    for i, s in enumerate(sizes):
        if s is not None and used + s <= 12:
            used, want = used + s, [*want, i]
    rows = got.collect()
    assert sorted(r.id for r in rows if r.key == "a") == want == sorted(r.id for r in rows if r.key is None)
    assert retention.keep_fitting(df.limit(0), "key", ["at", "id"], "size", 12).count() == 0


def test_frames_are_decided_when_what_they_need_has_come(spark, tmp_path):
    import statistics

    from pyspark.sql import functions as F

    from tidewake.operators import features
    from tidewake.streaming import lookahead

    frames = [(s, n, float((n * (7 + s)) % 5), float((n * n) % 11) / 4) for s, size in ((1, 90), (2, 10)) for n in range(size)]
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/run"
    for part in ([f for f in frames if f[1] < 20], [f for f in frames if 20 <= f[1] < 75 and f[0] == 1], [f for f in frames if f[1] >= 75]):
        spark.createDataFrame(part, lookahead.FRAMES).coalesce(1).write.mode("append").parquet(source)
        out = lookahead.decide(spark.readStream.schema(lookahead.FRAMES).parquet(source), folder, 3.0, 1.0)
    got = {(r.stream, r.n): (round(r.smooth, 6), round(r.mad, 6), r.candidate, r.open_tail) for r in out.collect()}
    want = {}
    for s, size in ((1, 90), (2, 10)):
        level, ratio = ([f[k] for f in frames if f[0] == s] for k in (2, 3))
        around = lambda x, n, k: x[max(0, n - k) : n + k + 1]
        smooth = [statistics.median(around(ratio, n, 5)) for n in range(size)]
        for n in range(size):
            m = statistics.median(around(smooth, n, 12))
            mad = statistics.median(abs(x - m) for x in around(smooth, n, 12))
            like = 17 <= n < size - 17 and level[n] >= 0 and statistics.median(around(level, n, 5)) >= 0 and abs(smooth[n] - 1) <= 2.5 and mad <= 1.5
            want[s, n] = (round(smooth[n], 6), round(mad, 6), like, n >= size - 17)
    assert got == want and any(v[2] for v in want.values())
    whole = features.candidates(spark.createDataFrame(frames, lookahead.FRAMES), ["stream"], 3.0, 1.0, stretch=20)  # margins beyond one stretch's neighbours aren't needed
    assert {(r.stream, r.n): (round(r.smooth, 6), round(r.mad, 6), r.candidate) for r in whole.where(F.col("n") >= 0).collect()} == {k: v[:3] for k, v in want.items()}
