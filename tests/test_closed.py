from tidewake.operators import retention


def test_open_events_stay_and_the_oldest_closed_ones_go(spark):
    rows = [("a", at, i, end) for i, (at, end) in enumerate([(1, None), (2, 90), (3, 100), (4, 120), (5, 130), (6, None), (7, 140)])] + [(None, 1, 9, 100), (None, 2, 10, 99), ("b", 1, 11, None), ("b", 2, 12, None), ("b", 3, 13, 150)]
    df = spark.createDataFrame(rows, "key string, at long, id long, ended long")
    keep = lambda n: sorted(r.id for r in retention.keep_closed(df, "key", ["at", "id"], "ended", 200, 100, n, width=3).collect())
    assert keep(100) == [0, 2, 3, 4, 5, 6, 9, 11, 12, 13]  # what ended at 100 is just young enough
    assert keep(4) == [0, 4, 5, 6, 9, 11, 12, 13]  # a's two open ones count
    assert keep(1) == [0, 5, 9, 11, 12]
    assert retention.keep_closed(df.limit(0), "key", ["at", "id"], "ended", 200, 100, 1).count() == 0
