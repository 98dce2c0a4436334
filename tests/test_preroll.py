from tidewake.operators import preroll


def test_pieces_follow_each_other(spark):
    rows = [
        ("a", 1, 1_000, 500, False), ("a", 2, 1_200, 300, False), ("a", 3, 2_000, 100, False),  # the second begins where the first ends
        ("a", 4, 0, 400, True), ("a", 5, 300, 400, True), ("a", 6, 350, 50, True), ("a", 7, 900, 300, True), ("a", 8, 1_500, 100, True),  # the third lies within the second, the fifth comes too late
        ("b", 9, 5, 10, True), ("b", 10, 10, 10, True), (None, 11, 0, 9_000, False),
    ]
    df = spark.createDataFrame(rows, "key string, id long, at_ms long, dur_ms long, recovered boolean")
    got = sorted(((r.key, r.id, r.from_ms, r.to_ms, r.skipped_ms) for r in preroll.merged(df, ["key"], 10_000).collect()), key=str)
    assert got == sorted([
        ("a", 4, 0, 400, 0), ("a", 5, 400, 700, 100), ("a", 7, 900, 1_000, 0), ("a", 1, 1_000, 1_500, 0), ("a", 2, 1_500, 1_800, 0), ("a", 3, 2_000, 2_100, 0),
        ("b", 9, 5, 15, 0), ("b", 10, 15, 20, 5), (None, 11, 0, 9_000, 0),
    ], key=str)
    last = sorted((r.key, r.id) for r in preroll.merged(df.where("key is not null"), ["key"], 450).collect())
    assert last == [("a", 2), ("a", 3), ("b", 9), ("b", 10)]
    assert preroll.merged(df, ["key"], 5).where("key is null").count() == 1  # the newest stays whatever its length
    assert preroll.merged(df.limit(0), ["key"], 5).count() == 0
