from pyspark.sql import functions as F

from tidewake.functions import stored
from tidewake.operators import folds, playback


def test_retarget_rejects_what_stays_unlocked(spark):
    rows = [(1, 0, "A", "a", 3.0), (2, 500, "A", "b", 2.5), (3, 600, "B", "c", 1.9), (4, 1600, "B", "c", 1.9), (5, 3200, "A", "d", 4.0), (6, 9700, "A", "a", 9.0), (7, 9800, "B", "d", 4.5)]
    df = spark.createDataFrame([(s, 0, t, i, c, x, False) for i, t, s, c, x in rows], "slot string, day long, start_ms long, event_id long, channel string, score double, locked boolean")
    got = folds.fold_days(df, ["day"], ["start_ms", "event_id"], folds.retarget, "event_id long, target string")
    # B takes b at 500, as A is on a, and c is too weak; A leaves a at 1600 with nothing to go to and takes d at 3200, when B leaves b
    # for a; so at 9700, when A leaves d, a is B's and b is next; B leaves a then and takes d
    assert [r.target for r in got.orderBy("event_id").collect()] == ["a", "a", "b", "b", "d", "b", "d"]


def test_stored_settings(spark):
    texts = [None, "{", "[1]", '{"enabled": "true", "threads": "3", "model": 7, "overlapSeconds": 99}', '{"enabled": true, "threads": 3, "model": "m", "overlapSeconds": 1.5, "keepModelsLoaded": true}', '{"threads": 2.5}', '{"threads": 17}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r.s) for r in df.select("i", stored.settings(F.col("t"), 2, 20).alias("s")).orderBy("i").collect()]
    default = (False, stored.MODEL, stored.THREADS, stored.WEATHER_MODEL, stored.THREADS, 2.0, False)
    assert got[4] == (True, "m", 3, stored.WEATHER_MODEL, stored.THREADS, 1.5, True)
    assert [g for k, g in enumerate(got) if k != 4] == [default] * 6
    assert [r.m for r in df.select("i", stored.tuning(F.col("t")).alias("m")).orderBy("i").limit(3).collect()] == [{}, {}, {}]


def test_cached_calls(spark):
    texts = ['{"version": 1, "messages": [{"receivedAt": "x", "rawSymbols": [1]}, {"receivedAt": 3, "rawSymbols": []}, {"receivedAt": "y"}]}', '{"version": 2, "messages": [{"receivedAt": "x", "rawSymbols": []}]}', "{", None, '{"version": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", F.size(stored.cached_calls(F.col("t"))).alias("n")).orderBy("i").collect()] == [1, 0, 0, 0, 0]


def test_models(spark, tmp_path):
    for name, size in (("ggml-tiny-en.bin", 3), ("GGML-base.BIN", 2), ("other.bin", 9), ("ggml-.bin", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [tuple(r) for r in stored.models(spark, f"file://{tmp_path}").collect()] == [("base", "base", 2), ("tiny-en", "tiny en", 3)]


def test_playback(spark):
    quiet, loud = [1e-4, -1e-4] * 400, [0.5, -0.5] * 80
    df = spark.createDataFrame([(0, quiet, 1), (1, loud + quiet * 6, 1), (2, None, 1), (3, [], 1), (4, [None, 2.0], 1)], "i int, x array<double>, rate int")
    got = {r.i: r for r in playback.clean(df, "x", 16_000, "raw", 50).collect()}
    assert got[2].x is None and got[3].x == [] and got[4].x[0] == 0.0 and got[4].x[1] == 1.0 and got[0].rate == 1
    assert abs(got[0].x[-1]) < 1e-9  # closed
    assert got[1].x[:160] == loud and abs(got[1].x[160 * 19]) > 9e-5 and abs(got[1].x[-1]) < 1e-9  # open, held, closed
    assert playback.cleaned(quiet, 16_000, "raw", 0) is quiet
    steady = playback.cleaned([0.001 * (k % 16 < 8) for k in range(16_000)], 16_000, "strong", 0)
    assert max(map(abs, steady[-1600:])) < 0.16 * 1.45 * 0.002  # what is always there counts as noise


def test_batches_across_pieces(spark):
    import random

    from tidewake.operators import batches

    rng = random.Random(3)
    shapes = {"a": [rng.randint(0, 9) for _ in range(200)], "b": [5] * 60, "c": [0] * 20, None: [30, 1, 30, None], "d": [1] * 41}
    broken = {(k, i) for k, x in shapes.items() for i in range(len(x)) if rng.random() < (0.05 if k in ("a", "c") else 0)}
    rows = [(k, i + 1, s, (k, i) in broken, i * 7) for k, x in shapes.items() for i, s in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, nth long, size long, gap boolean, extra long")
    for piece in (1, 7, 1000):
        for full in (1, 20, 10_000):
            want, held, batch, last = set(), 0, 0, ()
            for k, nth, size, gap, extra in rows:
                if k != last:
                    last, held, batch = k, full, 0
                if gap or held >= full:
                    held, batch = 0, batch + 1
                held += size or 0
                want.add((k, nth, size, gap, extra, batch))
            assert {tuple(r) for r in batches.with_batches(df, ["k"], "nth", "size", "gap", full, piece).collect()} == want
    assert batches.with_batches(df.limit(0), ["k"], "nth", "size", "gap", 5).count() == 0
