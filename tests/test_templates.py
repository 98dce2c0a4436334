import numpy as np

from tidewake.operators import features
from tidewake.streaming import lookahead


def frames(n, seed):
    r = np.random.default_rng(seed)
    return [(1, i, float(r.choice([-60, -40, -30])) + float(r.standard_normal()), float(r.standard_normal() * (1 if i % 1400 < 700 else 9))) for i in range(n)]


def by_hand(rows, every, history):
    out = []
    for _, n, _, _ in rows:
        if n >= 199 and n % every == 0:
            near = [r for r in rows if n - history < r[1] <= n]
            level = sorted(r[2] for r in near)
            low, high = level[(len(level) - 1) // 4], level[3 * (len(level) - 1) // 4]
            loud = [r[3] for r in near if r[2] >= high]
            good = len(near) >= 200 and len(loud) >= 50
            centre = float(np.median(loud)) if good else 0.0
            out.append((1, n, centre, high, len(near), len(loud), bool(good and high - low >= 8 and np.median([abs(x - centre) for x in loud]) <= 2)))
    return out


def test_templates_over_stretches(spark):
    rows = frames(1_500, 1)
    df = spark.createDataFrame(rows, lookahead.FRAMES)
    for stretch in (64, 10_000):
        got = sorted(map(tuple, features.templates(df, "stream", stretch, 50, 600).collect()))
        assert got == by_hand(rows, 50, 600)
    assert {g[-1] for g in got} == {True, False}
    assert features.templates(df.limit(0), "stream").count() == 0


def test_a_stream_renews_its_template(spark, tmp_path):
    rows, source = frames(1_200, 2), f"{tmp_path}/in"
    for a, b in ((0, 210), (210, 640), (640, 1_200)):
        spark.createDataFrame(rows[a:b], lookahead.FRAMES).coalesce(1).write.mode("append").parquet(source)
        found = lookahead.renewed_templates(spark.readStream.schema(lookahead.FRAMES).parquet(source), f"file://{tmp_path}/run", 100, 400)
        assert sorted(map(tuple, found.collect())) == by_hand(rows[:b], 100, 400)


def test_too_few_frames_or_loud_ones_make_no_template():
    assert features.template(np.zeros(10), np.ones(10)) == (0.0, 0.0, 10, 10, False)
    level = np.concatenate([np.full(170, -60.0), np.arange(60.0)])
    assert features.template(level, np.ones(230))[-1] and not features.template(level - level, np.ones(230))[-1]
