import math

from pyspark.sql import functions as F

from tidewake.functions import config
from tidewake.operators import folds, signal


def test_configuration_keeps_to_what_is_allowed(spark):
    texts = [None, "{", "[1]", "{}", '{"enabled": null, "squelch": "", "ppm": 2.5, "gainDb": null, "replayMinutes": 9e9, "device": null, "deviceIndex": 4, "initialChannel": 6, "slotBChannel": "06"}', '{"ppm": "-2.5", "squelch": "1d", "gainDb": "x", "maxDscCacheKiB": false, "sidecarPath": " a "}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    known = F.array(F.lit("6"), F.lit("16"))
    got = [r.c.asDict() for r in df.select("i", config.configuration(F.col("t"), known, "s").alias("c")).orderBy("i").collect()]
    default = {
        "enabled": True, "manageReceiverOwnership": False, "receiverOwner": "ais", "receiverMode": "demo", "channelRegion": "US_CA", "initialChannel": "16", "slotAMode": "fixed", "slotBMode": "fixed",
        "slotBChannel": "70", "device": "0", "sidecarPath": "s", "ppm": 0, "gainDb": None, "sampleRate": 16_000, **config.NUMBERS,
    }
    assert got[:4] == [default] * 4
    assert got[4] == default | {"squelch": 0, "ppm": 3, "replayMinutes": 1440, "device": "4", "initialChannel": "6"}
    assert got[5] == default | {"ppm": -2, "gainDb": 0.0, "maxDscCacheKiB": 64, "sidecarPath": "a"}


def test_lost_chunks(spark):
    rows = [("A", t, i, size) for i, (t, size) in enumerate([(0, 10), (1, 20), (2, 30), (3, 40), (150, 50), (160, 60), (500, 70)])] + [(None, 0, 9, 5)]
    df = spark.createDataFrame(rows, "slot string, start_ms long, event_id long, bytes long")
    got = folds.fold_sorted(df, ["slot"], ["start_ms", "event_id"], ["slot", "event_id"], folds.lost_chunks(100), "slot string, event_id long, lost long, lost_bytes long")
    # the first works until 100; 20 and 30 are pushed out; 40 works from 100 to 200; 50 waits and is pushed out by 60
    assert {(r.event_id, r.lost, r.lost_bytes) for r in got.where("lost > 0").collect()} == {(2, 1, 20), (3, 1, 30), (5, 1, 50)}
    assert got.count() == 8
    empty = folds.fold_sorted(df.limit(0), ["slot"], ["start_ms"], ["slot"], folds.lost_chunks(100), "slot string, lost long, lost_bytes long")
    assert empty.count() == 0


def test_fit_and_follow(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [3.0, 5.0, 7.0]), (1, [], []), (2, [1.0, 1.0], [1.0, 2.0]), (3, [1.0, 2.0, 3.0, 4.0], [1.0, 3.0, 2.0, 4.0])], "i int, x array<double>, y array<double>")
    got = {r.i: r for r in df.select("i", signal.fit(F.col("x"), F.col("y")).alias("f"), signal.follow(F.col("x"), 0.5, 0.1).alias("v")).collect()}
    assert got[1].f is None and got[2].f is None and got[1].v == 0.0
    assert math.isclose(got[0].f.gain_db, 20 * math.log10(2)) and math.isclose(got[0].f.shift, 1.0, abs_tol=1e-12)
    assert math.isclose(got[3].f.pearson, 0.8) and math.isclose(got[3].f.rest_over_output_db, 10 * math.log10(1.8 / 30)) and got[0].v == 2.125
    flat = df.select("i", signal.si_sdr(F.transform("x", lambda v: v * 0), F.col("y")).alias("s")).collect()
    assert all(r.s is None for r in flat)


def test_edges_and_bins(spark):
    from tidewake.operators import sessions

    df = spark.createDataFrame([(0, [0, 0, 5, 0], 8.0), (1, [0, 0], 3.0), (2, [], 3.0), (3, None, 3.0), (4, [1, None, 0], 3.0), (5, [3, 1, 4, 1, 5, 9, 2], 1.0)], "i int, x array<int>, d double")
    got = {r.i: r for r in df.select("i", sessions.edge_quiet(F.col("x"), F.col("d")).alias("e"), sessions.downsampled(F.col("x"), 3).alias("s")).collect()}
    assert [tuple(got[i].e) for i in range(5)] == [(4.0, 2.0), (3.0, 3.0), (0.0, 0.0), (0.0, 0.0), (0.0, 2.0)]
    assert got[1].s == [0, 0] and got[3].s is None and got[5].s == [4, 5, 9] and got[0].s == [0, 5, 5]
