import struct

import pytest
from pyspark.sql import functions as F

from tidewake.operators import ordered, signal
from tidewake.sources import frames, sinks

KEYED = "key long, payload binary"


def test_a_version_is_seen_when_it_is_published(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.range(3).toDF("n")
    sinks.publish(rows, folder, 1)
    rows.where("n > 0").write.parquet(f"{folder}/versions/{2:012d}")  # as if the writer were lost before the number
    assert sinks.newest(spark, folder, "n long").count() == 3
    sinks.publish(rows.where("n > 1"), folder, 2)
    sinks.publish(rows.where("n > 1"), folder, 2)
    assert sinks.newest(spark, folder, "n long").count() == 1


def test_snapshots_write_what_changed(spark, tmp_path):
    folder = f"file://{tmp_path}"
    first = sinks.snapshot(spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b""), (4, None), (5, b"long")], KEYED), folder, 1, largest=3)
    assert sorted(r.key for r in first.collect()) == [1, 2]
    second = sinks.snapshot(spark.createDataFrame([(2, b"b"), (1, b"c")], KEYED), folder, 2, first, 3)
    assert sorted((r.key, r.stored) for r in second.collect()) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, sinks.payloads(spark, folder, second).collect())) == [(1, b"c"), (2, b"b")]
    assert spark.read.parquet(f"{folder}/payloads/stored=2").count() == 1


def test_admission(spark):
    fields, day = "id long, started string, ended string, bytes long", "2024-01-%02dT00:00:00Z"
    old = spark.createDataFrame([(1, day % 1, day % 1, 5), (2, day % 8, day % 8, 5), (3, day % 9, day % 9, 4)], fields)
    new = spark.createDataFrame([(4, day % 10, day % 10, 99), (5, day % 10, day % 10, 4)], fields)
    now = F.unix_millis(F.to_timestamp(F.lit(day % 10)))
    assert sorted(r.id for r in sinks.admit(old, new, now, 5, 10).collect()) == [3, 5]  # 4 is too large, 1 too old, 2 no longer fits
    assert sinks.admit(old.limit(0), new.limit(0), now, 5, 10).count() == 0
    for wrong in ("soon", None):
        with pytest.raises(Exception, match="invalid timestamp"):
            sinks.admit(old, spark.createDataFrame([(9, day % 9, wrong, 1)], fields), now, 5, 10).collect()


def test_copies_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id long, x string")
    assert sinks.verified_copy(rows, "id", f"file://{tmp_path}/copy").count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.verified_copy(rows, "id", f"file://{tmp_path}/copy")


def _wav(*chunks):
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def test_wav_readers(spark):
    form = lambda channels=1, rate=24_000: (b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, 2 * rate, 2, 16))
    files = [
        _wav(form(), (b"data", b"abcd")),
        _wav((b"LIST", b"abc"), form(), (b"data", b"abcd"), (b"data", b"")),
        _wav(form(), (b"data", b"abcd"))[:-1],
        _wav(form(), (b"data", b"abcd"), (b"LIST", b"abcd"))[:-1],  # cut behind the data
        _wav(form(2), (b"data", b"abcd")),
        _wav(form(1, 0), (b"data", b"abc")),
        _wav(form()),
        b"",
        None,
        b"RIFF",
    ]
    df = spark.createDataFrame(list(enumerate(files)), "i long, data binary")
    got = {r.i: (r.strict, r.playable, r.mono) for r in frames.wav_parts(df, "i").select("i", frames.strict_wav(24_000).alias("strict"), frames.playable_wav().alias("playable"), frames.mono_wav().alias("mono")).collect()}
    y, n = True, False
    assert [got[i] for i in range(10)] == [(y, y, y), (y, y, y), (n, n, n), (n, y, y), (n, y, n), (n, n, y), (n, n, n), (n, n, n), (n, n, n), (n, n, n)]


def test_windows_of_energy(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0, 1.0, 0.0, 1.0, 1.0]), (1, [2.0]), (2, [0.0, 0.0, 0.0])], "i int, x array<double>")
    got = {r.i: tuple(r.w) for r in df.select("i", signal.loudest_window(F.col("x"), 2, 1).alias("w")).collect()}
    assert got == {0: (1, 2.0), 1: (0, 4.0), 2: (0, 0.0)}  # of equal ones the first


def test_orders_within_keys(spark):
    rows = [("a", 1, 10, 5.0), ("a", 2, 10, 1.0), ("a", 3, 35, 2.0), (None, 4, 3, 7.0), (None, 5, 99, 8.0), ("b", 6, 0, None)]
    df = spark.createDataFrame(rows, "key string, id long, at long, x double")
    linked = ordered.with_previous(df, ["at", "id"], ["id"], 10, keys=["key"])
    assert {r.id: r.id_prev for r in linked.collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: 4, 6: None}
    ones = linked.withColumn("one", F.lit(1).cast("long"))
    assert {r.id: r.nth for r in ordered.with_running_sum(ones, ["at", "id"], "one", "nth", ["key"]).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2, 6: 1}
    assert {r.id: r.top for r in ordered.with_highest_before(df, "key", ["at", "id"], "x", "top", 10).collect()} == {1: None, 2: 5.0, 3: 5.0, 4: None, 5: 7.0, 6: None}
    assert {r.id: r.n for r in ordered.with_trailing(df, "key", "at", 25, {"n": F.lit(1)}).collect()} == {1: 2, 2: 2, 3: 3, 4: 1, 5: 1, 6: 1}
    q = {r.key: (r.n, r.q, r.q_low, r.q_high) for r in ordered.quantiles_by(df, "key", "x", {"q": 0.25}, 0.5).collect()}
    assert q == {"a": (3, 1.5, 1.0, 2.0), None: (2, 7.25, 7.0, 8.0)}
    assert ordered.quantiles_by(df.limit(0), "key", "x", {"q": 0.5}, 1).count() == 0
