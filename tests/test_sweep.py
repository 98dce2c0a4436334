from pathlib import Path

from pyspark.sql import functions as F

from tidewake.operators import scanning, sessions
from tidewake.sources import sinks


def there(folder, part):
    return sorted(int(p.name.split("=")[-1]) for p in Path(folder, part).iterdir() if p.is_dir())


def test_a_sweep_leaves_what_readers_may_hold(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = lambda *payloads: spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "key long, payload binary")
    manifest = None
    for version, payloads in enumerate(([b"a", b"b", b"c"], [b"a", b"B", b"C"], [b"A", b"B", None], [b"A", b"B", b"cc"]), 1):
        manifest = sinks.snapshot(rows(*payloads), folder, version, manifest)
    assert sorted((r.key, r.stored) for r in manifest.collect()) == [(0, 3), (1, 2), (2, 4)]
    Path(folder, "payloads", "stored=9").mkdir()  # one that is being written
    assert sinks.sweep(spark, folder, 2, held=(2,)) == ["versions/000000000001"]  # version 2 still needs the first's payloads
    assert there(folder, "payloads") == [1, 2, 3, 4, 9]
    assert sinks.sweep(spark, folder, 2) == ["payloads/stored=1", "versions/000000000002"]
    assert there(folder, "versions") == [3, 4]
    assert sinks.sweep(spark, folder, 2) == []
    assert sorted(bytes(r.payload) for r in sinks.payloads(spark, folder, manifest).collect()) == [b"A", b"B", b"cc"]
    assert sinks.sweep(spark, folder, 5) == []  # older ones are gone already


def test_payloads_little_wanted_are_written_again(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = lambda *payloads: spark.createDataFrame(list(enumerate(payloads)), "key long, payload binary")
    first = sinks.snapshot(rows(b"a", b"b", b"c", b"d"), folder, 1, worth=0.5)
    second = sinks.snapshot(rows(b"a", b"b", b"C", b"D"), folder, 2, first, worth=0.5)
    assert sorted((r.key, r.stored) for r in second.collect()) == [(0, 1), (1, 1), (2, 2), (3, 2)]  # just half
    third = sinks.snapshot(rows(b"a", b"B", b"C", b"D"), folder, 3, second, worth=0.5)
    assert sorted((r.key, r.stored) for r in third.collect()) == [(0, 3), (1, 3), (2, 2), (3, 2)]
    assert sinks.sweep(spark, folder) == ["payloads/stored=1", "versions/000000000001", "versions/000000000002"]
    assert sinks.snapshot(rows(b"a").limit(0), folder, 4, third, worth=0.5).count() == 0


def test_trimmed(spark):
    cases = [(10, 2, 8), (10, None, None), (10, -5, 99), (10, 8, 2), (10, 12, None), (0, 3, 4)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, n int, a int, b int")
    got = [tuple(r.t) for r in rows.orderBy("k").select(sessions.trimmed(F.col("n"), F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == [(2, 8), (0, 10), (0, 10), (8, 8), (10, 10), (0, 0)]


def test_adaptive_choice(spark):
    visits = [("a", 900, 0.0), ("b", 400, 1.0), ("c", 500, 4.0)]
    cases = [(["a", "b", "c"], visits, "x"), (["a", "b", "c"], visits, "c"), (["a"], visits, "a"), ([], visits, None), (["a", "d", "e"], visits, "a"), (["b", "f"], [], None), (["a", "g"], [("a", 5000, -3.0), ("g", 1000, None)], None)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c array<string>, v array<struct<channel: string, visited: long, score: double>>, now string")
    got = [(r.b.channel, r.b.priority) if r.b else (None, None) for r in rows.orderBy("k").select(scanning.adaptive_choice(F.col("c"), F.col("v"), F.lit(1000), F.col("now")).alias("b")).collect()]
    assert got == [("c", 2000.0), ("b", 1050.0), ("a", 100.0), (None, None), ("d", 86_400_000.0), ("b", 86_400_000.0), ("a", 1.0)]
