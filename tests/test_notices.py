import hashlib

import pytest
from pyspark.sql import functions as F

from tidewake.functions import notices
from tidewake.sources import sinks


def test_diagnostic(spark):
    long = "error " + "x" * 600
    logs = ["", " \n\r\n", None, "a\nb", "usb lost\nb", "failed\nUSB lost\nb", "busy\nfailed\nlost", "claim_interface\nusb_claim_interface error", "exit status 2", "failed\nrtl_sdr stopped: exit status 1", long + "\n" + long]
    rows = spark.createDataFrame(list(enumerate(logs)), "k int, log string")
    got = [r.t for r in rows.orderBy("k").select(notices.diagnostic(F.col("log")).alias("t")).collect()]
    used = notices.IN_USE
    assert got[:-1] == [None, None, None, "b", "usb lost", "failed\nUSB lost", "busy" + used, "usb_claim_interface error" + used, "exit status 2", "failed"]
    assert got[-1] == ("x" * 500 + "\n" + "x" * 500)[-1000:]


def test_progress(spark):
    cases = [(False, "e", True, 0, 0, 0), (True, "e", True, 0, 0, 0), (True, "", True, 0, 0, 0), (True, None, True, 1, 1001, 0), (True, None, True, 3, 2000, 2), (True, None, False, 3, 1, 1), (None, None, None, None, None, None)]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "i int, e boolean, w string, a boolean, c long, m long, p long")
    got = [tuple(r.t) for r in rows.orderBy("i").select(notices.progress(*map(F.col, "ewacmp")).alias("t")).collect()]
    none = ("Unavailable", "Transcription status is unavailable.", "unavailable")
    assert got == [
        ("Off", "Transcription is switched off.", "unavailable"),
        ("Needs attention", "e", "error"),
        ("Caught up", "No clips waiting for transcription.", "caught-up"),
        ("Backlog", "1 clip unfinished · 2 s of audio · waiting to start", "backlog"),
        ("Backlog", "3 clips unfinished · 2 s of audio · 2 processing", "backlog"),
        none,
        none,
    ]


def test_numbers_and_keys(spark):
    numbers = {0.0: "0", -0.0: "0", 1.0: "1", 0.1: "0.1", -2.5: "-2.5", 1e-6: "0.000001", 123456.0: "123456", 0.00035000000000000005: "0.00035000000000000005", 1e20: "100000000000000000000", 10.0: "10"}
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double")
    assert [r.t for r in rows.orderBy("k").select(notices.number_text(F.col("x")).alias("t")).collect()] == [numbers[x] for x in numbers]
    rows = spark.createDataFrame([("a", b"1234", [(2, 0.5), (2, None)]), ("", b"12", [(2, 1.0)]), (None, b"12", [(2, 1.0)]), ("b", b"", [])], "key string, pcm binary, spans array<struct<bytes: long, noise: double>>")
    key = notices.quality_key(F.col("key"), F.lit(7), F.col("pcm"), F.col("spans")).alias("t")
    got = {r.key: r.t for r in rows.select("key", key).collect()}
    assert got == {"a": hashlib.sha256(b"aquieting:7;12342:0.5;2:unknown;").hexdigest(), "": None, None: None, "b": hashlib.sha256(b"bquieting:7;").hexdigest()}
    short = spark.createDataFrame([("a", b"1234", [(2, 0.5)])], rows.schema)
    with pytest.raises(Exception, match="cover"):
        short.select(key).collect()


def test_amend(spark):
    archive = spark.createDataFrame([(k, "old", b"1", "v", None) for k in range(6)], "id long, transcript string, opus binary, voice string, error string")
    changes = [(1, 1, "transcript", "new", None), (2, 1, "narration", "w", b"22"), (3, 1, "failure", "f" * 1200, None), (4, 1, "transcript", "a", None), (4, 2, "narration", "w", b""), (4, 3, "transcript", None, None), (5, 1, "failure", "f", None), (5, 2, "narration", "w", b"333"), (9, 1, "transcript", "x", None)]
    df = spark.createDataFrame(changes, "id long, at int, kind string, text string, opus binary")
    got = {r.id: (r.transcript, r.narration_bytes, r.voice, r.error) for r in sinks.amend(archive, df).collect()}
    assert got == {0: ("old", 1, "v", None), 1: ("new", 0, None, None), 2: ("old", 2, "w", None), 3: ("old", 0, None, "f" * 1000), 4: (None, 0, None, None), 5: ("old", 3, "w", None)}
    assert sinks.amend(archive.limit(0), df).count() == 0
