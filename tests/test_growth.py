"""Steps whose work must grow no faster than their input, and their results at the places where cuts meet."""

import contextlib
import io
import time

from pyspark.sql import functions as F

from tidewake.functions import text
from tidewake.operators import ordered
from tidewake.plans import registry
from tidewake.sources import frames, replay, sinks

SMALL = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue().lower()


def test_envelope_looks_ahead_a_few_frames_only(spark):
    assert "unboundedfollowing" not in plan(registry.QUERIES["gate_envelope"](spark, SMALL))


class Counted(list):
    """Counts how often its items are taken."""

    taken = 0

    def __getitem__(self, k):
        self.taken += 1
        return super().__getitem__(k)

    def __iter__(self):
        return (self[k] for k in range(len(self)))


def test_reads_go_through_the_spans_once():
    spans = Counted({"bytes": 3, "noise": k / 4000} for k in range(4000))
    segment = {"slot": "A", "id": 1, "channel": "16", "total": 12_000}
    got = list(replay.reads(segment, spans, 2, 8, None))
    assert spans.taken < 20_000
    assert [r[3] for r in got] == list(range(2, 12_000, 8)) and got[-1][4:] == (6, [{"bytes": 3, "noise": 3998 / 4000}, {"bytes": 3, "noise": 3999 / 4000}], "edge")
    assert got[0][5] == [{"bytes": 1, "noise": 0.0}, {"bytes": 3, "noise": 1 / 4000}, {"bytes": 3, "noise": 2 / 4000}, {"bytes": 1, "noise": 3 / 4000}]


def test_payloads_are_not_shuffled_by_version(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(sinks, "publish", lambda rows, *rest, of=sinks.publish: (plans.append(plan(rows)), of(rows, *rest)))
    rows = lambda *payloads: spark.createDataFrame(list(enumerate(payloads)), "key long, payload binary")
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = sinks.snapshot(rows(b"a", b"b", b"c"), str(tmp_path / "s"), 1, worth=0.5)
        second = sinks.snapshot(rows(b"a", b"B", b"C"), str(tmp_path / "s"), 2, first, worth=0.5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    assert sorted((r.key, r.stored) for r in second.collect()) == [(0, 2), (1, 2), (2, 2)]
    assert "broadcasthashjoin [held" in plans[1]


def test_trailing_sums_are_running_ones(spark):
    df = spark.createDataFrame([(k, "a", at, 10**k) for k, at in enumerate((0, 9, 9, 10, 19, 20, 21, 45))] + [(8, "a", None, 5), (9, "a", None, 6), (10, None, 3, 7)], "id int, key string, at long, size long")
    found = ordered.with_trailing(df, "key", "at", 10, {"n": F.lit(1), "held": F.col("size")})
    assert "rangeframe, -" not in plan(found)  # such a frame is summed anew for each row
    near = {0: (0,), 1: (0, 1, 2), 2: (0, 1, 2), 3: (0, 1, 2, 3), 4: (1, 2, 3, 4), 5: (3, 4, 5), 6: (4, 5, 6), 7: (7,)}
    want = {k: (len(v), sum(10**j for j in v)) for k, v in near.items()} | {8: (2, 11), 9: (2, 11), 10: (1, 7)}
    assert {r.id: (r.n, r.held) for r in found.collect()} == want


def test_long_lists_align_quickly():
    words = [str(k * k % 3001) for k in range(20_000)]
    lost = [w for k, w in enumerate(words) if k % 5 != 4]
    begun = time.perf_counter()
    assert text.edit_kinds(words, lost) == (0, 4000, 0)
    assert text.edit_kinds(words[:4000], ["x" if k % 9 == 0 else w for k, w in enumerate(lost[:3200])]) == (356, 800, 0)
    assert time.perf_counter() - begun < 4  # it was over ten seconds, a cell of the table after the other


def test_streams_are_cut_and_found_again_in_order(spark):
    sizes = {stream: [(k * 7 + (stream or 0)) % 90 for k in range(stream or 3)] for stream in (None, *range(1, 40))} | {40: [300_000, 0, 5]}
    rows = [(stream, k, bytes([k % 9]) + n.to_bytes(4, "little") + bytes(n)) for stream, ns in sizes.items() for k, n in enumerate(ns)]
    chunks = frames.chunked(spark.createDataFrame(rows, "stream long, k long, f binary").orderBy(F.desc("k")), ["k"], "f", 37)
    found = frames.deframe(chunks.orderBy(F.rand(1)))
    for df in (chunks, found):
        assert "mapinarrow" in plan(df) and "flatmapgroups" not in plan(df) and "generate" not in plan(df)  # neither a call for each stream nor whole streams beside chunks
    assert {len(r.data) for r in chunks.where("stream = 40").collect()} == {37, (300_000 + 5 + 15) % 37}
    want = sorted((stream or 0, k, k % 9, n) for stream, ns in sizes.items() for k, n in enumerate(ns))
    assert sorted((r.stream or 0, r.frame_no, r.kind, len(r.payload)) for r in found.collect()) == want


def test_a_log_is_split_once(spark):
    assert plan(registry.QUERIES["log_diagnostic"](spark, SMALL)).count("split(") == 1


def test_endings_without_shared_words_are_not_compared(monkeypatch):
    compared = []
    monkeypatch.setattr(text, "_distances", lambda rows, *rest, of=text._distances: (compared.append(len(rows)), of(rows, *rest))[1])
    other = " ".join(f"w{k}" for k in range(60))
    assert text.without_repeated_start(f"{other} a b c d e", f"A b, x d e! {' '.join(f'v{k}' for k in range(60))}").split()[:2] == ["v0", "v1"]
    assert compared == [4, 5, 6, 7, 8]  # in longer endings too few words are of the text; shorter than four are not looked at


def test_texts_stay_out_of_the_order_of_all_records(spark):
    lines = plan(registry.QUERIES["archive_sessions"](spark, SMALL)).splitlines()
    windows = [k for k, line in enumerate(lines) if " window [" in line]
    assert windows and any("documents.parquet" in line for line in lines)
    for k in windows:
        depth = lines[k].index("window")
        for line in lines[k + 1 :]:
            if len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            assert "documents.parquet" not in line


def test_texts_go_to_the_alignment_and_not_their_words(spark, tmp_path):
    odd = "".join(chr(k) for k in range(1, 0x3000)) + "".join(f" {chr(k)}x" for k in range(1, 0x3000))
    rows = [(1, odd, "en"), (2, None, "en"), (3, "", "en"), (4, "A b\x0bc D. \u212ae \u0130 f'g 12", None), (5, "one two three four", "de"), (6, "-- ! \n\t", "de"), (7, " a\r\nb  c d e f g h i j ", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    drop = lambda c: F.filter(c, lambda w, i: i % 5 != 4)
    for name, words, tokens in (("edit_alignment", text.ascii_words, text.ascii_tokens), ("word_disagreement", text.ascii_runs, lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))):
        listed = docs.select("doc_id", "text", tokens(F.col("text")).alias("a")).withColumn("b", drop(F.col("a")))
        kinds = listed.select("doc_id", F.size("a").alias("n"), (F.col("a") == F.col("b")).alias("same"), text.alignment()("a", "b").alias("e")).select("doc_id", "n", "same", "e.*")
        found = docs.select("doc_id", text.text_alignment(words, text.without_every_fifth)("text").alias("e")).select("doc_id", "e.*")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, kinds.collect()))
        assert [[w.decode() for w in words(t)] for _, t, _ in rows if t is not None] == [r.a for r in listed.where("text is not null").orderBy("doc_id").collect()]
        assert "regexp" not in plan(registry.QUERIES[name](spark, str(tmp_path)))
    wer = {r.lang: tuple(r)[1:] for r in registry.QUERIES["wer_summary"](spark, str(tmp_path)).collect()}
    agree = {r.lang: tuple(r)[1:] for r in registry.QUERIES["pair_summary_whole"](spark, str(tmp_path)).collect()}
    assert wer["de"] == (3, 14, 2, round(2 / 14, 9)) and agree["de"] == (3, 2, 14, 2)
    assert wer[None] == (1, 7, 1, round(1 / 7, 9)) and agree["en"][:2] == (3, 1)
