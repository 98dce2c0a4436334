import pytest
from pyspark.sql import functions as F

from tidewake.functions import dsc, text
from tidewake.operators import gates, signal
from tidewake.streaming.framer import read_frames


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_squelch_threshold(spark):
    assert one(spark, gates.threshold(F.lit(20))) == 0.22
    assert one(spark, gates.threshold(F.lit(0))) == float("inf")
    assert one(spark, gates.threshold(F.lit(30))) < 0.22


@pytest.mark.parametrize("data,word", [(0, 0b0000000111), (1, 0b1000000110), (127, 0b1111111000)])
def test_code_words(spark, data, word):
    assert one(spark, dsc.codeword(F.lit(data))) == word
    assert one(spark, dsc.data_of(F.lit(word))) == data
    assert one(spark, dsc.is_valid(F.lit(word))) and not one(spark, dsc.is_valid(F.lit(word ^ 8)))


def test_messages(spark):
    own = F.array(*map(F.lit, (36, 69, 99, 99, 90)))
    assert one(spark, dsc.mmsi(own)) == "366999999"
    assert one(spark, dsc.mmsi(F.array(*map(F.lit, (36, 69, 100, 99, 90))))) is None
    call = lambda *symbols: one(spark, dsc.message(F.array(*map(F.lit, symbols))))
    m = call(112, 36, 69, 99, 99, 90, 100, 13, 74, 91, 22, 15, 12, 34, 127)
    assert (m.format, m.category, m.own, m.nature, m.time_utc) == ("distress", "distress", "366999999", "fire / explosion", "12:34")
    assert m.position.latitude == pytest.approx(37.81666666666667) and m.position.longitude == pytest.approx(-122.25)
    m = call(120, 36, 60, 12, 34, 50, 108, 31, 60, 98, 76, 50, 117)
    assert (m.format, m.category, m.target, m.own) == ("individual", "safety", "366012345", "316098765")
    m = call(120, 120, 24, 73, 65, 0, 0, 100, 24, 73, 65, 0, 0, 100, 126, 90, 0, 6, 126, 126, 126, 117)
    assert (m.format, m.category, m.target, m.own, m.end) == ("individual", "routine", "247365000", "247365000", 117)
    believed = lambda valid, *symbols: one(spark, dsc.is_credible(dsc.message(F.array(*map(F.lit, symbols))), F.lit(valid)))
    ships = (116, 36, 60, 12, 34, 50, 108, 31, 60, 98, 76, 50, 117)
    assert believed(True, *ships) and not believed(False, *ships) and not believed(True, 7, 4, 9, 117) and not believed(True, 116, 120, *ships[2:])
    assert one(spark, dsc.position(F.array(*map(F.lit, (99, 99, 99, 99, 99))))) is None


def test_words(spark):
    assert text.edit_kinds("a b c".split(), "a x c d".split()) == (1, 0, 1)
    assert text.edit_kinds("a b".split(), ["b"]) == (0, 1, 0)
    assert one(spark, text.word_distance(F.split(F.lit("a b c"), " "), F.split(F.lit("a x c d"), " "))) == 2
    said = "Small craft advisory in effect. Seas nine feet today and tonight."
    assert text.without_repeated_start(said, "Seas nine feet today and tonight. Rough to very rough seas through Wednesday.") == "Rough to very rough seas through Wednesday."
    assert text.without_repeated_start("nothing alike here at all", "quite another text than before") == "quite another text than before"
    assert text.without_repeated_start("", "a b  c") == "a b c"
    words = [f"w{i}" for i in range(70)]
    assert text.without_repeated_start(" ".join(["x", "y", *words]), " ".join([*words[:30], "other", *words[31:], "new", "words"])) == "new words"
    assert one(spark, text.clean(F.lit("[00:00:01.000 --> 00:00:02.000]  [MUSIC] hello ♪\n\t[00:00:01.000 --> 00:00:02.000] there [STATIC] mayday (machine whirring) ♬ [inaudible]"))) == "hello there mayday [inaudible]"


def test_levels(spark):
    assert one(spark, signal.rms(F.array().cast("array<double>"))) == 0.0
    assert one(spark, signal.rms(F.array(F.lit(3.0), F.lit(-3.0)))) == 3.0
    assert signal.low_pass(15, 0.1).sum() == pytest.approx(1)


def test_no_frame_in_noise():
    assert read_frames("01" * 300) == [] and read_frames("") == []


def test_frames():
    word = lambda d: format(int(f"{d:07b}"[::-1], 2) << 3 | 7 - d.bit_count(), "010b")
    sent = lambda *symbols: "".join(word(s) + word(0) for s in symbols)
    call = (120, 36, 60, 12, 34, 50, 108, 31, 60, 98, 76, 50, 117)
    bits = "0" * 7 + sent(125, 125, *call) + "0" * 13 + sent(125, 125, 112, 127)
    assert read_frames(bits) == [(list(call), True), ([112, 127], True)]
    assert read_frames(bits.translate(str.maketrans("01", "10"))) == [(list(call), True), ([112, 127], True)]
    damaged = sent(125, 125, *call)
    flip = lambda s, at: s[:at] + str(1 - int(s[at])) + s[at + 1 :]
    frame = read_frames(flip(damaged, 20 * 5 + 2))
    assert len(frame) == 1 and frame[0][1] is False and len(frame[0][0]) == len(call)
    assert read_frames(flip(damaged, 20 * 2 + 8)) == []  # the first symbol must be valid
    assert read_frames(sent(125, 125, *range(1, 60), 117)) == []  # too long


def test_long_texts_are_aligned_whole(spark):
    """A text far beyond 40 words whose errors lie late, and kinds as the full table of costs gives them."""
    import random

    from tidewake.functions import text

    def table(a, b):
        n, m = len(a), len(b)
        c = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                c[i][j] = min(c[i - 1][j - 1] + (a[i - 1] != b[j - 1]), c[i - 1][j] + 1, c[i][j - 1] + 1)
        i, j, out = n, m, [0, 0, 0]
        while i or j:
            if i and j and c[i][j] == c[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                out[0] += a[i - 1] != b[j - 1]
                i, j = i - 1, j - 1
            elif i and c[i][j] == c[i - 1][j] + 1:
                out[1], i = out[1] + 1, i - 1
            else:
                out[2], j = out[2] + 1, j - 1
        return tuple(out)

    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        assert text.edit_kinds(a, b) == table(a, b)
    words = [f"w{r.randrange(3000)}" for _ in range(12_000)]
    assert text.edit_kinds(words, words[:9000] + words[9500:]) == (0, 500, 0)


def test_whole_texts(spark, tmp_path):
    from tidewake.plans import registry

    said = " ".join(f"w{i}" for i in range(100)) + " [noise] end"
    spark.createDataFrame([(1, said, "en", "s", len(said))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).first()
    assert run("asr_clean_whole").transcript == said.replace(" [noise]", "")
    assert run("edit_alignment_whole").d == 20
    assert (run("wer_summary_whole").words, run("wer_summary_whole").edits) == (102, 20)
    assert run("pair_summary_whole").words == 102
