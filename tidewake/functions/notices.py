"""What is told to people: the most useful line of a receiver's log, how far transcription is, and numbers as JSON writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that name a cause, lines that only tell an exit, and lines that tell of a device in use.
CAUSE = "error|failed|failure|lost|denied|unable|cannot|no device|not found|busy|permission|timeout|timed out|usb|rtl_sdr"
EXIT = r"^exit status \d+$|^(?:rtl_sdr stopped|sidecar stopped):?\s*exit status \d+$"
CLAIMED = "busy|claim[_ ]interface|interface.*claim|resource.*busy"
IN_USE = "; the SDR may be in use by AIS-Catcher; disable one receiver before enabling the other"
LINE, ALL = 500, 1000  #: characters told of a line, and in all


def _with(value: Column, tell) -> Column:
    """``tell`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), tell), F.lit(0))


def diagnostic(log: Column) -> Column:
    """The last line about a claimed device, else the last two causes, else the last line; null without any line. Long lines lose their beginning."""
    lines = F.filter(F.transform(F.split(log, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    causes = lambda ls: F.filter(ls, lambda x: x.rlike(f"(?i){CAUSE}") & ~x.rlike(f"(?i){EXIT}"))
    from_end = lambda xs, n: F.try_element_at(xs, F.lit(-n))
    short = lambda x: F.right(x, F.lit(LINE))

    def told(ls: Column, cs: Column) -> Column:
        claim = from_end(F.filter(cs, lambda x: x.rlike(f"(?i){CLAIMED}")), 1)
        two = F.concat(short(from_end(cs, 2)), F.lit("\n"), short(from_end(cs, 1)))
        return F.coalesce(F.concat(short(claim), F.lit(IN_USE)), F.right(two, F.lit(ALL)), short(from_end(cs, 1)), short(from_end(ls, 1)))

    return _with(lines, lambda ls: _with(causes(ls), lambda cs: told(ls, cs)))


def progress(enabled: Column, error: Column, available: Column, clips: Column, ms: Column, processing: Column) -> Column:
    """label, detail, state of transcription. ``error`` is a text or null; a null or false ``available`` is one that isn't known."""
    several = F.when(clips == 1, " clip").otherwise(" clips")
    under_way = F.when(processing > 0, F.concat(F.lit(" · "), processing.cast("string"), F.lit(" processing"))).otherwise(" · waiting to start")
    waiting = F.concat(clips.cast("string"), several, F.lit(" unfinished · "), F.ceil(ms / 1000).cast("string"), F.lit(" s of audio"), under_way)
    is_on, known = F.coalesce(enabled, F.lit(True)), F.coalesce(available, F.lit(False)) & clips.isNotNull()
    tell = lambda label, detail, state: F.struct(F.lit(label).alias("label"), detail.alias("detail"), F.lit(state).alias("state"))
    return (
        F.when(~is_on, tell("Off", F.lit("Transcription is switched off."), "unavailable"))
        .when(error != "", tell("Needs attention", error, "error"))
        .when(known & (clips == 0), tell("Caught up", F.lit("No clips waiting for transcription."), "caught-up"))
        .when(known, tell("Backlog", waiting, "backlog"))
        .otherwise(tell("Unavailable", F.lit("Transcription status is unavailable."), "unavailable"))
    )


def number_text(x: Column) -> Column:
    """A finite double from a millionth to 10^21, or zero, as JSON writes it: the shortest digits, without exponent or needless point."""
    plain = lambda places: F.regexp_replace(x.cast("string").cast(f"decimal(38,{places})").cast("string"), r"\.?0+$", "")
    return F.when(x == 0, "0").when(F.abs(x) < 1, plain(24)).otherwise(plain(16))


def quality_key(key: Column, intensity: Column, pcm: Column, spans: Column) -> Column:
    """SHA-256 that cleaned playback is kept under: of a caller's key, the intensity, the sound and its spans (array of bytes, noise). Null without a key.

    Spans that don't cover the sound are an error.
    """
    told = F.transform(spans, lambda s: F.concat(s["bytes"].cast("string"), F.lit(":"), F.coalesce(number_text(s["noise"]), F.lit("unknown")), F.lit(";")))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["bytes"]) == F.octet_length(pcm)
    head = F.concat(key, F.lit("quieting:"), intensity.cast("string"), F.lit(";")).cast("binary")
    digest = F.sha2(F.concat(head, pcm, F.array_join(told, "").cast("binary")), 256)
    return F.when(F.coalesce(key, F.lit("")) == "", None).when(covered, digest).otherwise(F.raise_error(F.lit("the spans don't cover the sound")).cast("string"))
