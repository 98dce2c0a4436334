"""Records, clips and channels: validity, bounds, names and small conversions, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The receiver's band, the clip limits and the states that stored transcriptions may have.
CENTER_HZ, BAND_HZ, GUARD_HZ, CALLING_HZ = 156_750_000, 2_400_000, 25_000, 156_525_000
LEAST_SIGNAL_SECONDS = 0.35
LEAST_TIMEOUT_MS, TIMEOUT_PER_SECOND_MS = 90_000, 2000
CHANNEL_RATE = 96_000
STATES = ("queued", "transcribing", "complete", "skipped", "error")


def can_channelize(hz: Column) -> Column:
    """Within the band around the centre, less a guard on either side."""
    return F.abs(hz - CENTER_HZ) <= BAND_HZ / 2 - GUARD_HZ


def has_speech(text: Column) -> Column:
    """A letter or a digit of any script."""
    return text.rlike(r"[\p{L}\p{N}]")


def clip_bounds(start_ms: Column, seconds: Column, first: Column, last: Column) -> Column:
    """start, stop in milliseconds: the active part, held within the clip; what isn't known counts as 0, or as the end."""
    length = F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0)))
    begin = F.greatest(F.lit(0.0), F.least(length, F.coalesce(first, F.lit(0.0))))
    end = F.greatest(begin, F.least(length, F.coalesce(last, length)))
    return F.struct((start_ms + begin * 1000).alias("start"), (start_ms + end * 1000).alias("stop"))


def activity_slice(n_bytes: Column, rate: Column, first: Column, last: Column) -> Column:
    """start, stop in bytes of the active part of 16-bit samples, on sample edges; all of it if either end isn't known."""
    even = lambda s: F.floor(s * rate * 2 / 2) * 2
    start = F.greatest(F.lit(0), F.least(n_bytes, even(first)))
    stop = F.greatest(start, F.least(n_bytes, even(last)))
    known = first.isNotNull() & last.isNotNull()
    return F.struct(F.when(known, start).otherwise(0).alias("start"), F.when(known, stop).otherwise(n_bytes).alias("stop"))


def accepts(at_ms: Column, n_bytes: Column, rate: Column, target_hz: Column, hz: Column, cutoff_ms: Column) -> Column:
    """Recovered sound of the target's frequency (or an unknown one) that doesn't end before the cut-off, within a millisecond."""
    return (hz.isNull() | (hz == target_hz)) & (at_ms + n_bytes / 2 / rate * 1000 + 1 >= cutoff_ms)


def segment_is_valid(s: Column) -> Column:
    """``s``: slot, id, channel, started, ended, seconds, level, wav_bytes, opus_bytes, spans (bytes, noise), state, text, as stored."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    spans = F.forall(s["spans"], lambda x: F.coalesce(x["bytes"] > 0, F.lit(False)) & (x["noise"].isNull() | finite(x["noise"])))
    numbers = finite(s["seconds"]) & (s["seconds"] > 0) & finite(s["level"]) & (s["wav_bytes"] >= 0) & (s["opus_bytes"] >= 0)
    said = s["state"].isNull() | (s["state"].isin(*STATES) & s["text"].isNotNull())
    times = F.try_to_timestamp(s["started"]).isNotNull() & F.try_to_timestamp(s["ended"]).isNotNull()
    return F.coalesce(s["slot"].isin("A", "B") & (s["id"] > 0) & (s["channel"] != "") & times & numbers & s["spans"].isNotNull() & spans & said, F.lit(False))


def vad_segments(output: Column) -> Column:
    """How many stretches of speech a detector's output reports, or null if any part of it isn't as it should be."""
    lines = F.filter(F.transform(F.split(output, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    count = F.regexp_extract(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), r"^Detected (\d{1,5}) speech segments:$", 1).try_cast("int")
    rule = r"^Speech segment (\d+): start = (\d+(?:\.\d+)?), end = (\d+(?:\.\d+)?)$"
    part = lambda x, i: F.regexp_extract(x, rule, i).try_cast("double")
    good = lambda x, i: F.coalesce((part(x, 1) == i) & (part(x, 3) > part(x, 2)), F.lit(False))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    placed = F.transform(rest, good)
    return F.when((count <= 10_000) & (F.size(rest) == count) & F.forall(placed, lambda x: x), count)


def wrap_phase(angle: Column) -> Column:
    """Into a turn around zero; both ends stay."""
    return F.when(angle > math.pi, angle - 2 * math.pi).when(angle < -math.pi, angle + 2 * math.pi).otherwise(angle)


def half_away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def soft_limited(sample: Column) -> Column:
    return half_away(F.tanh(sample * 2.5) * 30_000).cast("int")


def gcd(a: Column, b: Column) -> Column:
    """By remainders: 48 steps suffice for numbers of 32 bits."""
    pair = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), pair, step, lambda s: s["a"])


def oscillator_period(rate: Column, offset_hz: Column) -> Column:
    """Samples after which a mixing table repeats."""
    return F.when(offset_hz == 0, F.lit(1).cast("long")).otherwise((rate / gcd(rate, offset_hz)).cast("long"))


def timeout_ms(seconds: Column) -> Column:
    return F.greatest(F.lit(LEAST_TIMEOUT_MS).cast("long"), F.ceil(seconds * TIMEOUT_PER_SECOND_MS))


def text_value(json: Column) -> Column:
    """Trimmed text from a JSON text, or from the value of an object that has one; null where there is none."""
    kind = F.substring(F.ltrim(json), 1, 1)
    inner = F.when(kind == "{", F.to_json(F.try_variant_get(F.try_parse_json(json), "$.value", "variant"))).otherwise(json)
    said = F.when(F.substring(inner, 1, 1) == '"', F.try_variant_get(F.try_parse_json(inner), "$", "string"))
    return F.nullif(F.trim(said), F.lit(""))


def json_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines as maps of their members' JSON; blank lines go, a line that isn't an object is an error."""
    kept = lines.where(F.trim(column) != "")
    parsed = F.try_parse_json(column)
    ok = F.schema_of_variant(parsed).startswith("OBJECT")
    checked = F.when(F.coalesce(ok, F.lit(False)), parsed).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(column, 1, 80))).cast("string").cast("variant"))
    return kept.withColumn("row", checked)
