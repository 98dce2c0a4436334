"""Digital selective calling: code words, symbols and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and what they stand for.
FORMATS = {102: "geographic", 112: "distress", 114: "group", 116: "all-ships", 120: "individual", 123: "auto-individual"}
CATEGORIES = {100: "routine", 108: "safety", 110: "urgency", 112: "distress"}
NATURES = {
    100: "fire / explosion", 101: "flooding", 102: "collision", 103: "grounding", 104: "listing", 105: "sinking", 106: "disabled and adrift",
    107: "undesignated distress", 108: "abandoning ship", 109: "piracy / armed attack", 110: "man overboard", 112: "EPIRB emission",
}
ENDS = (117, 122, 127)


def codeword(data: Column) -> Column:
    """Seven bits, lowest first, then the number of zeros among them in three."""
    flipped = F.conv(F.reverse(F.lpad(F.bin(data), 7, "0")), 2, 10).cast("int")
    return F.shiftleft(flipped, 3) + 7 - F.bit_count(data).cast("int")


def data_of(word: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(F.shiftright(word, 3)), 7, "0")), 2, 10).cast("int")


def is_valid(word: Column) -> Column:
    return word.bitwiseAND(F.lit(7)) == 7 - F.bit_count(F.shiftright(word, 3)).cast("int")


def mmsi(symbols: Column) -> Column:
    """Nine digits of five symbols of two each, the tenth left out; null if there aren't five, or one is over 99."""
    digits = F.substring(_digits(symbols), 1, 9)
    return F.when(_five(symbols), digits)


def _digits(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: F.lpad(s.cast("string"), 2, "0")), "")


def _five(symbols: Column) -> Column:
    return (F.size(symbols) == 5) & F.forall(symbols, lambda s: s <= 99)


def named(symbol: Column, names: dict[int, str], default: str | None) -> Column:
    out = F.lit(default)
    for code, name in names.items():
        out = F.when(symbol == code, name).otherwise(out)
    return out


def position(symbols: Column) -> Column:
    """Five symbols as quadrant, ddmm, dddmm to degrees; null for ten nines and for what lies off the globe."""
    digits = _digits(symbols)
    lat = F.substring(digits, 2, 2).cast("double") + F.substring(digits, 4, 2).cast("double") / 60
    lon = F.substring(digits, 6, 3).cast("double") + F.substring(digits, 9, 2).cast("double") / 60
    quadrant = F.substring(digits, 1, 1).cast("int")
    south, west = quadrant.isin(2, 3), quadrant.isin(1, 3)
    known = _five(symbols) & (digits != "9999999999") & (quadrant <= 3) & (lat <= 90) & (lon <= 180)
    return F.when(known, F.struct(F.when(south, -lat).otherwise(lat).alias("latitude"), F.when(west, -lon).otherwise(lon).alias("longitude")))


def message(symbols: Column) -> Column:
    """A call's symbols, its end included, as a struct; the format may stand once or twice at the beginning."""
    at = lambda i: F.try_element_at(symbols, i)
    offset = F.when(at(F.lit(2)) == at(F.lit(1)), 3).otherwise(2)
    five = lambda k: F.slice(symbols, offset + k, 5)
    distress = at(F.lit(1)) == 112
    hour, minute = at(offset + 11), at(offset + 12)
    time = F.when((hour <= 23) & (minute <= 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))
    return F.struct(
        named(at(F.lit(1)), FORMATS, "unknown").alias("format"),
        F.when(distress, "distress").otherwise(named(at(offset + 5), CATEGORIES, "unknown")).alias("category"),
        F.when(~distress, mmsi(five(0))).alias("target"),
        F.when(distress, mmsi(five(0))).otherwise(mmsi(five(6))).alias("own"),
        F.when(distress, named(at(offset + 5), NATURES, None)).alias("nature"),
        F.when(distress, position(five(6))).alias("position"),
        F.when(distress, time).alias("time_utc"),
        F.coalesce(at(F.lit(-1)), F.lit(0)).alias("end"),
        F.size(symbols).alias("length"),
    )


def is_credible(call: Column, valid: Column) -> Column:
    """All characters valid, a known format, category and end, the numbers that the format needs, and enough symbols."""
    distress = call["format"] == "distress"
    enough = call["length"] >= F.when(distress, 15).otherwise(13)
    numbers = call["own"].isNotNull() & (distress | call["target"].isNotNull())
    return valid & (call["format"] != "unknown") & (call["category"] != "unknown") & call["end"].isin(*ENDS) & numbers & enough
