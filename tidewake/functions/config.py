"""A receiver's configuration as it is stored: what isn't there or isn't allowed gives way to the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults, bounds (lowest, highest) and defaults of older versions that are replaced.
NUMBERS = {"squelch": 20, "replayMinutes": 1440, "segmentSeconds": 60, "maxBufferMiB": 750, "dscRetentionHours": 168, "maxDscMessages": 100, "maxDscCacheKiB": 256}
BOUNDS = {"squelch": (0, 100), "replayMinutes": (1, 1440), "segmentSeconds": (2, 120), "maxBufferMiB": (16, 750), "dscRetentionHours": (1, 720), "maxDscMessages": (10, 1000), "maxDscCacheKiB": (64, 4096)}
REPLACED = {"replayMinutes": (120, 1440), "segmentSeconds": (5, 60), "maxBufferMiB": (256, 750)}
RATES, RATE, PPM, GAIN = (8000, 16_000, 24_000, 32_000, 48_000), 16_000, 150, 49.6
CHANNEL, CALLING, DEVICE = "16", "70", "0"
_NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


class _Stored:
    """Values of a JSON object with their kinds: a missing one is null, a stored null has the kind VOID."""

    def __init__(self, text: Column):
        self.object = F.try_parse_json(text)

    def kind(self, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.object, f"$.{name}", "variant"))

    def text(self, name: str) -> Column:
        return F.try_variant_get(self.object, f"$.{name}", "string")

    def number(self, name: str) -> Column:
        """Numerals in texts count, an empty text and a stored null are 0; null for what is no finite number."""
        kind, said = self.kind(name), F.trim(self.text(name))
        read = F.when(said == "", 0.0).when(said.rlike(_NUMERAL), said.try_cast("double"))
        value = F.when(kind == "VOID", 0.0).when(kind == "STRING", read).when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(self.object, f"$.{name}", "double"))
        value = F.when(kind == "BOOLEAN", F.try_variant_get(self.object, f"$.{name}", "boolean").cast("double")).otherwise(value)
        return F.when(F.abs(value) < float("inf"), value)

    def says(self, name: str, *values: str) -> Column:
        return F.coalesce((self.kind(name) == "STRING") & self.text(name).isin(*values), F.lit(False))

    def given(self, name: str, default: str) -> Column:
        return F.coalesce(self.text(name), F.lit(default))


def configuration(text: Column, channels: Column, sidecar: str) -> Column:
    """The 21 fields. ``channels``: the names allowed, in capitals; ``sidecar``: the path where none is stored. Texts that are no object give the defaults.

    Only true and false are switches; names of channels count in any case; whole numbers are rounded down, ``ppm`` to the nearest, up from the middle.
    ``gainDb`` is null where it isn't stored, is null or is empty.
    """
    of = _Stored(text)
    switch = lambda name, other: F.coalesce((of.kind(name) == "BOOLEAN") & (F.try_variant_get(of.object, f"$.{name}", "boolean") == F.lit(other)), F.lit(False))
    held = lambda c, low, high: F.least(F.lit(high), F.greatest(F.lit(low), c))
    either = lambda name, word, other: F.when(of.says(name, word), word).otherwise(other)

    def whole(name):
        n = F.floor(F.coalesce(of.number(name), F.lit(float(NUMBERS[name])))).cast("double")
        value = held(n, *map(float, BOUNDS[name]))
        if name in REPLACED:
            old, new = REPLACED[name]
            value = F.when(n == old, float(new)).otherwise(value)
        return value.cast("long").alias(name)

    def channel(name, default):
        wanted = F.upper(of.given(name, default))
        return F.when(F.array_contains(channels, wanted), wanted).otherwise(default).alias(name)

    gain = F.when((of.kind("gainDb") != "VOID") & ~((of.kind("gainDb") == "STRING") & (of.text("gainDb") == "")), held(F.coalesce(of.number("gainDb"), F.lit(0.0)), 0.0, GAIN))
    trimmed = lambda value, default: F.when(F.trim(value) != "", F.trim(value)).otherwise(default)
    rate = of.number("sampleRate")
    return F.struct(
        (~switch("enabled", False)).alias("enabled"),
        switch("manageReceiverOwnership", True).alias("manageReceiverOwnership"),
        either("receiverOwner", "vhf", "ais").alias("receiverOwner"),
        F.when(of.says("receiverMode", "rtl_sdr", "rtl_fm"), "rtl_sdr").otherwise("demo").alias("receiverMode"),
        F.when(of.says("channelRegion", "US", "CA"), of.text("channelRegion")).otherwise("US_CA").alias("channelRegion"),
        channel("initialChannel", CHANNEL),
        either("slotAMode", "scan", "fixed").alias("slotAMode"),
        either("slotBMode", "scan", "fixed").alias("slotBMode"),
        channel("slotBChannel", CALLING),
        trimmed(F.coalesce(of.text("device"), of.text("deviceIndex"), F.lit(DEVICE)), DEVICE).alias("device"),
        trimmed(of.given("sidecarPath", sidecar), sidecar).alias("sidecarPath"),
        held(F.floor(F.coalesce(of.number("ppm"), F.lit(0.0)) + 0.5).cast("double"), -float(PPM), float(PPM)).cast("long").alias("ppm"),
        gain.alias("gainDb"),
        F.when(rate.isin(*map(float, RATES)), rate.cast("long")).otherwise(RATE).cast("long").alias("sampleRate"),
        *[whole(name) for name in NUMBERS],
    )
