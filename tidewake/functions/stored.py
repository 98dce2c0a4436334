"""Stored settings, caches and model files: what is damaged or of the wrong type gives way to a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults and limits of stored transcription settings.
MODEL, WEATHER_MODEL = "base.en-q5_1", "base.en-q5_1"
THREADS, MOST_THREADS = 2, 16
MOST_OVERLAP = 30.0


def _typed(value: Column, path: str, kind: str, sql_type: str) -> Column:
    """The value at ``path`` if it is of that JSON type; null otherwise."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found).rlike(kind), F.try_variant_get(value, path, sql_type))


def settings(text: Column, overlap: float, batch_seconds: float) -> Column:
    """A struct of transcription settings; null or damaged text gives all the defaults."""
    v = F.try_parse_json(text)
    number = "^(BIGINT|DECIMAL|DOUBLE)"

    def threads(path):
        n = _typed(v, path, number, "double")
        return F.coalesce(F.when((n == F.floor(n)) & n.between(1, MOST_THREADS), n.cast("int")), F.lit(THREADS))

    seconds = _typed(v, "$.overlapSeconds", number, "double")
    return F.struct(
        F.coalesce(_typed(v, "$.enabled", "^BOOLEAN", "boolean"), F.lit(False)).alias("enabled"),
        F.coalesce(_typed(v, "$.model", "^STRING", "string"), F.lit(MODEL)).alias("model"),
        threads("$.threads").alias("threads"),
        F.coalesce(_typed(v, "$.weatherModel", "^STRING", "string"), F.lit(WEATHER_MODEL)).alias("weather_model"),
        threads("$.weatherThreads").alias("weather_threads"),
        F.coalesce(F.when(seconds.between(0, min(MOST_OVERLAP, batch_seconds / 2)), seconds), F.lit(float(overlap))).alias("overlap_seconds"),
        F.coalesce(_typed(v, "$.keepModelsLoaded", "^BOOLEAN", "boolean"), F.lit(False)).alias("keep_loaded"),
    )


def tuning(text: Column) -> Column:
    """The stored object as a map of texts; empty if it is damaged or no object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def cached_calls(text: Column) -> Column:
    """Messages of a cache of version 1, as variants: those with a text ``receivedAt`` and a list ``rawSymbols``. A damaged cache is empty."""
    v = F.try_parse_json(text)
    kept = F.filter(F.try_variant_get(v, "$.messages", "array<variant>"), lambda m: _typed(m, "$.receivedAt", "^STRING", "string").isNotNull() & F.coalesce(F.schema_of_variant(F.try_variant_get(m, "$.rawSymbols", "variant")).startswith("ARRAY"), F.lit(False)))
    return F.coalesce(F.when(_typed(v, "$.version", "^BIGINT", "int") == 1, kept), F.array().cast("array<variant>"))


def models(spark: SparkSession, folder: str) -> DataFrame:
    """id, label, bytes of a folder's model files, the smallest first; from their names and sizes, without reading them."""
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").load(folder).select(F.regexp_extract(name, "(?i)^ggml-([a-z0-9._-]+)[.]bin$", 1).alias("id"), F.col("length").alias("bytes"))
    return found.where("id <> ''").select("id", F.replace("id", F.lit("-"), F.lit(" ")).alias("label"), "bytes").orderBy("bytes", "id")
