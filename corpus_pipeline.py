"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame; all but the last
return the columns of ``docs``. What a stage returns is to be written before the next stage is called,
which is when the folders that it worked in are deleted.
"""

from __future__ import annotations

import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import langid, packing, pii, shared, simhash, suffixes

#: Bytes that a passage must share with an earlier one to go: passages of 50 words have about 285 bytes at least.
PASSAGE = 250

_running = threading.local()


def _stage(operator):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before := getattr(_running, "before", None):
            shared.release(*before)
        start = shared.mark()
        out = operator(docs)
        _running.before = start, shared.mark()
        return out

    stage.__doc__ = operator.__doc__
    return stage


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def language(docs: DataFrame) -> DataFrame:
    """Documents whose language is told with trust; those without text, without letters or far from every centroid go."""
    return langid.trusted(docs, langid.fit(docs.where(langid.fold("doc_id", 4) != 2)))


@_stage
def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


@_stage
def span_dedup(docs: DataFrame) -> DataFrame:
    """Texts without the byte strings that an earlier document, or an earlier place of the same one, has too: one copy of each stays."""
    return _counted(suffixes.deduplicate(docs, window=PASSAGE, keep_first=True))


@_stage
def redaction(docs: DataFrame) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


@_stage
def packed(docs: DataFrame) -> DataFrame:
    """The documents' token pieces and their places in training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("suffix_dedup", span_dedup), ("pii", redaction), ("packing", packed)]

#: Learned models and fingerprints aren't expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = shared.shared_dir(spark, "stage")  # beyond the stage's own folders
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
