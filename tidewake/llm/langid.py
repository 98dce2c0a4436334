"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A first pass over the training documents estimates how many different texts each language has. A second one counts in how
many documents each hashed byte n-gram occurs (over all of them) and keeps, for each language, the texts whose hashes
lie below where the smallest ``PER_LANGUAGE`` are expected (a bounded sample, copies once), so no task orders a language's rows. The driver
clusters each language's sample into a few unit centroids. A last, narrow pass gives each document the language of the most similar centroid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewake.llm.shared import column, materialize, whole_row

BUCKETS = 4096
#: The bound of the sample that centroids are fitted on: documents of each language.
PER_LANGUAGE = 400
#: The bound of that sample over all languages: with more than 20, each gets its share of it.
SAMPLE = 8000
#: A column with more values than this isn't one of languages.
LANGUAGES = 1000
CENTROIDS = 4
#: A document is rejected if its best cosine is under this share of the lowest one of its language's sample.
REJECT_SHARE = 0.5
#: A short text's cosine is low by chance: the share is scaled by n / (n + SHORT) for a text of n bytes.
SHORT = 60
_LETTER = regex.compile(r"\p{L}")
_WORD = np.zeros(256, bool)  # letters, and whatever lies beyond ASCII
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased text's bytes; all between words is one space."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "ignore"), np.uint8)
    word = _WORD[b]
    b = np.where(word, b, 32)[word | np.append(True, word[:-1])].astype(np.uint32)
    pairs = (b[:-1] << np.uint32(8)) | b[1:]
    triples = (pairs[:-1] << np.uint32(8)) | b[2:]
    h = np.concatenate([b * np.uint32(2654435761), (pairs + np.uint32(0x1000000)) * np.uint32(2246822519), (triples + np.uint32(0x2000000)) * np.uint32(3266489917)])
    return np.bincount(h >> np.uint32(20), minlength=BUCKETS)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n > 0, n, 1)


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # of each centroid, a place in languages
    floor: np.ndarray  # of each language, the cosine below which it is rejected
    idf: np.ndarray


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """``training``: rows without text or language are left out. Without any other, the model has no language.

    Equal texts of a language count once in its sample and each in the n-grams' document counts. More than ``LANGUAGES`` languages are an error.
    """
    text = column(text_col)
    rows = training.select(column(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h")).where("lang is not null and text is not null")
    different = {r.lang: r.c for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("c")).limit(LANGUAGES + 1).collect()}
    if len(different) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    per_language = max(k, min(per_language, SAMPLE // max(1, len(different))))
    wanted = per_language + 6 * per_language**0.5 + 20
    below = {lang: int(min(1.0, wanted / max(1, c)) * 2**64) - 2**63 for lang, c in different.items()}

    def gather(batches):
        seen = np.zeros(BUCKETS, np.int64)
        n, have = 0, set()
        for batch in batches:
            kept = ([], [], [])
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = ngram_counts(text)
                seen += counts > 0
                n += 1
                if h < below[lang] and (lang, h) not in have:
                    have.add((lang, h))
                    for values, value in zip(kept, (lang, h, counts.astype("<u4").tobytes()), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(kept, schema.types, strict=True)], schema=schema)
        if n:
            yield pa.RecordBatch.from_pydict({"lang": [None], "h": [0], "counts": [np.r_[seen, n].astype("<i8").tobytes()]}, schema)

    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("counts", pa.binary())])
    gathered = materialize(rows.mapInArrow(gather, "lang string, h long, counts binary"), "langid")
    tallies = gathered.where("lang is null").mapInArrow(_add_up, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in tallies.collect():  # as many rows as buckets
        df[r.bucket] = r.n
    sample: dict[str, list[np.ndarray]] = {}
    for r in gathered.where("lang is not null").dropDuplicates(["lang", "h"]).orderBy("lang", "h").toLocalIterator():  # about SAMPLE rows at most
        if len(sample.setdefault(r.lang, [])) < per_language:
            sample[r.lang].append(np.frombuffer(r.counts, "<u4").astype(np.float32))
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    cents, owner, floor = [], [], []
    for at, lang in enumerate(sorted(sample)):
        x = _weigh(np.stack(sample[lang]), idf)
        c = _cluster(x, k)
        cents.append(c)
        owner += [at] * len(c)
        floor.append(float((x @ c.T).max(1).min()) * REJECT_SHARE)
    return Model(sorted(sample), np.concatenate(cents) if cents else np.zeros((0, BUCKETS), np.float32), np.array(owner, int), np.array(floor), idf)


def _add_up(batches):
    total = None
    for batch in batches:
        for c in batch.column(2):
            v = np.frombuffer(c.as_py(), "<i8")
            total = v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS + 1), pa.int32()), pa.array(total)], ["bucket", "n"])


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the rows farthest from each other, so it is deterministic."""
    mean = x.mean(0)
    start = [int((x @ mean).argmax())]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(1).argmin()))
    c = x[start]
    for _ in range(12):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _judge(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(lang_pred, score, rejected)"""
    if not text or not model.languages or not _LETTER.search(text):
        return "und", 0.0, True
    sims = model.centroids @ _weigh(ngram_counts(text), model.idf)
    i = int(sims.argmax())
    n = len(text.encode("utf-8", "ignore"))
    return model.languages[model.owner[i]], float(min(1, max(0, sims[i]))), bool(sims[i] < model.floor[model.owner[i]] * n / (n + SHORT))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; such columns of ``docs`` are replaced.

    lang_pred is ``und`` (score 0, rejected) if the text is null or has no letter, or if there is no
    language. Otherwise it is a learned value (ties: the one that comes first in order), score its cosine (0 to 1), and
    rejected says that even this centroid is too far away to be trusted.
    """
    drop = [c for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected")]
    kept = docs.select(*[column(c) for c in docs.columns if c not in drop])
    at = kept.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [_judge(t.as_py(), model) for t in batch.column(at)]
            more = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = StructType(kept.schema.fields[:]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return kept.mapInArrow(run, schema)


def trusted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``predict`` doesn't reject, with all their columns, whatever these are called."""
    slim = docs.select(whole_row(docs).alias("row"), column(text_col).alias("text"))
    return predict(slim, model).where("not rejected").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; learns from folds 0, 1 and 3 of 4.

    One row per row of ``docs``: repeated rows are predicted alike, null texts and texts without letters are ``und``, texts are read
    whole, a null id stays null and falls into the fold of the empty text. An empty table gives no rows. Other columns aren't looked at.
    """
    model = fit(docs.where(fold("doc_id", 4) != 2))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(slim, model).drop("text")
