"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else is unlabelled web text. A linear model over
binned text features minimises the non-negative unbiased risk
``pi * E_p[loss(+)] + max(0, E_u[loss(-)] - pi * E_p[loss(-)])``: the share of negatives in the
unlabelled text is what remains after taking out the positives' part by the class prior ``pi``, and
while that rest is negative (overfitting), the step goes the other way. At last the scores are shifted so
that the threshold stands where the prior puts it: the share of unlabelled text below is that of the
negatives, but at most one trusted positive in a hundred.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.langid import fold
from tidewake.llm.shared import column, materialize, smallest

#: Bounds of the sample that the model is fitted on: documents of each kind, those of the smallest hashes.
POSITIVES, UNLABELLED = 20_000, 20_000
BINS = 12
THRESHOLD = 0.3
# 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, 6 bar, 7 exclamation or question mark, 8 full stop or comma, 9 other sign, 10 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 9
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[10] = 1, 2, 3, 4, 5
_CLASS[ord("|")], _CLASS[[33, 63]], _CLASS[[44, 46]], _CLASS[128:] = 6, 7, 8, 10
N_FEATURES = 18


def text_features(text: str) -> np.ndarray:
    """Shares of character classes, repetition of words and lines, lengths. Of an empty text: zeros."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
    out[:11] = np.bincount(_CLASS[raw], minlength=11) / max(1, len(raw))
    words, lines = text.split(), text.splitlines()
    n = max(1, len(words))
    out[11] = len(set(words)) / n
    out[12] = sum(map(eq, words, words[1:])) / n
    out[13] = len(raw) / n
    out[14] = len(set(lines)) / max(1, len(lines))
    out[15] = np.log1p(len(words))
    out[16] = len(words) / max(1, len(lines))
    out[17] = len(set(words)) / n**0.75
    return out


@dataclass
class Model:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Columns of the one-hot coding: for each row, one per feature."""
    return np.stack([np.searchsorted(edges[j], x[:, j], "right") + j * BINS for j in range(x.shape[1])], 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descent(w: np.ndarray, bp: np.ndarray, bu: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The negative part of the risk, and where to go down from: the whole risk's gradient, or, where that part is below zero, its own, turned round.

    ``bp`` and ``bu`` are the one-hot columns of positives and unlabelled rows; the last of ``w`` is the bias.
    """

    def back(b, g):
        return np.r_[np.bincount(b.ravel(), np.repeat(g, b.shape[1]), minlength=len(w) - 1), g.sum()]

    sp, su = _sigmoid(w[bp].sum(1) + w[-1]), _sigmoid(w[bu].sum(1) + w[-1])
    risk = np.logaddexp(0, np.log(su + 1e-12) - np.log1p(-su + 1e-12)).mean() - prior * np.logaddexp(0, np.log(sp + 1e-12) - np.log1p(-sp + 1e-12)).mean()
    minus = back(bu, su / len(su)) - prior * back(bp, sp / len(sp))
    return float(risk), -minus if risk < 0 else prior * back(bp, (sp - 1) / len(sp)) + minus


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch Adam; deterministic."""
    both = np.concatenate([p, u])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    bp, bu = _binned(p, edges), _binned(u, edges)
    w, m, v = (np.zeros(p.shape[1] * BINS + 1) for _ in range(3))
    for t in range(1, steps + 1):
        _, g = descent(w, bp, bu, prior)
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cut = min(np.quantile(w[bu].sum(1), 1 - prior), np.quantile(w[bp].sum(1), 0.01))
    return Model(edges, w[:-1].reshape(-1, BINS), float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut), prior)


def score_rows(x: np.ndarray, model: Model) -> np.ndarray:
    return _sigmoid(model.weights.ravel()[_binned(x, model.edges)].sum(1) + model.bias)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, features (packed floats): one row per row of ``docs``; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_features(t.as_py() or "").tobytes() for t in batch.column(1)], pa.binary())], ["doc_id", "features"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id long, features binary")


def learn(feats: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id, quality. Those of repeated ids agree or the higher one holds; null ones are left out.

    The class prior is the labelled rows' share of ones. Without positives or unlabelled rows, every score is the prior.
    """
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = told.agg(F.avg("quality")).first()[0]
    prior = 0.5 if prior is None else min(0.99, max(0.01, float(prior)))
    pick = lambda df, bound, seed: [np.frombuffer(r.features, np.float32) for r in smallest(df, bound, F.col("doc_id"), F.lit(f"seed {seed}"), F.col("features")).select("features").collect()]
    p = pick(feats.join(told.where("quality = 1"), "doc_id", "left_semi"), POSITIVES, 1)
    u = pick(feats, UNLABELLED, 2)
    if not p or not u:
        return Model(np.zeros((N_FEATURES, BINS - 1)), np.zeros((N_FEATURES, BINS)), float(np.log(prior / (1 - prior))), prior)
    return fit_nnpu(np.stack(p).astype(float), np.stack(u).astype(float), prior)


def score(feats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row of ``features``, repeated ones and null ids included; equal features give equal scores, ties stay ties."""

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_rows(x.astype(float), model), pa.float64())], ["doc_id", "score"])

    return feats.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from folds 1 to 4 of 5.

    One row per row of ``docs``: repeated rows score alike, null and empty texts have the score of their features, texts are read
    whole, a null id stays null and falls into the fold of the empty text. An empty table gives no rows; without labels every score is the same. Other columns aren't looked at.
    """
    feats = materialize(features(docs), "quality")
    training = fold("doc_id", 5) != 0
    model = learn(feats.where(training), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(training))
    return score(feats, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
