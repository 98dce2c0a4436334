"""Centroid clustering of integer vectors, exact to the last unit.

Components become integers, floor(scale * x). Tasks read blocks of vectors and take all squared distances of a
block at once as |x|^2 - 2 x.c + |c|^2, the middle term as one float64 matrix product. As all terms are integers, this is exact
as long as every partial sum stays below 2^53; the largest magnitudes of a row and of the centroids bound them, and rows
for which the bound fails are computed in Python's integers instead. Per partition, the sums and counts of each cluster
go to one row, and ``treeAggregate`` adds these rows, in integers of any size. What the driver gets and sends is k centroids.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import column

WIDTH = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
BLOCK = 4096  #: vectors in a matrix product
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def _kept(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column, and their integers as float64."""
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    at = np.flatnonzero(lengths == width)
    flat = vectors.take(pa.array(at, pa.int64())).flatten()
    x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)  # a null becomes a NaN
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
        fine = np.isfinite(x).all(1)
    return at[fine], x[fine]


def _exactly(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of each row and its squared distance, in Python's integers."""
    near, far = [], []
    for row in x:
        v = [int(a) for a in row]
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        near.append(d.index(min(d)))
        far.append(min(d))
    return np.array(near, int), far


def assign(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The number of the nearest centroid (ties: the smaller) and the squared distance of each row of integers held as float64."""
    width = x.shape[1]
    top = max((abs(a) for c in centroids for a in c), default=0)
    reach = np.abs(x).max(1) if len(x) else np.zeros(0)
    # |x|^2 + 2 |x.c| + |c|^2 and all its partial sums are at most width * (max|x| + max|c|)^2
    limit = int((_EXACT / width) ** 0.5) - 1 - top
    small = reach <= limit if limit >= 0 else np.zeros(len(x), bool)
    if small.all():
        c = np.array(centroids, np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        near = d.argmin(1)
        return near, d[np.arange(len(x)), near].astype(np.int64).tolist()
    near, far = np.zeros(len(x), int), [0] * len(x)
    for rows, way in ((np.flatnonzero(small), assign), (np.flatnonzero(~small), _exactly)):
        if len(rows):
            n, f = way(x[rows], centroids)
            near[rows] = n
            for i, d in zip(rows.tolist(), f, strict=True):
                far[i] = d
    return near, far


def _sums(x: np.ndarray, near: np.ndarray, k: int) -> list[list[int]]:
    """The sum of each cluster's rows, in Python's integers."""
    if len(x) * float(np.abs(x).max(initial=0)) < _EXACT:
        member = np.zeros((k, len(x)))
        member[near, np.arange(len(x))] = 1
        return [[int(a) for a in row] for row in member @ x]
    out = [[0] * x.shape[1] for _ in range(k)]
    for row, j in zip(x, near.tolist(), strict=True):
        out[j] = [a + int(b) for a, b in zip(out[j], row, strict=True)]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int, vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each block of rows with the places of its usable vectors and their integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rows, x = _kept(part.column(part.schema.get_field_index(vector)), width, scale)
            if len(rows):
                yield part, rows, x


def _added(a: dict, b: dict) -> dict:
    """Sums, counts and distances of clusters, added."""
    for j, (s, n, d) in b.items():
        t, m, e = a.get(j, (None, 0, 0))
        a[j] = ([p + q for p, q in zip(s, t, strict=True)] if t else s, n + m, d + e)
    return a


def _gathered(vectors: DataFrame, centroids: list[list[int]], width: int, scale: int) -> dict[int, tuple[list[int], int, int]]:
    """Of each cluster: its vectors' sum, their number and the sum of their distances."""
    k = len(centroids)

    def run(batches):
        held: dict = {}
        for _, _, x in _blocks(batches, width, scale, "v"):
            near, far = assign(x, centroids)
            total = [0] * k
            for j, d in zip(near.tolist(), far, strict=True):
                total[j] += d
            count = np.bincount(near, minlength=k).tolist()
            _added(held, {j: (s, count[j], total[j]) for j, s in enumerate(_sums(x, near, k)) if count[j]})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["held"])

    parts = vectors.select("v").mapInArrow(run, "held binary").rdd
    return parts.treeAggregate({}, lambda a, r: _added(a, pickle.loads(bytes(r.held))), _added)


def first_centroids(vectors: DataFrame, k: int, width: int, scale: int) -> list[list[int]]:
    """The k usable vectors whose ids have the smallest hashes, in the order of these; ties by components. Each task names k at most."""

    def run(batches):
        best: list = []
        for part, rows, x in _blocks(batches, width, scale, "v"):
            ids = part.column(part.schema.get_field_index("id")).take(pa.array(rows, pa.int64())).to_pylist()
            hashes = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i in ids]
            last = sorted(hashes)[:k][-1]  # of equal hashes, components decide which come first
            best = sorted(best + [(h, x[row].tolist()) for row, h in enumerate(hashes) if h <= last])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.float64()))], ["h", "v"])

    found = vectors.mapInArrow(run, "h string, v array<double>").orderBy("h", "v").limit(k).collect()  # k rows
    return [[int(a) for a in r.v] for r in found]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    A vector takes part if it has exactly ``width`` components, none of them null, and all of them finite as doubles
    once multiplied by ``scale``; others have no row. Repeated rows and equal ids each take part and each have their row. A null id is kept and
    counts as an empty one where the first centroids are chosen; of equal ids the smaller components come first. With fewer
    than ``k`` usable vectors there are as many clusters as vectors; an empty table gives an empty result. Ties go to the smaller number.
    Other columns are not read, whatever their names. Sums and distances are exact at any size; a distance or inertia that
    a long can't hold is null.
    """
    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).alias("v"))
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, k, width, scale)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], out)
    for _ in range(rounds):
        for j, (s, n, _) in _gathered(rows, centroids, width, scale).items():
            centroids[j] = [a // n for a in s]
    sums = {j: d for j, (_, _, d) in _gathered(rows, centroids, width, scale).items()}
    signs = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda d: d if d <= _LONG else None
    own, whole = [fits(sums.get(j, 0)) for j in range(len(centroids))], fits(sum(sums.values()))

    def run(batches):
        for part, places, x in _blocks(batches, width, scale, "v"):
            near, far = assign(x, centroids)
            ids = part.column(part.schema.get_field_index("id")).take(pa.array(places, pa.int64()))
            columns = [ids, pa.array(near, pa.int32()), pa.array([fits(d) for d in far], pa.int64()), pa.array([own[j] for j in near.tolist()], pa.int64()), pa.array([whole] * len(near), pa.int64()), pa.array([signs[j] for j in near.tolist()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(run, out)
