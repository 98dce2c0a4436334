import hashlib
import math

import pytest
from tests.compare import mismatch

from tidewake.llm import clustering, registry


def brute(rows, k=16, rounds=3, width=64, scale=64):
    """Rows (id, components), in plain integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    sign = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted((sign(i), v) for i, v in kept)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v for (_, v), g in zip(kept, of, strict=True) if g == j]) else m for j, m in enumerate(c)]
    last = [near(v) for _, v in kept]
    fits = lambda d: d if d < 2**63 else None
    total = fits(sum(d for d, _ in last))
    rows = [(i, j, fits(d), fits(sum(e for e, g in last if g == j)), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)]
    return sorted(rows, key=str)


def run(spark, rows, kind="array<float>", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(3)
    return sorted((tuple(r) for r in clustering.cluster(df, **more).collect()), key=str)


def test_equals_its_sql(spark):
    assert mismatch(spark, "/root/testdata/sf0.01", registry.op13_clustering, registry.CLUSTERING_SQL) is None


def test_odd_rows_ties_and_repeated_rows(spark):
    v = lambda *x: [*map(float, x)] + [0.0] * (64 - len(x))
    rows = [(1, v(1)), (1, v(1)), (2, v(-1)), (None, v(0.5)), (None, v(0, 3)), (3, None), (4, []), (5, [1.0] * 63), (6, [*v()[:63], None]), (7, [*v()[:63], float("nan")]), (8, [*v()[:63], float("inf")])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, k=2) == brute(rows, k=2)
    assert run(spark, []) == []
    assert run(spark, rows[5:]) == []


@pytest.mark.parametrize("size", [1.0, 3e4, 9e4, 1e6, 3e9, 1e38])
def test_magnitudes_beyond_exact_products(spark, size):
    rows = [(i, [math.sin(i * 7 + j * j) * (size if i % 5 == 0 else 1) for j in range(64)]) for i in range(60)]
    assert run(spark, rows, "array<double>", k=4) == brute(rows, k=4)


def test_extra_columns_do_not_clash(spark):
    rows = [(i, [float(i * j % 7) for j in range(64)], "x", [1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v array<double>")
    assert sorted((tuple(r) for r in clustering.cluster(df).collect()), key=str) == brute([r[:2] for r in rows])


def test_one_vector_with_most_rows(spark):
    rows = [(i, [1.5] * 64 if i % 3 else [float(i % 11)] * 64) for i in range(300)]
    assert run(spark, rows) == brute(rows)
