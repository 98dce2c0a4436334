import numpy as np

from tidewake.llm import neighbours


def brute(rows, k=10):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in rows if j != i and len(w) == len(v))[:k]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = neighbours.nearest(df).collect()
    assert len(got) == 10 * len(want)
    hits = sum(r.vec_id in {j for _, j in want[r.query_id]} for r in got)
    assert hits / len(got) >= 0.9


def test_sampled_forest_and_small_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((3000, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    got = neighbours.nearest(df, sample=500, block=20, asked_block=7).collect()
    assert sum(x.vec_id in {j for _, j in want[x.query_id]} for x in got) / len(got) >= 0.9


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [1.0, -0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [0.0, 2.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (600, [9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == {q: v for q, v in brute(rows).items() if v}
    assert neighbours.nearest(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(1000)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(many).where("query_id = 500").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == list(range(10))


def test_recall_beyond_the_sample(spark):
    """Ten clouds in 64 dimensions with the data's means and covariances, several times as many as the forest is fitted on."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    r, x = np.random.default_rng(4), np.stack(df["embedding"]).astype(float)
    clouds = [x[df["label"] == label] for label in sorted(set(df["label"]))]
    v = np.concatenate([r.multivariate_normal(c.mean(0), np.cov(c.T), 1200, method="svd") for c in clouds])
    v /= np.linalg.norm(v, axis=1)[:, None]
    r.shuffle(v)
    many = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(many, sample=4000).collect()
    assert len(got) == 10 * 120
    want = {}
    for i in range(0, len(v), 100):
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        want[i] = set(np.argsort(d)[:10].tolist())
    assert sum(row.vec_id in want[row.query_id] for row in got) / len(got) >= 0.9


def test_leaves_against_all_their_rows():
    """The nearest out of the walked leaves are exact, ties and copies of the bound included."""
    r = np.random.default_rng(6)
    x = r.integers(0, 3, (400, 4)).astype(float)
    leaf, q = r.integers(0, 12, 400), x[:30] + 0.0
    pairs = [(i, int(t)) for i in range(30) for t in r.choice(12, 4, replace=False)]
    a, b, d = neighbours._nearest_in_leaves(q, x, tuple(np.array(c) for c in zip(*pairs, strict=True)), leaf, 5)
    for i in range(30):
        mine = [t for w, t in pairs if w == i]
        rows = np.flatnonzero(np.isin(leaf, mine))
        want = np.sort(np.sqrt(((x[rows] - q[i]) ** 2).sum(1)))[:5]
        assert set(b[a == i].tolist()) <= set(rows.tolist())
        assert np.sort(d[a == i])[:5].tolist() == want.tolist()
        last = want[-1]
        assert set(rows[np.sqrt(((x[rows] - q[i]) ** 2).sum(1)) <= last].tolist()) <= set(b[a == i].tolist())
    big = np.array([[1e200, 0.0], [0.0, 1e200], [1.0, 1.0]])
    a, b, d = neighbours._nearest_in_leaves(big, big, (np.arange(3), np.zeros(3, int)), np.zeros(3, int), 1)
    assert {(0, 0), (1, 1), (2, 2)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_bundles_are_bounded():
    rows, asked = np.array([5, 5, 90, 5, 5, 5]), np.array([1, 1, 1, 400, 1, 1])
    of, chunks, parts = neighbours.bundles(rows, asked, np.array([0, 4]), 20, 10)
    assert of.tolist() == [0, 0, 1, 2, 3, 3] and chunks.tolist() == [1, 5, 1, 1] and parts.tolist() == [1, 1, 10, 1]


def test_walks_are_the_nearest_leaves_first():
    r = np.random.default_rng(7)
    x = r.standard_normal((900, 6))
    forest = [neighbours.fit_tree(x, seed, 20) for seed in range(3)]
    walker = neighbours.Walker(forest)
    homes = [b + leaf for t, b in zip(forest, walker.base, strict=False) for leaf in [neighbours.leaf_of(t, x[:5])]]
    for i, walk in enumerate(walker.walks(x[:5], 10**9)):
        assert sorted(walk) == list(range(int(walker.base[-1])))
        assert set(walk[:3]) == {int(h[i]) for h in homes}


def test_walks_read_a_small_share_of_few_dimensions():
    """Vectors that lie near twelve dimensions: recall is held with less than a fifth of the rows met."""
    r = np.random.default_rng(8)
    x = r.standard_normal((20_000, 12)) @ r.standard_normal((12, 64)) + 0.1 * r.standard_normal((20_000, 64))
    forest = [neighbours.fit_tree(x[:16_384], seed) for seed in range(neighbours.TREES)]
    near = {i: np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[1:11] for i in range(0, 20_000, 200)}
    ids = list(near)
    search = neighbours.search_for(forest, [x[i] for i in ids[::2]], [x[near[i]] for i in ids[::2]], 64)
    walker = neighbours.Walker(forest)
    homes = np.stack([neighbours.leaf_of(t, x) + b for t, b in zip(forest, walker.base, strict=False)])
    met = [np.isin(homes, walk).any(0) for walk in walker.walks(x[ids[1::2]], search)]
    assert np.mean([m.mean() for m in met]) < 0.2
    assert np.mean([m[near[i]].mean() for m, i in zip(met, ids[1::2], strict=True)]) >= 0.9
