import numpy as np

from tidewake.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.held_out_scores(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    good = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert len(rows) > 40 and good > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 3), (1, "a b c", 3), (2, None, 3), (None, "", 3), (4, "x " * 60_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (4, 0), (4, 0)], "doc_id long, quality int")
    rows = quality.held_out_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.held_out_scores(docs.limit(0), labels).count() == 0
    assert quality.held_out_scores(docs, labels.limit(0)).count() == 5


def softplus(z):
    return float(np.log1p(np.exp(z)))


def parts_of_risk(w, bp, bu, prior):
    """(positive, negative) part of the risk, row by row."""
    z = lambda row: sum(w[c] for c in row) + w[-1]
    positive = prior * sum(softplus(-z(r)) for r in bp) / len(bp)
    return positive, sum(softplus(z(r)) for r in bu) / len(bu) - prior * sum(softplus(z(r)) for r in bp) / len(bp)


def test_risk_and_both_branches_against_differences():
    r = np.random.default_rng(3)
    bp, bu = (np.stack([r.integers(0, 4, n), 4 + r.integers(0, 4, n)], 1) for n in (12, 30))
    seen = set()
    for scale, prior in ((0.5, 0.3), (0.5, 0.6), (3.0, 0.95), (3.0, 0.9)):
        for _ in range(10):
            w = r.standard_normal(9) * scale
            w[bp.ravel()] += scale / 4
            risk, g = quality.descent(w, bp, bu, prior)
            positive, negative = parts_of_risk(w, bp, bu, prior)
            assert abs(risk - negative) < 1e-6
            seen.add(negative < 0)
            goal = lambda v: -parts_of_risk(v, bp, bu, prior)[1] if negative < 0 else sum(parts_of_risk(v, bp, bu, prior))  # noqa: B023, E731
            for k in range(9):
                step = np.eye(9)[k] * 1e-5
                assert abs((goal(w + step) - goal(w - step)) / 2e-5 - g[k]) < 1e-5
    assert seen == {True, False}


def test_fit_separates_a_mixture():
    """Positives around 1, the mixture's other seven tenths around -1: nearly all of both are told apart without a negative label."""
    r = np.random.default_rng(4)
    p = r.normal(1, 0.5, (400, 3))
    u = np.concatenate([r.normal(1, 0.5, (300, 3)), r.normal(-1, 0.5, (700, 3))])
    scores = quality.score_rows(u, quality.fit_nnpu(p, u, 0.3))
    assert (scores[:300] >= quality.THRESHOLD).mean() > 0.95 and (scores[300:] < quality.THRESHOLD).mean() > 0.95
