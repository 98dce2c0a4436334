import numpy as np
import pytest

from tidewake.operators import alignment


def by_hand(x, y, size, hop, most):
    size = min(size, len(x))
    start = max(range(0, max(1, len(x) - size + 1), hop), key=lambda s: (round(float(x[s : s + size] @ x[s : s + size]), 9), -s))

    def score(lag):
        a, b = max(start, -lag), min(start + size, len(y) - lag)
        if b <= a:
            return -1.0
        u, v = x[a:b], y[a + lag : b + lag]
        return round(float(u @ v) / max(float(u @ u) * float(v @ v), 1e-30) ** 0.5, 9)

    best = max(range(-most, most + 1), key=lambda lag: (score(lag), -lag))
    return best, score(best)


@pytest.mark.parametrize("n, m, size, most", [(400, 400, 100, 60), (90, 300, 200, 350), (300, 40, 64, 500), (1, 1, 8, 3)])
def test_best_lag_equals_all_lags_tried(n, m, size, most):
    r = np.random.default_rng(n)
    x, y = r.standard_normal(n), r.standard_normal(m)
    got = alignment.best_lag(x, y, size, size // 2, most)
    want = by_hand(x, y, size, size // 2, most)
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-8


def test_a_delay_of_thousands_of_samples_and_empty_clips(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal(40_000) * np.repeat([1, 1, 3, 1, 1], 8_000)
    y = np.concatenate([np.zeros(3_111), x])[:40_000] + 0.1 * r.standard_normal(40_000)
    rows = [("a", x.tolist(), y.tolist()), ("b", [], [1.0]), (None, [1.0], None), ("z", [0.0] * 9, [0.0] * 9)]
    df = spark.createDataFrame(rows, "key string, x array<double>, y array<double>")
    got = {k: (lag, score) for k, lag, score in map(tuple, alignment.align(df, "key").collect())}
    assert got["a"][0] == 3_111 and got["a"][1] > 0.99
    assert got["b"] == got[None] == (None, None) and got["z"][1] == 0
