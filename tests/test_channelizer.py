import numpy as np
import pytest

from tidewake.operators import channelizer

SCHEMA = "stream string, at long, i array<double>, q array<double>"


def pieces(x, name, sizes, leave=()):
    """Rows of uneven pieces, those numbered in ``leave`` missing."""
    out, at, k = [], 0, 0
    while at < len(x):
        n = sizes[k % len(sizes)]
        if k not in leave:
            out.append((name, at, x[at : at + n].real.tolist(), x[at : at + n].imag.tolist()))
        at, k = at + n, k + 1
    return out


def signal(n, seed):
    r = np.random.default_rng(seed)
    return r.standard_normal(n) + 1j * r.standard_normal(n)


def whole(x, rate, offset, stages):
    x = x * np.exp(-2j * np.pi * offset * np.arange(len(x)) / rate)
    for taps, cutoff, by in stages:
        x = np.convolve(x, channelizer.low_pass(taps, cutoff, rate))[: len(x)][by - 1 :: by]
        rate /= by
    return x


@pytest.mark.parametrize("block", [25, 250, 5_000])
def test_blocks_equal_one_long_convolution(spark, block):
    stages = [(63, 120_000, 5), (511, 9_000, 5)]
    streams = {"a": signal(9_999, 1), "b": signal(130, 2)}
    rows = [p for name, x in streams.items() for p in pieces(x, name, [7, 64, 333])] + [("c", 0, [], [])]
    got = channelizer.channelize(spark.createDataFrame(rows, SCHEMA), 2_400_000, -37_500, stages, block).collect()
    for name, x in streams.items():
        out = {}
        for r in got:
            if r.stream == name:
                out |= {r.at + k: complex(*z) for k, z in enumerate(zip(r.i, r.q, strict=True))}
        want = whole(x, 2_400_000, -37_500, stages)
        assert sorted(out) == list(range(len(want)))
        assert np.allclose([out[k] for k in sorted(out)], want, atol=1e-12)
    assert {r.stream for r in got} == {"a", "b"}


def test_missing_samples_are_zeros_and_late_phases_exact(spark):
    x = signal(2_000, 3)
    rows = pieces(x, "a", [100], leave={4, 5, 19})
    heard = x.copy()
    heard[400:600] = heard[1900:] = 0
    stages = [(9, 100_000, 5)]
    got = channelizer.channelize(spark.createDataFrame(rows, SCHEMA), 2_400_000, 25_000, stages, 150).collect()
    out = {r.at + k: complex(*z) for r in got for k, z in enumerate(zip(r.i, r.q, strict=True))}
    want = whole(heard, 2_400_000, 25_000, stages)
    assert sorted(out) == [k for k in range(380) if not 80 <= k < 120]
    assert np.allclose([out[k] for k in sorted(out)], [want[k] for k in sorted(out)], atol=1e-12)
    far = 96 * 10**13  # whole periods later, nothing changes
    moved = [(s, at + far, i, q) for s, at, i, q in pieces(x, "a", [100])]
    late = {r.at - far: (r.i, r.q) for r in channelizer.channelize(spark.createDataFrame(moved, SCHEMA), 2_400_000, 25_000, [], 100).collect()}
    soon = {r.at: (r.i, r.q) for r in channelizer.channelize(spark.createDataFrame(pieces(x, "a", [100]), SCHEMA), 2_400_000, 25_000, [], 100).collect()}
    assert far % 100 == 0 and late == soon


def test_a_tone_rises_in_its_channel_only(spark):
    rate, n = 2_400_000, np.arange(40_000)
    x = np.exp(2j * np.pi * 300_000 * n / rate) + 0.01 * signal(40_000, 4)
    rows = pieces(x, "a", [1000], leave={25})
    got = {(r.frame, r.offset_hz): r.excess for r in channelizer.framed_spectrum(spark.createDataFrame(rows, SCHEMA), rate, [300_000, 0, -300_000], 8_192).collect()}
    assert {f for f, _ in got} == {0, 1, 2, 4} - ({4} if 4 * 8_192 + 4_096 > 40_000 else set())  # the fourth frame misses samples
    assert all(e > 100 if f == 300_000 else 0 <= e < 5 for (_, f), e in got.items())


def test_the_middle_of_the_band_leaves_three_bins_out():
    power = np.ones(4096)
    power[[4095, 0, 1]] = 1e9
    assert channelizer.channel_ratio(power, 0) == 1
    assert channelizer.channel_ratio(power, 5) > 1e7
    assert channelizer.channel_ratio(np.zeros(4096), 0) is None
