"""Windows of a sequence, gathered into runs by the anchors that their own contents choose.

The anchor of a window is, of the k-grams in it, the one with the smallest hash (the leftmost of equal
ones). Equal windows choose equal anchors at the same place, so windows need only be compared with
those of the same anchor; neighbouring windows mostly share theirs and make up one run.
"""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
#: Longer sequences are cut, with overlap: a run that ends at a cut is merely a shorter run.
CHUNK = 1 << 20
_PLACE = np.uint64(21)


def _power(m: int) -> np.uint64:
    return np.uint64(pow(_ODD, m, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive elements of ``x`` (unsigned 64-bit), by doubling."""
    n, h, m, done, acc = len(x), x, 1, 0, None
    while True:
        if k & 1:
            acc = h if acc is None else acc[: n - done - m + 1] * _power(m) + h[done : done + n - done - m + 1]
            done += m
        k >>= 1
        if not k:
            return mix(acc)
        h = h[:-m] * _power(m) + h[m:]
        m *= 2


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    p = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = v
    p = p.reshape(-1, w)
    ahead = np.minimum.accumulate(p, 1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(x: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of ``x``: each run's anchor hash, first window's start, anchor's place from there, number of windows."""
    parts = []
    for at in range(0, max(1, len(x) - window + 1), CHUNK):
        part = x[at : at + CHUNK + window - 1]
        if len(part) < window:
            continue
        h = window_hashes(part, k)
        low = _sliding_min((h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64), window - k + 1)
        place = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        n = np.diff(np.append(start, len(place)))
        parts.append((h[place[start]], start + at, place[start] - start, n))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of the union; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
