"""NumPy kernels for Arrow batches: elastic distances, wavelets, spectra, peaks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def dtw(x: np.ndarray, y: np.ndarray, allowed: np.ndarray | None = None, square: bool = False) -> np.ndarray:
    """Absolute- (or squared-) difference DTW of row k of ``x`` with row k of ``y``, all rows at once.

    The cost table is swept by anti-diagonals, and a diagonal overwrites the last but one, so two
    tables are touched.  ``allowed`` is an (n, m) mask of usable cells.
    """
    rows, n = x.shape
    m = y.shape[1]
    # positions first, so that a diagonal is a contiguous slice of each table
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T[::-1])
    # cell i of a diagonal takes the place of cell i - 1 of the last but one: a table's start moves down, what lies outside stays infinite
    at_before = at_last = (n + m) // 2 + 1
    before, last = (np.full((n + at_last, rows), np.inf) for _ in range(2))
    before[at_before - 1] = 0.0
    costs = np.empty((min(n, m), rows))
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d) + 1
        cost = np.subtract(xt[lo:hi], yt[m - 1 - d + lo : m - 1 - d + hi], out=costs[: hi - lo])
        if square:
            cost *= cost
        else:
            np.abs(cost, out=cost)
        if allowed is not None:
            i = np.arange(lo, hi)
            cost[~allowed[i, d - i]] = np.inf
        cells = before[at_before + lo - 1 : at_before + hi - 1]
        np.minimum(cells, last[at_last + lo - 1 : at_last + hi - 1], out=cells)
        np.minimum(cells, last[at_last + lo : at_last + hi], out=cells)
        cells += cost
        before, last, at_before, at_last = last, before, at_last, at_before - 1
    return last[at_last + n - 1].copy()


def dtw_paths(x: np.ndarray, y: np.ndarray, allowed: np.ndarray | None = None):
    """(distances, paths) of row k of ``x`` with row k of ``y``, all rows at once; an end that cannot be reached has no path.

    The sweep of ``dtw`` also keeps where each cell came from, one byte a cell (ties: up, left, diagonal), and all rows are traced back together.
    ``allowed`` is a mask (n, m) of usable cells, or (n, m, rows) with one for each row.
    """
    rows, n = x.shape
    m = y.shape[1]
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T[::-1])
    before, last, now = (np.full((n + 1, rows), np.inf) for _ in range(3))
    before[0] = 0.0
    move = np.empty((n, m, rows), np.uint8)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d) + 1
        i = np.arange(lo, hi)
        cost = np.abs(xt[lo:hi] - yt[m - 1 - d + lo : m - 1 - d + hi])
        if allowed is not None:
            cost[~allowed[i, d - i]] = np.inf
        up, left, back = last[lo:hi], last[lo + 1 : hi + 1], before[lo:hi]
        side = np.minimum(left, back)
        move[i, d - i] = np.where(up <= side, 0, np.where(left <= back, 1, 2))
        best = cost + np.minimum(up, side)
        now[:] = np.inf
        now[lo + 1 : hi + 1] = best
        before, last, now = last, now, before
    distance = last[n].copy()
    i, j, k = np.full(rows, n - 1), np.full(rows, m - 1), np.arange(rows)
    steps, live = [(i.copy(), j.copy())], np.isfinite(distance) & ((i > 0) | (j > 0))
    size = np.where(np.isfinite(distance), 1, 0)
    while live.any():
        way = move[i, j, k]
        i = np.where(live & (way != 1), i - 1, i)
        j = np.where(live & (way != 0), j - 1, j)
        size += live
        steps.append((i.copy(), j.copy()))
        live &= (i > 0) | (j > 0)
    path = np.stack([np.stack(s, axis=1) for s in steps])
    return distance, [path[:c, r][::-1] for r, c in enumerate(size.tolist())]


def dtw_table(x: np.ndarray, y: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Accumulated cost table of one pair."""
    cost = np.abs(x[:, None] - y[None, :])
    if allowed is not None:
        cost = np.where(allowed, cost, np.inf)
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0.0
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            t[i, j] = cost[i - 1, j - 1] + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return t[1:, 1:]


def warping_path(table: np.ndarray) -> list:
    """Cheapest path back from the corner; ties prefer up, then left, then diagonal."""
    i, j = table.shape[0] - 1, table.shape[1] - 1
    steps = [(i, j)]
    while i or j:
        options = [(i - 1, j), (i, j - 1), (i - 1, j - 1)]
        options = [(a, b) for a, b in options if a >= 0 and b >= 0]
        i, j = min(options, key=lambda c: table[c])
        steps.append((i, j))
    return steps[::-1]


def band(n: int, m: int, width: int) -> np.ndarray:
    """Cells within ``width`` of the unscaled diagonal."""
    return np.abs(np.arange(n)[:, None] - np.arange(m)[None, :]) <= width


def parallelogram(n: int, m: int, slope: float = 2.0) -> np.ndarray:
    """Itakura-style slope limits."""
    i, j = np.arange(n)[:, None], np.arange(m)[None, :]
    low = np.maximum(np.floor(i / slope), i - (n - m))
    high = np.minimum(np.minimum(m - 1, np.floor(i * slope)), i + (m - n))
    return (j >= low) & (j <= high)


def fast_dtw(x: np.ndarray, y: np.ndarray, radius: int = 1):
    """Multi-resolution DTW: solve the halved pair, then refine near its path."""
    if min(len(x), len(y)) <= radius + 2:
        t = dtw_table(x, y)
        return t[-1, -1], warping_path(t)
    half = lambda a: (a[: len(a) // 2 * 2 : 2] + a[1::2]) / 2
    _, coarse = fast_dtw(half(x), half(y), radius)
    near = np.zeros((len(x), len(y)), dtype=bool)
    for i, j in coarse:
        near[max(0, 2 * i - radius) : 2 * i + radius + 1, max(0, 2 * j - radius) : 2 * j + radius + 1] = True
    # an odd length leaves its last cell outside the doubled path; join it to keep the corner reachable
    near[2 * coarse[-1][0] :, 2 * coarse[-1][1] :] = True
    t = dtw_table(x, y, near)
    return t[-1, -1], warping_path(t)


def fast_paths(x: np.ndarray, y: np.ndarray, radius: int = 1):
    """``fast_dtw`` of row k of ``x`` with row k of ``y``, all rows at once: every pair has its own mask of cells near its coarse path."""
    rows, n = x.shape
    m = y.shape[1]
    if min(n, m) <= radius + 2:
        return dtw_paths(x, y)
    half = lambda a: (a[:, : a.shape[1] // 2 * 2 : 2] + a[:, 1::2]) / 2
    _, coarse = fast_paths(half(x), half(y), radius)
    at = 2 * np.concatenate(coarse)
    row = np.repeat(np.arange(rows), [len(p) for p in coarse])
    near = np.zeros((n, m, rows), dtype=bool)
    for di in range(-radius, radius + 1):
        for dj in range(-radius, radius + 1):
            i, j = at[:, 0] + di, at[:, 1] + dj
            own = (i >= 0) & (j >= 0) & (i < n) & (j < m)
            near[i[own], j[own], row[own]] = True
    near[2 * (n // 2 - 1) :, 2 * (m // 2 - 1) :] = True
    return dtw_paths(x, y, near)


def morlet(scale: float) -> np.ndarray:
    """Real Morlet wavelet exp(-t^2/2) cos(5t) sampled on [-8, 8] at one scale."""
    t = np.arange(-math.ceil(8 * scale), math.ceil(8 * scale) + 1) / scale
    return np.exp(-t * t / 2) * np.cos(5 * t) / math.sqrt(scale)


def daubechies(moments: int) -> np.ndarray:
    """Orthonormal low-pass filter with the given vanishing moments (spectral factorisation)."""
    y = np.zeros(moments)
    for k in range(moments):
        y[k] = math.comb(moments - 1 + k, k)
    poly = np.poly1d([1.0])
    for r in np.roots(y[::-1]):
        # y = (2 - z - 1/z) / 4 gives the two reciprocal roots; keep the one inside the circle
        b = 1 - 2 * r
        z = b + np.sqrt(b * b - 1 + 0j)
        z = z if abs(z) < 1 else 1 / z
        poly = poly * np.poly1d([1.0, -z])
    for _ in range(moments):
        poly = poly * np.poly1d([1.0, 1.0])
    taps = np.real(poly.coeffs)
    return taps * math.sqrt(2) / taps.sum()


@lru_cache(maxsize=None)
def filters(moments: int):
    """(low, high) analysis filters; synthesis uses the reversed ones."""
    rec = daubechies(moments)
    low = rec[::-1]
    high = rec * np.where(np.arange(len(rec)) % 2 == 0, -1.0, 1.0)
    return low, high


def _slide(x: np.ndarray, taps: np.ndarray, before: int, mode: str) -> np.ndarray:
    """Convolution of the rows of ``x``, padded by ``before`` on both sides, where the taps fit."""
    ext = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(before, before)], mode=mode)
    return np.lib.stride_tricks.sliding_window_view(ext, len(taps), axis=-1) @ taps[::-1]


def dwt_step(x: np.ndarray, moments: int):
    """One level for a series or for every row of a matrix."""
    low, high = filters(moments)
    return tuple(_slide(x, f, len(f) - 1, "symmetric")[..., 1::2] for f in (low, high))


def idwt_step(approx: np.ndarray, detail: np.ndarray, moments: int) -> np.ndarray:
    n, w = detail.shape[-1], 2 * moments

    def up(c, f):
        wide = np.zeros((*c.shape[:-1], 2 * n - 1))
        wide[..., ::2] = c[..., :n]
        return _slide(wide, f[::-1], w - 1, "constant")

    low, high = filters(moments)
    return (up(approx, low) + up(detail, high))[..., w - 2 : w - 2 + 2 * n - w + 2]


def wavedec(x: np.ndarray, moments: int = 4, level: int | None = None) -> list:
    """[approximation, coarsest detail, ..., finest detail]."""
    top = int(np.log2(max(np.shape(x)[-1] / (2 * moments - 1), 1)))
    out, a = [], np.asarray(x, float)
    for _ in range(top if level is None else level):
        a, d = dwt_step(a, moments)
        out.append(d)
    return [a, *out[::-1]]


def waverec(coeffs: list, moments: int = 4) -> np.ndarray:
    a = coeffs[0]
    for d in coeffs[1:]:
        a = idwt_step(a, d, moments)
    return a


def denoise(x: np.ndarray, moments: int = 4, level: int | None = None, hard: bool = False) -> np.ndarray:
    """Universal-threshold shrinkage of the detail coefficients, of a series or of every row of a matrix."""
    c = wavedec(x, moments, level)
    if len(c) == 1:
        return np.asarray(x, float)
    size = np.shape(x)[-1]
    t = np.median(np.abs(c[-1]), axis=-1, keepdims=True) / 0.6745 * math.sqrt(2 * math.log(size))
    cut = (lambda d: np.where(np.abs(d) > t, d, 0.0)) if hard else (lambda d: np.sign(d) * np.maximum(np.abs(d) - t, 0.0))
    return waverec([c[0], *[cut(d) for d in c[1:]]], moments)[..., :size]


def spectrum(v: np.ndarray) -> dict:
    """FFT summary of every row of ``v``."""
    n = v.shape[1]
    f = np.fft.fft(v, axis=1)
    power, freq = np.abs(f) ** 2, np.fft.fftfreq(n)
    rows = np.arange(len(v))
    k = np.argmax(power[:, 1 : n // 2], axis=1) + 1
    mag, fr = np.abs(f[:, : n // 2]), freq[: n // 2]
    total = np.maximum(mag.sum(axis=1), 1e-300)
    centre = mag @ fr / total
    width = np.sqrt(((fr - centre[:, None]) ** 2 * mag).sum(axis=1) / total)
    high = (mag[:, fr > 0.5 * fr.max()] ** 2).sum(axis=1)
    return {"dominant_frequency": freq[k], "dominant_power": power[rows, k], "total_power": power.sum(axis=1), "power_std": power.std(axis=1), "centroid": centre, "bandwidth": width,
            "high_ratio": high / np.maximum((mag**2).sum(axis=1), 1e-300)}


def peaks(x: np.ndarray, distance: int = 1) -> np.ndarray:
    """Plateau-aware local maxima; nearer than ``distance`` the higher one is kept."""
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    p = np.array(out, dtype=int)
    if distance <= 1 or not len(p):
        return p
    keep = np.ones(len(p), dtype=bool)
    for k in np.argsort(x[p])[::-1]:
        if keep[k]:
            close = np.abs(p - p[k]) < distance
            close[k] = False
            keep[close] = False
    return p[keep]


def nearest_windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z-normalised Euclidean distance of every row of ``a`` to every row of ``b``."""
    def z(v):
        s = v.std(axis=1, keepdims=True)
        return np.where(s > 1e-12, (v - v.mean(axis=1, keepdims=True)) / np.where(s > 1e-12, s, 1.0), 0.0)

    m = a.shape[1]
    za, zb = z(a), z(b)
    sq = (za**2).sum(1)[:, None] + (zb**2).sum(1)[None, :] - 2 * za @ zb.T
    return np.sqrt(np.maximum(sq, 0.0))
