"""Signal kernels on batches: arrays are (windows, time); recursions run over time for all windows at once.

There is no signal library here, so filters are designed from their analogue
prototypes. Nothing in this module knows Spark.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

EPS = 1e-12


# Filter design


@lru_cache(maxsize=256)
def butterworth(order: int, cuts: tuple[float, ...], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator; cuts are shares of the Nyquist frequency. kind: low, high, band or stop."""
    k = np.arange(order)
    poles = np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
    zeros = np.empty(0, complex)
    gain = 1.0
    w = 4 * np.tan(math.pi * np.asarray(cuts) / 2)
    if kind == "low":
        poles, gain = poles * w[0], gain * w[0] ** order
    elif kind == "high":
        zeros, gain = np.zeros(order, complex), gain * np.real(1 / np.prod(-poles))
        poles = w[0] / poles
    else:
        middle, wide = math.sqrt(w[0] * w[1]), w[1] - w[0]
        if kind == "band":
            half = poles * wide / 2
            zeros, gain = np.zeros(order, complex), gain * wide**order
        else:
            half = wide / 2 / poles
            zeros, gain = np.concatenate([np.full(order, 1j * middle), np.full(order, -1j * middle)]), gain * np.real(1 / np.prod(-poles))
        root = np.sqrt(half * half - middle * middle)
        poles = np.concatenate([half + root, half - root])
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    spare = len(poles) - len(zeros)
    zeros = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(spare)])
    poles = (4 + poles) / (4 - poles)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


@lru_cache(maxsize=64)
def notch(f0: float, q: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch of quality q at -3 dB."""
    w0 = 2 * math.pi * f0 / fs
    gain = 1 / (1 + math.tan(w0 / q / 2))
    return gain * np.array([1.0, -2 * math.cos(w0), 1.0]), np.array([1.0, -2 * gain * math.cos(w0), 2 * gain - 1])


@lru_cache(maxsize=256)
def _settled(b: tuple, a: tuple) -> np.ndarray:
    """State of the filter after a constant input of 1."""
    n = max(len(a), len(b))
    a, b = np.pad(np.array(a), (0, n - len(a))), np.pad(np.array(b), (0, n - len(b)))
    move = np.eye(n - 1) - np.vstack([-a[1:], np.eye(n - 2, n - 1)]).T
    return np.linalg.solve(move, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The filter over time, its state z (windows, order) carried along."""
    z = np.concatenate([z, np.zeros((len(x), 1))], axis=1)
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        y = b[0] * x[:, t] + z[:, 0]
        z[:, :-1] = z[:, 1:] + b[1:] * x[:, t : t + 1] - a[1:] * y[:, None]
        out[:, t] = y
    return out


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering over odd extensions; too short a signal is returned as it is."""
    n = max(len(a), len(b))
    pad = 3 * n
    if x.shape[1] <= pad or x.shape[1] < 16:
        return x.copy()
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    zi = _settled(tuple(b), tuple(a))
    y = _run(b, a, wide, zi * wide[:, :1])[:, ::-1]
    y = _run(b, a, y, zi * y[:, :1])[:, ::-1]
    return y[:, pad:-pad].copy()


def band_pass(x: np.ndarray, fs: float, low: float, high: float, order: int = 2) -> np.ndarray:
    cuts = max(2 * low / fs, 1e-6), min(2 * high / fs, 0.999)
    return both_ways(*butterworth(order, cuts, "band"), x) if cuts[0] < cuts[1] else x.copy()


def band_stop(x: np.ndarray, fs: float, low: float, high: float, order: int = 2) -> np.ndarray:
    cuts = max(2 * low / fs, 1e-6), min(2 * high / fs, 0.999)
    return both_ways(*butterworth(order, cuts, "stop"), x) if cuts[0] < cuts[1] else x.copy()


def high_pass(x: np.ndarray, fs: float, cut: float, order: int = 2) -> np.ndarray:
    return both_ways(*butterworth(order, (min(max(2 * cut / fs, 1e-6), 0.999),), "high"), x)


def notched(x: np.ndarray, fs: float, f0: float, q: float = 100.0) -> np.ndarray:
    return both_ways(*notch(f0, q, fs), x)


# Time domain


def mad(x: np.ndarray) -> np.ndarray:
    return np.median(np.abs(x - np.median(x, axis=1, keepdims=True)), axis=1)


def iqr(x: np.ndarray) -> np.ndarray:
    low, high = np.percentile(x, [25, 75], axis=1)
    return high - low


def rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).mean(axis=1))


def central(x: np.ndarray, k: int) -> np.ndarray:
    return ((x - x.mean(axis=1, keepdims=True)) ** k).mean(axis=1)


def without_bursts(x: np.ndarray, k: float = 6.0) -> np.ndarray:
    """A value far from both neighbours becomes their mean."""
    if x.shape[1] < 3:
        return x.copy()
    limit = np.maximum(k * mad(np.diff(x, axis=1)), EPS)[:, None]
    far = (np.abs(x[:, 1:-1] - x[:, :-2]) > limit) & (np.abs(x[:, 1:-1] - x[:, 2:]) > limit)
    out = x.copy()
    out[:, 1:-1] = np.where(far, (x[:, :-2] + x[:, 2:]) / 2, x[:, 1:-1])
    return out


def without_steps(x: np.ndarray, k: float = 10.0) -> np.ndarray:
    """Left to right, a value far from the one kept before it becomes that one."""
    out = x.copy()
    if x.shape[1] < 2:
        return out
    limit = np.maximum(k * mad(np.diff(x, axis=1)), EPS)
    for t in range(1, x.shape[1]):
        out[:, t] = np.where(np.abs(out[:, t] - out[:, t - 1]) > limit, out[:, t - 1], out[:, t])
    return out


def median_filter(x: np.ndarray, k: int) -> np.ndarray:
    """Centred, over zero-padded edges."""
    return np.median(sliding_window_view(np.pad(x, ((0, 0), (k // 2, k // 2))), k, axis=1), axis=2)


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    """Centred, over zero-padded edges: the ends shrink. An even width reaches further back."""
    if x.shape[1] < k or k < 2:
        return x.copy()
    sums = np.cumsum(np.pad(x, ((0, 0), (k // 2 + 1, (k - 1) // 2))), axis=1)
    return (sums[:, k:] - sums[:, :-k]) / k


def envelope(x: np.ndarray, fs: float, seconds: float = 0.25) -> np.ndarray:
    k = max(3, int(round(seconds * fs)))
    return moving_average(np.abs(x), k + 1 - k % 2)


def correlation(x: np.ndarray, y: np.ndarray, winsorise: bool = False) -> np.ndarray:
    """Over the common length; 0 below eight values or without variation."""
    n = min(x.shape[1], y.shape[1])
    if n < 8:
        return np.zeros(len(x))
    x, y = x[:, :n], y[:, :n]
    if winsorise:
        x, y = (np.clip(v, *(p[:, None] for p in np.percentile(v, [5, 95], axis=1))) for v in (x, y))
    sx, sy = x.std(axis=1), y.std(axis=1)
    flat = (sx < EPS) | (sy < EPS)
    r = ((x - x.mean(axis=1, keepdims=True)) * (y - y.mean(axis=1, keepdims=True))).mean(axis=1) / np.where(flat, 1, sx * sy)
    return np.where(flat | ~np.isfinite(r), 0.0, r)


def cross_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At all lags from 1 - n to n - 1, by transforms."""
    n = x.shape[1]
    size = 1 << (2 * n - 2).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    return np.concatenate([full[:, size - n + 1 :], full[:, :n]], axis=1)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """From lag 0, over its value there; 0 for a constant."""
    n = x.shape[1]
    r = cross_correlation(x - x.mean(axis=1, keepdims=True), x - x.mean(axis=1, keepdims=True))[:, n - 1 :]
    flat = r[:, :1] < EPS
    return np.where(flat, 0.0, r / np.where(flat, 1.0, r[:, :1] + EPS))


def largest_correlation(x: np.ndarray, y: np.ndarray, most_lag: int) -> np.ndarray:
    """Largest size of the normalised cross-correlation within a lag."""
    n = min(x.shape[1], y.shape[1])
    x, y = (v[:, :n] - v[:, :n].mean(axis=1, keepdims=True) for v in (x, y))
    scale = n * x.std(axis=1) * y.std(axis=1)
    middle = cross_correlation(x, y)[:, max(0, n - 1 - most_lag) : n + most_lag]
    return np.where((n >= 8) & (scale > EPS), np.abs(middle).max(axis=1) / np.maximum(scale, EPS), 0.0)


def peaks(x: np.ndarray) -> np.ndarray:
    """Local maxima of one signal; the middle of a plateau."""
    runs = np.flatnonzero(np.diff(x) != 0)
    starts, stops = np.concatenate([[0], runs + 1]), np.concatenate([runs, [len(x) - 1]])
    v = x[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1 if len(v) > 2 else np.empty(0, int)
    return (starts[top] + stops[top]) // 2


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height over the higher of the lowest points on either side before something taller."""
    out = np.empty(len(at))
    for i, p in enumerate(at):
        taller = np.flatnonzero(x[:p] > x[p])
        left = x[(taller[-1] + 1 if len(taller) else 0) : p + 1].min()
        taller = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : (p + 1 + taller[0] if len(taller) else len(x))].min()
        out[i] = x[p] - max(left, right)
    return out


def spaced(x: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Tallest first, peaks closer than the distance to a kept one go."""
    keep = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep[near] = False
    return at[keep]


def pulse_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Beats of one signal: a third of a second apart, and three tenths of the deviation prominent."""
    if len(x) < int(fs):
        return np.empty(0, int)
    at = spaced(x, peaks(x), max(1, int(0.33 * fs)))
    return at[prominences(x, at) >= max(0.3 * x.std(), EPS)]


# Spectra


def spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and amplitudes under a symmetric Hamming window, at least 256 points."""
    size = max(256, 1 << (x.shape[1] - 1).bit_length())
    y = (x - x.mean(axis=1, keepdims=True)) * np.hamming(x.shape[1])
    return np.fft.rfftfreq(size, 1 / fs), np.abs(np.fft.rfft(y, size))


def _segments(x: np.ndarray, size: int) -> np.ndarray:
    """Halfway overlapping, without their means, under a periodic Hann window; transformed."""
    cut = sliding_window_view(x, size, axis=1)[:, :: size // 2]
    window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / size)
    return np.fft.rfft((cut - cut.mean(axis=2, keepdims=True)) * window)


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density."""
    window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / size)
    p = (np.abs(_segments(x, size)) ** 2).mean(axis=1) / (fs * (window**2).sum())
    p[:, 1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def coherence(x: np.ndarray, y: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _segments(x, size), _segments(y, size)
    top = np.abs((a * np.conj(b)).mean(axis=1)) ** 2
    down = (np.abs(a) ** 2).mean(axis=1) * (np.abs(b) ** 2).mean(axis=1)
    return np.fft.rfftfreq(size, 1 / fs), np.where(down > 0, top / np.where(down > 0, down, 1.0), 0.0)


@lru_cache(maxsize=16)
def _resampler(n: int, up: int, down: int) -> np.ndarray:
    """Matrix of a polyphase filter: a Kaiser (5.0) windowed sinc of ten zero crossings on either side."""
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) / most * np.kaiser(2 * half + 1, 5.0)
    h = h / h.sum() * up
    size = -(-n * up // down)
    at = half + np.arange(size)[:, None] * down - np.arange(n)[None, :] * up
    return np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0.0)


def resampled(x: np.ndarray, up: int, down: int) -> np.ndarray:
    d = math.gcd(up, down)
    return x @ _resampler(x.shape[1], up // d, down // d).astype(x.dtype).T


# Entropy


def template_matches(x: np.ndarray, sizes: tuple[int, ...], r: float) -> list[float]:
    """For each size m, ordered pairs of different templates of m values that differ by r at most anywhere.

    Values are compared once; a template's match is a run along the diagonal.
    """
    n, most = len(x), max(sizes)
    totals = [0] * len(sizes)
    for i in range(0, n, 512):
        near = np.abs(x[i : i + 512 + most - 1, None] - x[None, :]) <= r
        for k, m in enumerate(sizes):
            rows = min(512, n - m - i)
            if rows > 0:
                run = near[:rows, : n - m]
                for j in range(1, m):
                    run = run & near[j : j + rows, j : j + n - m]
                totals[k] += int(np.count_nonzero(run))
    return [float(t - max(0, n - m)) for t, m in zip(totals, sizes)]


def sample_entropy(x: np.ndarray, least: int = 10) -> float:
    """Of one signal: m = 2 and 3, r a fifth of the deviation; 0 where it has no value."""
    r = 0.2 * x.std()
    if len(x) < least or r < EPS:
        return 0.0
    b, a = template_matches(x, (2, 3), r)
    return float(-math.log(a / (b + EPS))) if a > 0 and b > 0 else 0.0
