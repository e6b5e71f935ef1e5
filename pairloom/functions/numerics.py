"""Numerics on one signal or table row, in numpy; Spark calls them once per group."""

from __future__ import annotations

import math

import numpy as np


def lowess(y: np.ndarray, frac: float = 0.66, passes: int = 3) -> np.ndarray:
    """Locally weighted linear regression on 0..n-1 (Cleveland, 1979): tricube weights over the nearest frac of the points, then robust passes."""
    y = np.asarray(y, float)
    n = len(y)
    k = min(n, max(2, int(frac * n + 1e-10)))
    x = np.arange(n, dtype=float)
    if n < 3:
        return y.copy()
    gap = np.abs(x[:, None] - x[None, :])
    reach = np.partition(gap, k - 1, axis=1)[:, k - 1 : k]
    near = np.clip(1 - (gap / np.maximum(reach, 1e-12)) ** 3, 0, None) ** 3
    robust = np.ones(n)
    fit = y
    for _ in range(passes + 1):
        w = near * robust[None, :]
        total = w.sum(1)
        total[total == 0] = 1
        mx, my = (w @ x) / total, (w @ y) / total
        vx = (w * (x[None, :] - mx[:, None]) ** 2).sum(1)
        cov = (w * (x[None, :] - mx[:, None]) * (y[None, :] - my[:, None])).sum(1)
        fit = my + np.where(vx > 1e-12, cov / np.where(vx > 1e-12, vx, 1), 0) * (x - mx)
        r = np.abs(y - fit)
        s = 6 * np.median(r)
        if s < 1e-12:
            break
        robust = np.clip(1 - (r / s) ** 2, 0, None) ** 2
    return fit


def find_peaks(signal: np.ndarray, threshold: float) -> list[tuple[int, float, float]]:
    """(position, height, prominence) of the local maxima that reach the threshold in both; the signal is taken to be 0 outside.

    A plateau counts once, at its middle (rounded down). The prominence is the height above the higher of the two
    valleys that lie between the peak and the next higher place on either side, or the end.
    """
    x = np.concatenate([[0.0], np.asarray(signal, float), [0.0]])
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                at = (i + j) // 2
                left = right = x[at]
                k = at
                while k >= 0 and x[k] <= x[at]:
                    left = min(left, x[k])
                    k -= 1
                k = at
                while k < n and x[k] <= x[at]:
                    right = min(right, x[k])
                    k += 1
                prominence = x[at] - max(left, right)
                if x[at] >= threshold and prominence >= threshold:
                    out.append((at - 1, float(x[at]), float(prominence)))
            i = j + 1
        else:
            i += 1
    return out


def autocorrelation(y: np.ndarray) -> np.ndarray:
    """The biased autocorrelation at lags 1 to n-1; a constant signal has none (NaN)."""
    y = np.asarray(y, float) - np.mean(y)
    n, total = len(y), float((y * y).sum())
    if n < 2:
        return np.zeros(0)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(y, size)
    return np.fft.irfft(f * np.conj(f), size)[1:n] / total if total > 0 else np.full(n - 1, np.nan)


def periodicity(y: np.ndarray, by_amplitude: bool = False) -> tuple[float, float]:
    """(period, amplitude) of the strongest frequency of the autocorrelation: by the real part of the spectrum, or by its size."""
    a = autocorrelation(y)
    if len(a) < 2 or np.isnan(a).any():
        return math.nan, math.nan
    s = np.fft.rfft(a)
    k = int(np.argmax(np.abs(s) if by_amplitude else s.real))
    f = np.fft.rfftfreq(len(a))[k]
    return (round(1 / f, 2) if f else math.inf), round(float(abs(s[k])), 3)


def uniform_p(counts: np.ndarray) -> float:
    """p-value of the chi-square test that all counts (2 or 4) are equal."""
    c = np.asarray(counts, float)
    e = c.mean()
    if e == 0:
        return math.nan
    s = float(((c - e) ** 2).sum() / e)
    tail = math.erfc(math.sqrt(s / 2))
    return tail if len(c) == 2 else tail + math.sqrt(2 * s / math.pi) * math.exp(-s / 2)


def hypergeometric_two_sided(k: int, drawn: int, good: int, total: int) -> float:
    """Fisher's exact p-value of k good ones among `drawn` from `total` that hold `good`."""

    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    lo, hi = max(0, drawn + good - total), min(drawn, good)
    base = choose(total, drawn)
    logs = np.array([choose(good, i) + choose(total - good, drawn - i) - base for i in range(lo, hi + 1)])
    return float(min(1.0, np.exp(logs[logs <= logs[k - lo] + 1e-7]).sum()))


def cut_noise(signal: np.ndarray, peaks: list[int], method: str = "median", height_multiplier: float = 0.75) -> float:
    """What is left of a signal without its peaks: the median, or the range.

    From each peak one walks down on both sides until the signal is at (left) or below (right) a share of the peak's
    height; what lies between, without its right end, is cut out. All walks are made on the whole signal, then all cuts.
    """
    x = np.asarray(signal, float).copy()
    cuts = []
    for p in peaks:
        low = height_multiplier * x[p]
        left = p - 1
        while left >= 0 and not x[left] <= low:
            left -= 1
        right = p + 1
        while right < len(x) and not x[right] < low:
            right += 1
        cuts.append((left + 1, right - 1 if right < len(x) else len(x) - 1))
    for a, b in cuts:
        x[a:b] = np.nan
    rest = x[~np.isnan(x)]
    if not len(rest):
        return math.nan
    return float(np.median(rest)) if method == "median" else float(rest.max() - rest.min())
