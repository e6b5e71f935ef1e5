"""Thresholds from distributions fitted to a column."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _normal_cdf(x):
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(x, float) / math.sqrt(2))


def _normal_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def nelder_mead(f, x0: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float]:
    """A minimum of f near x0 by the simplex method of Nelder and Mead."""
    n = len(x0)
    s = [np.array(x0, float)] + [np.array(x0, float) + np.eye(n)[i] * (0.1 * abs(x0[i]) or 0.1) for i in range(n)]
    v = [f(x) for x in s]
    for _ in range(steps):
        o = np.argsort(v, kind="stable")
        s, v = [s[i] for i in o], [v[i] for i in o]
        if abs(v[-1] - v[0]) < 1e-10 * (1 + abs(v[0])):
            break
        c = np.mean(s[:-1], axis=0)
        r = c + (c - s[-1])
        fr = f(r)
        if fr < v[0]:
            e = c + 2 * (c - s[-1])
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = c + 0.5 * (s[-1] - c)
            fk = f(k)
            if fk < v[-1]:
                s[-1], v[-1] = k, fk
            else:
                s = [s[0]] + [s[0] + 0.5 * (x - s[0]) for x in s[1:]]
                v = [v[0]] + [f(x) for x in s[1:]]
    i = int(np.argmin(v))
    return s[i], v[i]


def _logpdf(kind: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log density with parameters (location, log scale, shape...)."""
    loc, scale = p[0], math.exp(min(50.0, p[1]))
    z = (x - loc) / scale
    with np.errstate(all="ignore"):
        if kind == "norm":
            return -0.5 * z * z - math.log(scale) - 0.5 * math.log(2 * math.pi)
        if kind == "laplace":
            return -np.abs(z) - math.log(2 * scale)
        if kind == "expon":
            return np.where(z >= 0, -z - math.log(scale), -np.inf)
        if kind == "lognorm":
            s = math.exp(min(20.0, p[2]))
            lz = np.log(np.where(z > 0, z, np.nan))
            return np.where(z > 0, -0.5 * (lz / s) ** 2 - lz - math.log(s * scale) - 0.5 * math.log(2 * math.pi), -np.inf)
        if kind == "wald":
            return np.where(z > 0, -0.5 * (z - 1) ** 2 / np.where(z > 0, z, 1) - 1.5 * np.log(np.where(z > 0, z, 1)) - 0.5 * math.log(2 * math.pi) - math.log(scale), -np.inf)
        if kind == "weibull_min":
            k = math.exp(min(5.0, p[2]))
            lz = np.log(np.where(z > 0, z, 1))
            return np.where(z > 0, math.log(k / scale) + (k - 1) * lz - np.exp(np.clip(k * lz, -700, 700)), -np.inf)
        lo, hi = p[2], p[2] + math.exp(min(50.0, p[3]))
        inside = (z >= lo) & (z <= hi)
        if kind == "truncnorm":
            mass = float(_normal_cdf(hi) - _normal_cdf(lo))
            return np.where(inside, -0.5 * z * z - 0.5 * math.log(2 * math.pi) - math.log(scale) - math.log(max(mass, 1e-300)), -np.inf)
        return np.where((z >= 0) & (z <= hi - lo), -z - math.log(scale) - math.log(max(-math.expm1(-(hi - lo)), 1e-300)), -np.inf)


def _ppf(kind: str, q: float, p: np.ndarray) -> float:
    loc, scale = p[0], math.exp(min(50.0, p[1]))
    if kind == "norm":
        return loc + scale * _normal_ppf(q)
    if kind == "laplace":
        return loc + scale * (math.log(2 * q) if q < 0.5 else -math.log(2 * (1 - q)))
    if kind == "expon":
        return loc - scale * math.log1p(-q)
    if kind == "lognorm":
        return loc + scale * math.exp(math.exp(p[2]) * _normal_ppf(q))
    if kind == "weibull_min":
        return loc + scale * (-math.log1p(-q)) ** (1 / math.exp(p[2]))
    if kind == "wald":
        # distribution function of the inverse Gaussian of mean and shape 1
        cdf = lambda z: float(_normal_cdf((z - 1) / math.sqrt(z)) + math.exp(2) * _normal_cdf(-(z + 1) / math.sqrt(z)))
        lo, hi = 1e-12, 1e6
        for _ in range(200):
            mid = math.sqrt(lo * hi)
            lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
        return loc + scale * lo
    width = math.exp(min(50.0, p[3]))
    if kind == "truncnorm":
        a, b = float(_normal_cdf(p[2])), float(_normal_cdf(p[2] + width))
        return loc + scale * _normal_ppf(min(max(a + q * (b - a), 1e-16), 1 - 1e-16))
    return loc - scale * math.log1p(-q * -math.expm1(-width))


def fit(x: np.ndarray, times: np.ndarray | None = None) -> tuple[str, np.ndarray]:
    """The family of greatest likelihood with its parameters. norm, expon and laplace have closed forms; the others are searched for.

    `times` tells how often each value stands; once if it is not given.
    """
    x = np.asarray(x, float)
    n = np.ones(len(x)) if times is None else np.asarray(times, float)
    mean, lo, hi = float(np.average(x, weights=n)), float(x.min()), float(x.max())
    std = math.sqrt(float(np.average((x - mean) ** 2, weights=n))) or 1e-9
    width = max(hi - lo, 1e-9)
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    middle = [np.searchsorted(upto, upto[-1] / 2, side=side) for side in ("left", "right")]
    median = float(x[order][middle].mean())
    fits = {
        "norm": np.array([mean, math.log(std)]),
        "expon": np.array([lo, math.log(max(mean - lo, 1e-9))]),
        "laplace": np.array([median, math.log(max(float(np.average(np.abs(x - median), weights=n)), 1e-9))]),
    }
    below = lo - 1e-3 * width
    start = {
        "lognorm": [below, math.log(max(median - below, 1e-9)), 0.0],
        "wald": [below, math.log(max(mean - below, 1e-9))],
        "weibull_min": [below, math.log(max(mean - below, 1e-9)), 0.0],
        "truncnorm": [mean, math.log(std), (lo - mean) / std - 1e-3, math.log(width / std + 2e-3)],
        "truncexpon": [below, math.log(max(mean - lo, 1e-9)), 0.0, math.log((hi - below) / max(mean - lo, 1e-9) + 1e-3)],
    }
    loss = lambda kind: lambda p: float(v) if math.isfinite(v := -(n * _logpdf(kind, x, p)).sum()) else 1e300
    score = {k: loss(k)(p) for k, p in fits.items()}
    for kind, p0 in start.items():
        fits[kind], score[kind] = nelder_mead(loss(kind), np.array(p0))
    best = min(score, key=score.get)
    return best, fits[best]


def threshold(table: DataFrame, column: str, percent: float = 0.05) -> tuple[float, float]:
    """The lower and upper `percent` quantile of the distribution that fits the finite values best. The driver holds each distinct value with its number."""
    v = table.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").where(F.abs("v") != float("inf"))
    found = v.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").toArrow()
    x, n = found["v"].to_numpy(), found["n"].to_numpy()
    if n.sum() < 2:
        raise ValueError(f"{column} has too few finite values")
    kind, p = fit(x, n)
    return _ppf(kind, percent, p), _ppf(kind, 1 - percent, p)
