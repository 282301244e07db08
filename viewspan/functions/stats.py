"""Distribution functions and exact rank tests on small arrays, with the standard library and numpy only."""

from __future__ import annotations

import math

import numpy as np


def norm_sf2(z: float) -> float:
    """Two-sided normal p."""
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c, tiny = x + 1 - a, 1e300, 1e-300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 or df <= 0 else _gamma_q(df / 2, x / 2)


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * h / a


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return _beta_inc(df / 2, 0.5, df / (df + t * t))


def mid_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    s = x[order]
    lo, hi = np.searchsorted(s, x, "left"), np.searchsorted(s, x, "right")
    return (lo + hi + 1) / 2


def signed_rank(x: np.ndarray, mu: float, exact_up_to: int = 25) -> dict:
    """Wilcoxon signed-rank test with Pratt's zeros: ranks of |d| include zeros, which then drop out.

    Exact, by counting subsets of doubled ranks, for at most ``exact_up_to``
    non-zero differences; else the normal limit. Fewer than two values or no
    difference: no p.
    """
    d = x[~np.isnan(x)] - mu
    out = {"n": len(d), "z": math.nan, "p": math.nan, "rank_biserial": math.nan, "exact": False}
    if len(d) < 2 or not (d != 0).any():
        return out
    r = mid_ranks(np.abs(np.round(d, 12)))
    keep = d != 0
    r, up = r[keep], d[keep] > 0
    t = r[up].sum()
    out["z"] = float((t - r.sum() / 2) / math.sqrt((r * r).sum() / 4))
    out["rank_biserial"] = float((2 * t - r.sum()) / r.sum())
    if len(r) <= exact_up_to:
        twice = np.rint(2 * r).astype(int)
        ways = np.zeros(twice.sum() + 1)
        ways[0] = 1
        for k in twice:
            ways[k:] += ways[:-k].copy()
        dist = np.abs(np.arange(len(ways)) - twice.sum() / 2)
        out["p"] = float(ways[dist >= abs(2 * t - twice.sum() / 2) - 1e-9].sum() / ways.sum())
        out["exact"] = True
    else:
        out["p"] = norm_sf2(out["z"])
    return out


def mann_whitney(x: np.ndarray, y: np.ndarray, exact_below: int = 10, work: float = 5e7) -> dict:
    """Two-sample rank test: z with ties, P(X > Y) + P(X = Y) / 2, and p.

    Exact (the conditional distribution of the rank sum, by counting subsets
    of doubled ranks) if the smaller group has fewer than ``exact_below``.
    """
    x, y = x[~np.isnan(x)], y[~np.isnan(y)]
    n, m = len(x), len(y)
    out = {"z": math.nan, "p": math.nan, "ps": math.nan, "exact": False}
    both = np.concatenate([x, y])
    if not n or not m or (both == both[0]).all():
        return out
    r = mid_ranks(both)
    w = r[:n].sum()
    out["ps"] = float((w - n * (n + 1) / 2) / (n * m))
    var = n * m / (n + m) * ((r * r).sum() - (n + m) * ((n + m + 1) / 2) ** 2) / (n + m - 1)
    out["z"] = float((w - n * (n + m + 1) / 2) / math.sqrt(var))
    small = r[:n] if n <= m else r[n:]
    k = len(small)
    twice = np.rint(2 * r).astype(int)
    top = int(np.sort(twice)[-k:].sum())
    if k < exact_below and (n + m) * k * top <= work:
        ways = np.zeros((k + 1, top + 1))
        ways[0, 0] = 1
        for v in twice:
            for j in range(k, 0, -1):
                ways[j, v:] += ways[j - 1, : top + 1 - v]
        mean = k * (n + m + 1)
        dist = np.abs(np.arange(top + 1) - mean)
        out["p"] = float(ways[k, dist >= abs(2 * small.sum() - mean) - 1e-9].sum() / ways[k].sum())
        out["exact"] = True
    else:
        out["p"] = norm_sf2(out["z"])
    return out


def kruskal(groups: list[np.ndarray]) -> dict:
    """Tie-corrected H, degrees of freedom, epsilon squared and the chi-square p."""
    groups = [g[~np.isnan(g)] for g in groups if (~np.isnan(g)).any()]
    x = np.concatenate(groups) if groups else np.zeros(0)
    n = len(x)
    if len(groups) < 2 or (x == x[0]).all():
        return {"h": math.nan, "df": len(groups) - 1, "eps2": math.nan, "p": math.nan}
    r = mid_ranks(x)
    cuts = np.cumsum([len(g) for g in groups])[:-1]
    s = sum(p.sum() ** 2 / len(p) for p in np.split(r, cuts))
    t = np.unique(x, return_counts=True)[1].astype(float)
    h = (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    return {"h": float(h), "df": len(groups) - 1, "eps2": float(h / (n - 1)), "p": chi2_sf(h, len(groups) - 1)}


def _root(f, lo: float, hi: float, tol: float = 1e-4) -> float:
    a, b = f(lo), f(hi)
    if a == 0:
        return lo
    if b == 0:
        return hi
    if a * b > 0:
        return lo if abs(a) < abs(b) else hi
    while hi - lo > tol / 4:
        mid = (lo + hi) / 2
        if a * f(mid) <= 0:
            hi = mid
        else:
            lo, a = mid, f(mid)
    return (lo + hi) / 2


def hodges_lehmann_one(x: np.ndarray, conf: float = 0.95) -> tuple[float, float, float]:
    """Shift estimate and interval by inverting the asymptotic signed-rank test (continuity corrected for the bounds)."""
    x = x[~np.isnan(x)]
    if len(x) < 2 or (x == x[0]).all():
        return (float(x[0]), math.nan, math.nan) if len(x) else (math.nan,) * 3

    def w(d, z, correct):
        v = x - d
        v = v[v != 0]
        n = len(v)
        if not n:
            return 0.0
        r = mid_ranks(np.abs(v))
        s = r[v > 0].sum() - n * (n + 1) / 4
        t = np.unique(r, return_counts=True)[1].astype(float)
        sigma = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48)
        if sigma == 0:
            return 0.0
        return (s - (math.copysign(0.5, z) if correct and z else 0.0)) / sigma - z

    from statistics import NormalDist

    q = NormalDist().inv_cdf(0.5 + conf / 2)
    lo, hi = float(x.min()), float(x.max())
    return _root(lambda d: w(d, 0.0, False), lo, hi), _root(lambda d: w(d, q, True), lo, hi), _root(lambda d: w(d, -q, True), lo, hi)


def hodges_lehmann_two(x: np.ndarray, y: np.ndarray, conf: float = 0.95) -> tuple[float, float, float]:
    """Shift of ``x`` over ``y`` and interval by inverting the asymptotic rank-sum test."""
    x, y = x[~np.isnan(x)], y[~np.isnan(y)]
    if not len(x) or not len(y):
        return (math.nan,) * 3

    def w(d, z, correct):
        r = mid_ranks(np.concatenate([x - d, y]))
        n, m = len(x), len(y)
        s = r[:n].sum() - n * (n + 1) / 2 - n * m / 2
        t = np.unique(r, return_counts=True)[1].astype(float)
        sigma = math.sqrt(n * m / 12 * ((n + m + 1) - (t**3 - t).sum() / ((n + m) * (n + m - 1))))
        if sigma == 0:
            return 0.0
        return (s - (math.copysign(0.5, z) if correct and z else 0.0)) / sigma - z

    from statistics import NormalDist

    q = NormalDist().inv_cdf(0.5 + conf / 2)
    lo, hi = float(x.min() - y.max()), float(x.max() - y.min())
    if lo == hi:
        return lo, math.nan, math.nan
    return _root(lambda d: w(d, 0.0, False), lo, hi), _root(lambda d: w(d, q, True), lo, hi), _root(lambda d: w(d, -q, True), lo, hi)
