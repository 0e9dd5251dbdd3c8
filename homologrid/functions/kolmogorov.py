"""p-values of the two-sample Kolmogorov-Smirnov statistic, one pair of samples at a time.

Samples of up to ``EXACT_UP_TO`` values get the exact p: the share of lattice paths that
leave the band around the diagonal.  Larger ones get the tail of the one-sample statistic of
the rounded effective size.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed value: the largest sample that is tested exactly by default.
EXACT_UP_TO = 10_000


def path_share(n1: int, n2: int, d: float) -> float:
    """Exact two-sided p: the chance that a random order of both samples has a gap of ``d`` or more.

    Diagonal by diagonal, the chance of standing at each point inside the band moves on; what
    steps over the band is added up, so small p-values keep their digits.
    """
    common = math.gcd(n1, n2)
    a, b = n1 // common, n2 // common
    gap = round(d * a * n2)
    if gap <= 0:
        return 1.0
    inside = np.zeros(n1 + 2)
    inside[0] = 1.0
    outside = 0.0
    low = high = 0
    for step in range(n1 + n2):
        left = n1 + n2 - step
        i = np.arange(low, high + 1)
        here = inside[low : high + 1]
        first = here * (n1 - i) / left
        second = here - first
        after = np.zeros(high - low + 2)
        after[1:] = first
        after[:-1] += second
        points = np.arange(low, high + 2)
        off = np.abs(points * b - (step + 1 - points) * a) >= gap
        outside += float(after[off].sum())
        after[off] = 0.0
        kept = np.flatnonzero(after)
        if not len(kept):
            break
        inside[low : high + 1] = 0.0
        low, high = low + int(kept[0]), low + int(kept[-1])
        inside[low : high + 1] = after[kept[0] : kept[-1] + 1]
    return min(1.0, outside)


def _one_sided(n: int, x: float) -> float:
    """P(D+ >= x) of one sample, by Birnbaum and Tingey's sum."""
    if x >= 1:
        return 0.0
    j = np.arange(0, math.floor(n * (1 - x)) + 1)
    lg = np.array([math.lgamma(k + 1) for k in range(n + 1)])
    base, rest = x + j / n, np.maximum(1 - x - j / n, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        power = np.where(n - j > 0, (n - j) * np.log(rest), 0.0)
        logs = lg[n] - lg[j] - lg[n - j] + (j - 1) * np.log(base) + power
    return float(x * np.exp(logs).sum())


def _inside_exact(n: int, x: float) -> float:
    """P(D < x) of one sample, by powers of Durbin's matrix (Marsaglia, Tsang and Wang)."""
    k = math.floor(n * x) + 1
    size, h = 2 * k - 1, k - n * x
    matrix = np.tril(np.ones((size, size)), 1)
    corner = h ** np.arange(1, size + 1)
    matrix[:, 0] -= corner
    matrix[-1] -= corner[::-1]
    matrix[-1, 0] += (2 * h - 1) ** size if 2 * h > 1 else 0.0
    for lag in range(2, size + 1):
        # Row i, column j has 1 / (i - j + 1)! from the first subdiagonal on.
        for i in range(lag - 1, size):
            matrix[i, : i - lag + 2] /= lag
    result, exponent = np.eye(size), 0
    factor, factor_exponent, left = matrix, 0, n
    while left:
        if left & 1:
            result, exponent = result @ factor, exponent + factor_exponent
        factor, factor_exponent, left = factor @ factor, 2 * factor_exponent, left >> 1
        if factor[k - 1, k - 1] > 1e140:
            factor, factor_exponent = factor * 1e-140, factor_exponent + 140
        if result[k - 1, k - 1] > 1e140:
            result, exponent = result * 1e-140, exponent + 140
    value = result[k - 1, k - 1]
    for i in range(1, n + 1):
        value *= i / n
        if value < 1e-140:
            value, exponent = value * 1e140, exponent - 140
    return float(value * 10.0**exponent)


def _inside_series(n: int, x: float, terms: int = 30) -> float:
    """P(D < x) of one sample, by Pelz and Good's expansion for large samples."""
    z = math.sqrt(n) * x
    k = np.arange(-terms, terms + 1)
    half = (2 * np.arange(0, terms) + 1) ** 2
    pi2, z2 = math.pi**2, z * z
    decay = np.exp(-half * pi2 / (8 * z2))
    whole = np.exp(-(k**2) * pi2 / (2 * z2))
    root = math.sqrt(2 * math.pi)
    k0 = root / z * decay.sum()
    k1 = root / (6 * z**4) * 2 * ((half * pi2 / 4 - z2) * decay).sum() / 2
    c2 = 6 * z**6 + 2 * z**4 + (2 * z**4 - 5 * z2) * pi2 * half / 4 + (1 - 2 * z2) * pi2**2 * half**2 / 16
    k2 = root / (72 * z**7) * (c2 * decay).sum() - root / (36 * z**3) * (pi2 * k**2 * whole).sum() / 2
    c3 = (
        -30 * z**6
        - 90 * z**8
        + pi2 * (135 * z**4 - 96 * z**6) * half / 4
        + pi2**2 * (212 * z**4 - 60 * z2) * half**2 / 16
        + pi2**3 * half**3 * (5 - 30 * z2) / 64
    )
    k3 = root / (6480 * z**10) * (c3 * decay).sum() + root / (216 * z**6) * (
        (-(pi2**2) * k**4 + 3 * pi2 * k**2 * z2) * whole
    ).sum() / 2
    return float(k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5)


def one_sample_tail(n: int, d: float) -> float:
    """P(D >= d) of one sample of size ``n``."""
    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d >= (4 if n <= 140 else 2.2):
        return min(1.0, 2 * _one_sided(n, d))
    if n <= 140 or n * d**1.5 <= 1.4:
        return min(1.0, max(0.0, 1 - _inside_exact(n, d)))
    return min(1.0, max(0.0, 1 - _inside_series(n, d)))


def two_sample_tail(n1: int, n2: int, d: float) -> float:
    """Two-sided p of the gap ``d`` between samples of ``n1`` and ``n2`` values."""
    if not n1 or not n2:
        return float("nan")
    if max(n1, n2) <= EXACT_UP_TO:
        return path_share(int(n1), int(n2), d)
    return one_sample_tail(int(np.round(n1 * n2 / (n1 + n2))), d)
