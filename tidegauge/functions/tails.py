"""Tail probabilities, in plain Python: the session has no library for them."""

from __future__ import annotations

import math
from statistics import NormalDist

Z = NormalDist()


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return Z.inv_cdf(p)


def chi2_sf(x: float, k: float) -> float:
    """Upper regularised incomplete gamma function at (k / 2, x / 2): a series below, a continued fraction above."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf_approx(x: float, k: float) -> float:
    """By the cube root's normal approximation."""
    v = 2 / (9 * k)
    return normal_sf(((max(x, 0.0) / k) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def t_sf(x: float, n: float) -> float:
    """Upper tail of Student's t, from the incomplete beta function's continued fraction."""
    half = 0.5 * beta_reg(n / (n + x * x), n / 2, 0.5)
    return half if x >= 0 else 1 - half


def beta_reg(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_reg(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + num * d), 1 + num / c
        h *= d * c
        num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + num * d), 1 + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
