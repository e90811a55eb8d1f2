"""Distribution functions by series and continued fractions, and adjustments of p-values."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * front


def chi2_sf(x: float, df: int) -> float:
    return min(1.0, max(0.0, _gamma_tail(df / 2, x / 2)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, max(10.0, 10.0 * df)
    while chi2_sf(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction, on the side where it is quick."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def hypergeometric_tails(x: int, population: int, marked: int, drawn: int) -> tuple[float, float]:
    """P(X <= x) and P(X >= x) for draws without replacement."""

    def choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    low, high = max(0, drawn - (population - marked)), min(marked, drawn)
    if not low <= x <= high:
        return (0.0, 1.0) if x < low else (1.0, 0.0)
    log_p = lambda k: choose(marked, k) + choose(population - marked, drawn - k) - choose(population, drawn)

    def side(step: int, end: int) -> float:
        total, k = 0.0, x
        term = math.exp(log_p(x))
        while True:
            total += term
            if k == end or (term < total * 1e-17 and term == 0):
                return min(1.0, total)
            # the ratio of neighbouring probabilities
            if step < 0:
                term *= k * (population - marked - drawn + k) / ((marked - k + 1) * (drawn - k + 1))
            else:
                term *= (marked - k) * (drawn - k) / ((k + 1) * (population - marked - drawn + k + 1))
            k += step
            if term < total * 1e-18:
                return min(1.0, total)

    return side(-1, low), side(1, high)


def adjust_bh(p: list[float]) -> list[float]:
    return adjust(p, "BH")


def adjust(p: list[float], method: str) -> list[float]:
    """p-values adjusted by none, bonferroni, holm, hochberg, BH (or fdr) or BY."""
    n = len(p)
    if method == "none" or n < 2:
        return list(p)
    if method == "bonferroni":
        return [min(1.0, x * n) for x in p]
    order = sorted(range(n), key=lambda i: p[i])
    out = [0.0] * n
    if method == "holm":
        top = 0.0
        for rank, i in enumerate(order):
            top = max(top, (n - rank) * p[i])
            out[i] = min(1.0, top)
        return out
    harmonic = sum(1 / k for k in range(1, n + 1)) if method == "BY" else 1.0
    low = 1.0
    for rank in range(n - 1, -1, -1):
        i = order[rank]
        factor = (n - rank) if method == "hochberg" else harmonic * n / (rank + 1)
        low = min(low, factor * p[i])
        out[i] = low
    return out
