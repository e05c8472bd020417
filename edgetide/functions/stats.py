"""Quantiles that Spark lacks: Student's t and the regularised incomplete beta function's inverse."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction, from its tail."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for i in range(500, 0, -1):
        m = i // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + step / value
    return front / value


def _invert(f, target: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid) < target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _invert(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t for p >= 0.5."""
    if p == 0.5:
        return 0.0
    tail = lambda t: 1 - beta_cdf(dof / (dof + t * t), dof / 2, 0.5) / 2
    return _invert(tail, p, 0.0, 1e6)


def clopper_pearson(successes: int, n: int, confidence: float) -> tuple[float, float]:
    alpha = 1 - confidence
    low = 0.0 if successes == 0 else beta_quantile(alpha / 2, successes, n - successes + 1)
    high = 1.0 if successes == n else beta_quantile(1 - alpha / 2, successes + 1, n - successes)
    return low, high
