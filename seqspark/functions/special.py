"""Tails of the F and t distributions, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

from math import exp, lgamma, log, log1p


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's evaluation of its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + n * d or tiny)
        c = 1.0 + n / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0) if f != 1.0 else front


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_tail(t: float, d: float) -> float:
    """P(|T| > |t|) with d degrees of freedom."""
    return incomplete_beta(d / 2, 0.5, d / (d + t * t))


def retries(chance: float, success: float) -> int:
    """Trials after which a success has shown with the given chance, doubled."""
    from math import ceil

    return 2 * ceil(log(chance) / log(1 - success))


def success_rate(successes: int, trials: int) -> float:
    return (successes + 1) / (trials + 2)
