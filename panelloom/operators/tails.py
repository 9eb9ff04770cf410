"""Upper tails of the F and chi-squared distributions, on the driver."""

from __future__ import annotations

from math import exp, lgamma, log, log1p


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_tail(x: float, df: float) -> float:
    """P(X > x)."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = exp(a * log(z) - z - lgamma(a))
    if z < a + 1:  # series of the lower tail
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * out
