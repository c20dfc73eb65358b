"""Bias-corrected moments, fences and correlation as expressions over sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(n: Column, population: Column) -> Column:
    """Sample skewness G1: NULL under three values, 0 for a constant."""
    n = n.cast("double")
    g1 = F.coalesce(population, F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(n: Column, population: Column) -> Column:
    """Sample excess kurtosis G2: NULL under four values, 0 for a constant."""
    n = n.cast("double")
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)
    return F.when(n >= 4, F.coalesce(g2, F.lit(0.0)))


def moments_from_sums(n: int, d1: float, d2: float, d3: float, d4: float) -> dict:
    """Standard deviation, G1 and G2 from sums of powers of ``x - shift``.

    The shift is the mean of an earlier pass, so ``d1`` is only a rounding residue and
    the central moments lose nothing to cancellation.
    """
    out = {"std": None, "skewness": None, "kurtosis": None}
    if n < 1:
        return out
    e = d1 / n
    m2 = d2 / n - e * e
    m3 = d3 / n - 3 * e * d2 / n + 2 * e**3
    m4 = d4 / n - 4 * e * d3 / n + 6 * e * e * d2 / n - 3 * e**4
    flat = m2 <= 0
    if n >= 2:
        out["std"] = 0.0 if flat else math.sqrt(m2 * n / (n - 1))
    if n >= 3:
        out["skewness"] = 0.0 if flat else m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    if n >= 4:
        out["kurtosis"] = (
            0.0 if flat else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6)
        )
    return out


def fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    """Lower and upper limits 1.5 interquartile ranges outside the quartiles."""
    if q1 is None or q3 is None:
        return None, None
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach


def pearson(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; NULL when either is constant there."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def interpolate(lo: float, hi: float, fraction: float) -> float:
    return lo if fraction == 0 else lo * (1 - fraction) + hi * fraction
