"""Normal and chi-square helpers: a column expression for per-row quantiles, plain floats for the few cut-offs."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation of the normal quantile (P. J. Acklam).
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
              -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
                 -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
            4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_SHARE = 0.02425


def _horner(coefficients, x: Column) -> Column:
    result = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        result = result * x + F.lit(coefficient)
    return result


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution of a probability column (absolute error about 1e-9 relative)."""
    middle = p - F.lit(0.5)
    squared = middle * middle
    centre = _horner(CENTRE_TOP, squared) * middle / _horner(CENTRE_BOTTOM, squared)
    low = F.sqrt(F.log(p) * F.lit(-2.0))
    high = F.sqrt(F.log(F.lit(1.0) - p) * F.lit(-2.0))
    return (
        F.when(p < TAIL_SHARE, _horner(TAIL_TOP, low) / _horner(TAIL_BOTTOM, low))
        .when(p > 1 - TAIL_SHARE, -(_horner(TAIL_TOP, high) / _horner(TAIL_BOTTOM, high)))
        .otherwise(centre)
    )


def _bisect(function, target: float, low: float, high: float) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        if function(middle) < target:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def chi2_cdf(x: float, df: float) -> float:
    """Chi-square distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, df: float) -> float:
    return _bisect(lambda x: chi2_cdf(x, df), p, 0.0, 50.0 * df + 200.0)


def student_cdf(t: float, df: float) -> float:
    """Student distribution function by numeric integration of its density (Simpson's rule)."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)
    steps, upper = 2000, min(abs(t), 400.0)
    h = upper / steps
    area = density(0) + density(upper) + sum((4 if i % 2 else 2) * density(i * h) for i in range(1, steps))
    half = area * h / 3
    return 0.5 + half if t >= 0 else 0.5 - half


def student_quantile(p: float, df: float) -> float:
    if df > 1e6:
        return NormalDist().inv_cdf(p)
    return _bisect(lambda t: student_cdf(t, df), p, -400.0, 400.0)
