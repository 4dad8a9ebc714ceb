"""Distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_975 = 1.959963984540054

# Chebyshev coefficients of erfc (Press et al., Numerical
# Recipes, section 6.2), relative error below 1.2e-7 everywhere.
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)

# Critical values q_0.05 of the Nemenyi test for 2..10 methods
# (Demsar, JMLR 7, 2006, table 5).
NEMENYI_Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850,
               7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def nemenyi_q05(methods: int) -> float:
    """Critical value for a number of methods."""
    if methods not in NEMENYI_Q05:
        raise ValueError(f"Nemenyi critical values are known for 2 to 10 methods, not {methods}")
    return NEMENYI_Q05[methods]


def erfc(x: Column) -> Column:
    """Complementary error function."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def normal_cdf(x: Column) -> Column:
    return F.lit(0.5) * erfc(-x / F.lit(math.sqrt(2.0)))


def normal_two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_upper_tail(x: Column, df: int) -> Column:
    """P(X > x) for an integer number of degrees of freedom (finite sum)."""
    half = x / F.lit(2.0)
    if df % 2 == 0:
        total = F.lit(0.0)
        for i in range(df // 2):
            total = total + F.pow(half, F.lit(float(i))) / F.lit(float(math.factorial(i)))
        return F.exp(-half) * total
    total = F.lit(0.0)
    for i in range(1, (df - 1) // 2 + 1):
        total = total + F.pow(half, F.lit(i - 0.5)) / F.lit(math.gamma(i + 0.5))
    return erfc(F.sqrt(half)) + F.exp(-half) * total


def percent_effect(theta: Column, depth: Column) -> Column:
    """Percent change of quantity at a discount depth under a log slope."""
    return (F.exp(theta * depth) - F.lit(1.0)) * F.lit(100.0)
