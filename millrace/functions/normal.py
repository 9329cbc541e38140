"""Inverse of the normal distribution as a Spark column (rational approximation, 1e-9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Published coefficients of the approximation.
A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01, 1.0)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
     3.754408661907416e+00, 1.0)
TAIL = 0.02425


def _poly(coefs: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefs[1:], F.lit(coefs[0]))


def inverse_normal(p: Column) -> Column:
    q = p - 0.5
    middle = _poly(A, q * q) * q / _poly(B, q * q)
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when(p < TAIL, _poly(C, low) / _poly(D, low))
        .when(p > 1 - TAIL, -_poly(C, high) / _poly(D, high)).otherwise(middle)
    )
