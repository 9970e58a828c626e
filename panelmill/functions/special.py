"""Normal tail probabilities and quantiles as column expressions, in both SQL dialects.

``erfc`` is the rational Chebyshev fit of relative error below 1.2e-7 everywhere (Numerical
Recipes), the quantile is Acklam's rational approximation (relative error below 1.2e-9). The coefficients are
fixed values of those published fits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chebyshev fit of erfc, constant term first (fixed values).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807,
        -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: Acklam's central and tail fractions, highest power first (fixed values).
A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01, 1.0]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
     3.754408661907416e+00, 1.0]
LOW = 0.02425


def _poly(coefficients: list[float], x: str) -> str:
    """Horner's rule; highest power first."""
    out = f"{coefficients[0]!r}e0" if "e" not in repr(coefficients[0]) else repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))" if "e" in repr(c) else f"({out} * {x} + ({c!r}e0))"
    return out


def erfc_sql(x: str) -> str:
    """erfc(x) for x >= 0."""
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * ({x})))"
    return f"({t} * exp(-({x}) * ({x}) + {_poly(ERFC[::-1], t)}))"


def upper_tail_sql(z: str) -> str:
    """P(Z > z)."""
    x = f"(abs({z}) / sqrt(2.0e0))"
    return f"(CASE WHEN ({z}) >= 0 THEN 0.5e0 * {erfc_sql(x)} ELSE 1.0e0 - 0.5e0 * {erfc_sql(x)} END)"


def quantile_sql(p: str) -> str:
    """The z with P(Z <= z) = p."""
    q = f"(({p}) - 0.5e0)"
    r = f"({q} * {q})"
    low = f"sqrt(-2.0e0 * ln({p}))"
    high = f"sqrt(-2.0e0 * ln(1.0e0 - ({p})))"
    return (f"(CASE WHEN ({p}) < {LOW}e0 THEN {_poly(C, low)} / {_poly(D, low)} "
            f"WHEN ({p}) > {1 - LOW}e0 THEN -{_poly(C, high)} / {_poly(D, high)} "
            f"ELSE {q} * {_poly(A, r)} / {_poly(B, r)} END)")


def two_sided_sql(z: str) -> str:
    """P(|Z| > |z|) in DuckDB by Simpson's rule over the density: independent of ``erfc``."""
    return f"""greatest(0.0e0, 1.0e0 - 2.0e0 * (abs({z}) / 2000.0e0) / 3.0e0 / sqrt(2.0e0 * pi()) * list_sum(
      list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(-0.5e0 * power(abs({z}) / 2000.0e0 * i, 2)))))"""


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)
