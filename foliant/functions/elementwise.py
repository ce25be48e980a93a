"""Element-wise tensor functions as column expressions; all stay within whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rational approximation of erf by Abramowitz and Stegun, 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def relu(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))  # greatest skips nulls


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def erf(x: Column) -> Column:
    """The approximation, not the exact function: results must agree with it."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.when(x < 0, -1.0).otherwise(1.0) * (1 - poly * F.exp(-x * x))


def hard_sigmoid(x: Column, alpha: float = 0.2, beta: float = 0.5) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha * x + beta)))


def hard_swish(x: Column, alpha: float = 1 / 6, beta: float = 0.5) -> Column:
    return hard_sigmoid(x, alpha, beta) * x


def gelu(x: Column, divisor: float = 2**0.5, add: float = 1.0, factor: float = 0.5) -> Column:
    return (erf(x / divisor) + add) * x * factor


def divide(a: Column, b: Column) -> Column:
    """IEEE division: infinities and NaN in place of an error."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, inf).when(a < 0, -inf).when(a.isNotNull() & b.isNotNull(), nan)


def batch_norm(x: Column, mean: Column, var: Column, scale: Column, bias: Column, eps: float = 1e-5) -> Column:
    return (x - mean) * (scale / F.sqrt(var + eps)) + bias
