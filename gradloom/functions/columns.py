"""Scalar functions as native expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels.training import F32_EPS, SMALLEST_NORMAL


def sigmoid(x: Column, amp: float = 1.0) -> Column:
    return F.lit(amp) / (F.lit(1.0) + F.exp(-x))


def tanh(x: Column, amp: float = 1.0) -> Column:
    return F.lit(amp) * F.tanh(x)


def leaky_relu(x: Column, slope: float = 0.0) -> Column:
    return F.greatest(x, F.lit(slope) * x)


def sigmoid_slope(a: Column, amp: float = 1.0) -> Column:
    """Derivative by the activation's own value."""
    return a * (F.lit(1.0) - a / F.lit(amp))


def tanh_slope(a: Column, amp: float = 1.0) -> Column:
    return F.lit(amp) - a * a / F.lit(amp)


def leaky_relu_slope(x: Column, slope: float = 0.0) -> Column:
    return F.when(x > 0, F.lit(1.0)).otherwise(F.lit(slope))


def squared_error(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2.0))


def cross_entropy_term(p: Column, y: Column) -> Column:
    return -y * F.ln(F.greatest(p, F.lit(float(F32_EPS))))


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & x.isNotNull()


def normal_or_zero(x: Column) -> Column:
    """Losses that a recorder takes: zero and normal numbers, no subnormal, infinite or missing ones."""
    return finite(x) & ((x == 0) | (F.abs(x) >= F.lit(SMALLEST_NORMAL)))


def format_loss(x: Column) -> Column:
    """Three decimals and an exponent below 1e-4, else eight decimals."""
    return F.when(F.abs(x) < 1e-4, F.format_string("%.3e", x)).otherwise(F.format_string("%.8f", x))
