"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdpeak import fixed_values as fv

# Sums of doubles depend on the order of addition in their last bits. A value is nudged before it is rounded for
# display, and rounded to RANK_DIGITS before it is compared, so a result never depends on how rows were partitioned.
NUDGE = 1e-9
RANK_DIGITS = 9


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row. An expression that is used inside the lambda of an array
    function would otherwise be computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rounded(value: Column, digits: int = 2) -> Column:
    return F.round(value + F.lit(NUDGE), digits)


def comparable(value: Column) -> Column:
    return F.round(value, RANK_DIGITS)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(fv.ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(fv.ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def semitones(value: Column, base: Column) -> Column:
    return F.lit(12.0) * F.log2(value / base)


def decibels(rms: Column, floor_db: float = -90.0) -> Column:
    return F.when(rms > 0, F.greatest(F.lit(floor_db), F.lit(20.0) * F.log10(rms))).otherwise(F.lit(floor_db))


def softmax(logits: Column) -> Column:
    """Softmax of an array column; the maximum is taken off first so that `exp` cannot overflow."""
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits)))
    return renormalised(shifted)


def renormalised(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(values, lambda x: x / total)


def first_argmax(values: Column) -> Column:
    """Zero-based index of the largest array element, the first one on ties."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
