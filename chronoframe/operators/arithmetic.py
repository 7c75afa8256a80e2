"""Row-wise operators; a NULL operand gives NULL."""

from __future__ import annotations

from functools import reduce
from operator import add as plus

from pyspark.sql import functions as F

from ..functions import bounded, ieee_div, nan_to_null
from .registry import ROW, operator


@operator("add", 2, ROW)
def add(keys, a, b):
    return nan_to_null(a + b)


@operator("sub", 2, ROW)
def sub(keys, a, b):
    return nan_to_null(a - b)


@operator("mul", 2, ROW)
def mul(keys, a, b):
    return nan_to_null(a * b)


@operator("div", 2, ROW)
def div(keys, a, b):
    return ieee_div(a, b)


@operator("neg", 1, ROW)
def neg(keys, a):
    return -a


@operator("abs", 1, ROW)
def magnitude(keys, a):
    return F.abs(a)


@operator("sign", 1, ROW)
def sign(keys, a):
    return F.signum(a)


@operator("clip", 1, ROW, lo="number", hi="number")
def clip(keys, a, lo, hi):
    return bounded(a, F.lit(float(min(lo, hi))), F.lit(float(max(lo, hi))))


@operator("where", 3, ROW)
def where(keys, condition, a, b):
    """The second input where the first is not zero, the third where it is zero or missing."""
    return F.when(F.coalesce(condition, F.lit(0.0)) != 0, a).otherwise(b)


@operator("combine", None, ROW, weights="numbers")
def combine(keys, *columns, weights):
    return nan_to_null(reduce(plus, (c * float(w) for c, w in zip(columns, weights))))
