"""Null, NaN and infinity rules as Column expressions.

Missing is NULL everywhere; NaN is turned into NULL where it can arise. Division and logarithm keep
signed infinities, and windows read infinities as missing. Nothing depends on the ANSI flag.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """``x`` with NaN and both infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b where a zero divisor gives an infinity by the sign of a, and 0/0 gives NULL."""
    at_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(nan_to_null(F.try_divide(a, b)))


def safe_ln(x: Column) -> Column:
    """Natural logarithm; -infinity at zero, NULL below."""
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def bounded(x: Column, low: Column, high: Column) -> Column:
    """``x`` within its bounds; a NULL bound does not bound, a NULL x stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def mean_rank(x: Column, group: WindowSpec) -> Column:
    """Rank of x within the group, ties at their mean rank; NULL x has none. One sort serves both parts:
    a RANGE frame of the current row is the row's ties."""
    ordered = group.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(ordered.rangeBetween(0, 0))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2.0)


def pearson(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Correlation over rows that have both; NULL where either does not vary (``corr`` would divide by zero)."""
    have = a.isNotNull() & b.isNotNull()
    x, y = F.when(have, a), F.when(have, b)
    parts = [F.covar_samp(x, y), F.var_samp(x), F.var_samp(y)]
    c, u, v = [p.over(over) for p in parts] if over is not None else parts
    return nan_to_null(F.try_divide(c, F.sqrt(u) * F.sqrt(v)))
