"""Per-date operators over the names of one date; NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bounded, ieee_div, mean_rank
from .registry import DATE, operator


def _day(keys):
    return Window.partitionBy(*keys, "date")


@operator("cs_rank", 1, DATE)
def rank(keys, x):
    """Percentile rank less one half, ties at their mean."""
    return mean_rank(x, _day(keys)) / F.count(x).over(_day(keys)) - 0.5


@operator("cs_zscore", 1, DATE)
def zscore(keys, x):
    d = _day(keys)
    return ieee_div(x - F.avg(x).over(d), F.stddev_samp(x).over(d))


@operator("cs_demean", 1, DATE)
def demean(keys, x):
    return x - F.avg(x).over(_day(keys))


@operator("cs_winsorize", 1, DATE, k="number")
def winsorize(keys, x, k):
    """Within k deviations of the mean; a date with one name has no deviation and bounds nothing."""
    d = _day(keys)
    mid, dev = F.avg(x).over(d), F.stddev_samp(x).over(d)
    return bounded(x, mid - dev * k, mid + dev * k)


@operator("cs_neutralize", 1, DATE, group="choice sector|country|region")
def neutralize(keys, x, group):
    """Less the mean of the date's group; names without a group have no value."""
    g = F.col(group)
    return F.when(g.isNotNull(), x - F.avg(x).over(Window.partitionBy(*keys, "date", g)))


@operator("cs_scale", 1, DATE)
def scale(keys, x):
    """Shares of the sum of magnitudes; all zero where that sum is."""
    size = F.sum(F.abs(x)).over(_day(keys))
    return F.when(size == 0, x * 0).otherwise(F.try_divide(x, size))
