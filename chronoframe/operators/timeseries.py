"""Per-asset operators. All count rows in date order, and a trailing window yields a value only when it
holds n values; infinities read as missing inside windows."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import finite, ieee_div, pearson, safe_ln
from .registry import ASSET, OPERATORS, ROW, operator

TRADING_DAYS = 252
#: Half-lives to a block of cumulative weights; their growth must stay within a double.
EWM_BLOCK = 400


def _line(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "asset_id").orderBy("date")


def _trailing(keys: list[str], n: int) -> WindowSpec:
    return _line(keys).rowsBetween(-(int(n) - 1), 0)


def _full(value: Column, of: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.count(of).over(w) == int(n), value)


def _rolling(name: str, aggregate):
    @operator(name, 1, ASSET, n="number")
    def build(keys, x, n):
        w, x = _trailing(keys, n), finite(x)
        return _full(aggregate(x).over(w), x, w, n)

    return build


mean = _rolling("rolling_mean", F.avg)
std = _rolling("rolling_std", F.stddev_samp)
total = _rolling("rolling_sum", F.sum)
highest = _rolling("rolling_max", F.max)
lowest = _rolling("rolling_min", F.min)


@operator("lag", 1, ASSET, n="number")
def lag(keys, x, n):
    return F.lag(x, int(n)).over(_line(keys))


@operator("diff", 1, ASSET, n="number")
def diff(keys, x, n):
    return x - F.lag(x, int(n)).over(_line(keys))


@operator("pct_change", 1, ASSET, n="number")
def pct_change(keys, x, n):
    return ieee_div(x, F.lag(x, int(n)).over(_line(keys))) - 1


@operator("log", 1, ROW)
def log(keys, x):
    return safe_ln(x)


@operator("rolling_zscore", 1, ASSET, n="number")
def zscore(keys, x, n):
    w, x = _trailing(keys, n), finite(x)
    return _full(ieee_div(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), x, w, n)


@operator("rolling_rank", 1, ASSET, n="number")
def rank(keys, x, n):
    """Share of the window at or below the current value, ties at their mean rank."""
    w, x = _trailing(keys, n), finite(x)
    seen = F.collect_list(x).over(w)
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return _full((below + (equal + 1) / 2.0) / int(n), x, w, n)


@operator("ewm", 1, ASSET, halflife="number")
def ewm(keys, x, halflife, helper):
    """Weighted mean of the past, weights halving every ``halflife`` rows; gaps keep their age.

    Rows fall into blocks of ``EWM_BLOCK`` half-lives. Within one, weights relative to its start make the
    sums cumulative, one step a row; of earlier rows, the block before adds its total and what lies
    further back is below 2**-EWM_BLOCK of any newer value. ``helper`` is the row number.
    """
    size = max(1, math.floor(EWM_BLOCK * halflife))
    block, step = F.floor((helper - 1) / size), (helper - 1) % size
    x = finite(x)
    grow = F.pow(F.lit(2.0), step / F.lit(float(halflife)))
    here = Window.partitionBy(*keys, "asset_id", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys, "asset_id").orderBy(block).rangeBetween(-1, -1)
    fade = F.lit(0.5 ** (size / halflife))

    def total(v: Column) -> Column:
        # the row's own growth cancels in the ratio, so neither part is scaled back
        return F.coalesce(F.sum(v).over(here), F.lit(0.0)) + F.coalesce(F.sum(v).over(before), F.lit(0.0)) * fade

    num, den = total(x * grow), total(F.when(x.isNotNull(), grow))
    return F.when(den > 0, F.try_divide(num, den))


def _row_number(keys):
    return F.row_number().over(_line(keys))


def _carry(keys, built):
    """Bridges gaps that leave two blocks without a value."""
    return F.last(built, ignorenulls=True).over(_line(keys).rowsBetween(Window.unboundedPreceding, 0))


OPERATORS["ewm"] = replace(OPERATORS["ewm"], prepare=_row_number, settle=_carry)


def _both(y: Column, x: Column) -> tuple[Column, Column, Column]:
    y, x = finite(y), finite(x)
    have = y.isNotNull() & x.isNotNull()
    return F.when(have, y), F.when(have, x), F.when(have, 1)


@operator("rolling_beta", 2, ASSET, n="number")
def beta(keys, y, x, n):
    """Slope of the first input on the second over rows that have both."""
    w = _trailing(keys, n)
    y, x, have = _both(y, x)
    return _full(ieee_div(F.covar_samp(y, x).over(w), F.var_samp(x).over(w)), have, w, n)


@operator("rolling_corr", 2, ASSET, n="number")
def corr(keys, a, b, n):
    w = _trailing(keys, n)
    a, b, have = _both(a, b)
    return _full(pearson(a, b, w), have, w, n)


@operator("rolling_vol", 1, ASSET, n="number")
def vol(keys, x, n):
    w, x = _trailing(keys, n), finite(x)
    return _full(F.stddev_samp(x).over(w) * math.sqrt(TRADING_DAYS), x, w, n)
