"""Target weights for every rebalance date at once: select, size, level and cap, neutralise.

All steps are windows over ``keys + date`` (and leg), so dates, scenarios and books of any number are
one plan. Ties in the signal go to the smaller asset id. Legs that would share a name are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mean_rank
from .spec import Portfolio

EPS = 1e-9


def leg_targets(p: Portfolio) -> tuple[float, float]:
    """Sums that the long and the short leg are to reach."""
    long, short = (p.gross_leverage + p.net_exposure) / 2, (p.gross_leverage - p.net_exposure) / 2
    if min(long, short) < -EPS:
        raise ValueError("net_exposure is larger than gross_leverage")
    return long, short


def _fail_if(bad: Column, value: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def _legs(df: DataFrame, p: Portfolio, day: list[str]) -> DataFrame:
    """``df`` with ``side``: 1 long, -1 short; other rows go."""
    w = Window.partitionBy(*day)
    if p.construction == "threshold":
        lo, hi = p.threshold.lo, p.threshold.hi
        if lo is not None and hi is not None and lo > hi:
            raise ValueError("threshold.lo is above threshold.hi: the legs would share names")
        side = F.when(F.lit(hi is not None) & (F.col("signal") > F.lit(hi)), 1.0).when(F.lit(lo is not None) & (F.col("signal") < F.lit(lo)), -1.0)
        return df.withColumn("side", side).where("side is not null")
    df = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc("signal"), "asset_id"))).withColumn("_n", F.count(F.lit(1)).over(w))
    if p.construction == "top_n_bottom_n":
        if p.n is None or p.n < 1:
            raise ValueError("top_n_bottom_n needs n of at least 1")
        k = F.lit(p.n)
    else:
        if p.quantile is None:
            raise ValueError(f"{p.construction} needs a quantile")
        k = F.greatest(F.lit(1), F.bround(F.lit(p.quantile) * F.col("_n"), 0).cast("int"))
    long = F.col("_r") <= k
    if p.construction == "long_only_quantile":
        return df.where(long).withColumn("side", F.lit(1.0))
    short = F.col("_r") > F.col("_n") - k
    side = F.when(long, 1.0).when(short, -1.0)
    return df.withColumn("side", _fail_if(long & short, side, "the long and the short leg share names")).where("side is not null")


def _sized(df: DataFrame, p: Portfolio, day: list[str]) -> DataFrame:
    """``df`` with ``raw``, a signed size."""
    if p.construction == "rank_weighted":
        w = Window.partitionBy(*day)
        return df.withColumn("raw", mean_rank(F.col("signal"), w) / F.count("signal").over(w) - 0.5)
    df = _legs(df, p, day)
    if p.weighting == "equal":
        size = F.lit(1.0)
    elif p.weighting == "rank":
        size = mean_rank(F.col("signal") * F.col("side"), Window.partitionBy(*day, "side"))
    elif p.weighting == "signal":
        size = F.abs("signal")
    else:
        if "vol" not in df.columns:
            raise ValueError("weighting=vol_scaled needs a vol column")
        size = _fail_if(F.col("vol").isNull(), F.try_divide(F.lit(1.0), F.col("vol")), "vol_scaled: vol is missing for a selected name")
    return df.withColumn("raw", size * F.col("side"))


def _capped(df: DataFrame, p: Portfolio, day: list[str]) -> DataFrame:
    """``df`` with ``weight``: each leg scaled to its target, no name above max_position.

    Scaling, cutting what is over the cap and sharing it among the rest ends with the j largest names at
    the cap, for the smallest j at which the next name fits. Sorted by size, that j follows from sums
    over the leg: three windows in place of a loop.
    """
    long, short = leg_targets(p)
    cap = p.max_position
    leg = [*day, "_leg"]
    whole = Window.partitionBy(*leg)
    line = whole.orderBy(F.desc("_m"), "asset_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_leg", F.signum("raw")).withColumn("_m", F.abs("raw"))
    df = df.withColumn("_t", F.when(F.col("_leg") > 0, long).when(F.col("_leg") < 0, short).otherwise(0.0))
    df = df.select("*", F.row_number().over(whole.orderBy(F.desc("_m"), "asset_id")).alias("_i"), F.count(F.lit(1)).over(whole).alias("_c"), F.sum("_m").over(whole).alias("_s"), F.sum("_m").over(line).alias("_p"))
    left = F.col("_t") - (F.col("_i") - 1) * cap  # for this name and the smaller ones, were all larger ones capped
    rest = F.col("_s") - (F.col("_p") - F.col("_m"))
    share = F.when(rest <= 0, F.try_divide(left, F.col("_c") - F.col("_i") + 1)).otherwise(F.try_divide(F.col("_m") * left, rest))
    df = df.withColumn("_j", F.coalesce(F.min(F.when(share <= cap + EPS, F.col("_i") - 1)).over(whole), F.col("_c")))
    df = df.withColumn("_q", F.coalesce(F.sum(F.when(F.col("_i") <= F.col("_j"), F.col("_m"))).over(whole), F.lit(0.0)))
    left, rest = F.col("_t") - F.col("_j") * cap, F.col("_s") - F.col("_q")
    free = F.when(rest <= 0, F.try_divide(left, F.col("_c") - F.col("_j"))).otherwise(F.try_divide(F.col("_m") * left, rest))
    size = F.when(F.col("_i") <= F.col("_j"), cap).otherwise(free)
    tight = (F.col("_leg") != 0) & (F.col("_t") > 0) & (cap * F.col("_c") < F.col("_t") - EPS)
    weight = F.when((F.col("_leg") == 0) | (F.col("_t") <= 0), 0.0).otherwise(size * F.col("_leg"))
    df = df.withColumn("weight", _fail_if(tight, weight, "a leg cannot reach its target under max_position"))
    return df.drop("_leg", "_m", "_t", "_i", "_c", "_s", "_p", "_j", "_q", "_r", "_n")


def construct_weights(signals: DataFrame, p: Portfolio, keys: tuple[str, ...] = ()) -> DataFrame:
    """``signals(keys, date, asset_id, signal[, vol, beta, sector, country])`` -> ``keys, date, asset_id,
    weight``. Rows without a signal are left out; a date without any has no weights."""
    day = [*keys, "date"]
    df = _capped(_sized(signals.where("signal is not null"), p, day), p, day)
    w = Window.partitionBy(*day)
    for by in p.neutralize:
        if by not in df.columns:
            raise ValueError(f"neutralize={by} needs a {by} column")
        if by == "beta":
            b = _fail_if(F.col("beta").isNull(), F.col("beta"), "neutralize: beta is missing for a selected name")
            square = F.sum(F.col("beta") * F.col("beta")).over(w)
            slope = F.sum(F.col("weight") * b).over(w)
            df = df.withColumn("weight", F.when(square == 0, F.col("weight")).otherwise(F.col("weight") - F.try_divide(slope, square) * b))
        else:
            mean = F.avg("weight").over(Window.partitionBy(*day, by))
            df = df.withColumn("weight", _fail_if(F.col(by).isNull(), F.col("weight") - mean, f"neutralize: {by} is missing for a selected name"))
    return df.select(*day, "asset_id", "weight")
