"""Return statistics, grouped by any keys (a scenario, a claim)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def _line(keys):
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def cumulative_returns(returns: DataFrame, keys: tuple[str, ...] = ("scenario",), col: str = "net") -> DataFrame:
    """``returns`` with ``growth``, the product of 1 + return so far."""
    return returns.withColumn("growth", F.product(1 + F.col(col)).over(_line(keys)))


def sharpe(col: str = "net", periods: int = TRADING_DAYS) -> Column:
    """Annualised mean over deviation; 0 for under two rows or no deviation."""
    dev = F.stddev_samp(col)
    return F.when((F.count(col) < 2) | (dev == 0), 0.0).otherwise(F.try_divide(F.avg(col), dev) * math.sqrt(periods))


def annualized_vol(col: str = "net", periods: int = TRADING_DAYS) -> Column:
    return F.coalesce(F.stddev_samp(col) * math.sqrt(periods), F.lit(0.0))


def summary(returns: DataFrame, keys: tuple[str, ...] = ("scenario",), col: str = "net", periods: int = TRADING_DAYS) -> DataFrame:
    """``keys, n, total_return, annualized_return, annualized_vol, sharpe, max_drawdown`` of a return series.

    Drawdown is measured from the first growth value, so a loss on the first date is not one. A growth of
    zero or less has annualised return 0. No rows give no row.
    """
    grown = cumulative_returns(returns, keys, col).withColumn("_peak", F.max("growth").over(_line(keys)))
    out = grown.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("growth", "date").alias("_g"),
        annualized_vol(col, periods).alias("annualized_vol"),
        sharpe(col, periods).alias("sharpe"),
        F.min(F.try_divide(F.col("growth"), F.col("_peak")) - 1).alias("max_drawdown"),
    )
    yearly = F.when(F.col("_g") > 0, F.pow("_g", F.lit(float(periods)) / F.col("n")) - 1).otherwise(0.0)
    return out.select(*keys, "n", (F.col("_g") - 1).alias("total_return"), yearly.alias("annualized_return"), "annualized_vol", "sharpe", F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"))


def turnover(positions: DataFrame, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """``keys, turnover``: mean over trades after the first of the sum of absolute weight changes."""
    dates = positions.select(*keys, "date").distinct()
    dates = dates.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    now = positions.join(dates, [*keys, "date"]).select(*keys, "_k", "asset_id", "weight")
    after = now.select(*keys, (F.col("_k") + 1).alias("_k"), "asset_id", (-F.col("weight")).alias("weight"))
    change = now.unionByName(after).groupBy(*keys, "_k", "asset_id").agg(F.abs(F.sum("weight")).alias("d"))
    step = change.groupBy(*keys, "_k").agg(F.sum("d").alias("d"))
    last = dates.groupBy(*keys).agg(F.max("_k").alias("_last"))
    step = step.join(last, list(keys)).where("_k > 1 and _k <= _last")
    return last.join(step.groupBy(*keys).agg(F.avg("d").alias("turnover")), list(keys), "left").select(*keys, F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def moments(returns: DataFrame, keys: tuple[str, ...] = ("scenario",), col: str = "net") -> DataFrame:
    """``keys, n, mean, std, skew, kurt``: bias-corrected skewness and excess kurtosis (NULL where the
    rows are too few)."""
    out = returns.groupBy(*keys).agg(F.count(col).cast("double").alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.skewness(col).alias("_g1"), F.kurtosis(col).alias("_g2"))
    n = F.col("n")
    skew = F.when(n >= 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.col("_g1"))
    kurt = F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_g2") + 6))
    return out.select(*keys, n.cast("long").alias("n"), "mean", "std", skew.alias("skew"), kurt.alias("kurt"))


def newey_west(returns: DataFrame, lags: int, keys: tuple[str, ...] = ("scenario",), col: str = "net") -> DataFrame:
    """``keys, t``: t-statistic of the mean under Bartlett-weighted autocovariances up to ``lags``."""
    whole, line = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date")
    e = returns.withColumn("_m", F.avg(col).over(whole)).withColumn("_e", F.col(col) - F.col("_m"))
    e = e.select(*keys, "_m", "_e", *[F.lag("_e", k).over(line).alias(f"_l{k}") for k in range(1, lags + 1)])
    var = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        var = var + F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)) * (2 * (1 - k / (lags + 1)))
    out = e.groupBy(*keys).agg(F.first("_m").alias("_m"), F.count(F.lit(1)).alias("_n"), var.alias("_v"))
    return out.select(*keys, F.when(F.col("_v") > 0, F.col("_m") * F.col("_n") / F.sqrt(F.greatest("_v", F.lit(1e-300)))).alias("t"))


def subperiods(returns: DataFrame, parts: int = 3, keys: tuple[str, ...] = ("scenario",), col: str = "net") -> DataFrame:
    """``keys, part, sharpe`` of as many runs of dates, the longer ones first."""
    cut = returns.withColumn("part", F.ntile(parts).over(Window.partitionBy(*keys).orderBy("date")))
    return cut.groupBy(*keys, "part").agg(sharpe(col).alias("sharpe"))
