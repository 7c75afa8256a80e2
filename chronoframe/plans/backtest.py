"""Backtests as one set-based plan over scenarios, dates and assets.

No date is looped over. The calendar and the rebalances (a row for each date) are joined by broadcast,
which their number of dates bounds; how tables with a row for each scenario and date are joined is left to
their size at run time, as are panels and holdings, joined on (date, asset) or (rebalance, asset).

Timing: weights of a rebalance date trade ``execution_lag`` calendar rows later and earn that date's own
return. They do not drift until the next trade. Dates before the first trade have zero returns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import DEFAULT_COSTS, RegionCosts
from .compiler import compile_signal, fields_of
from .costs import trade_cost_bps
from .portfolio import construct_weights
from .spec import Spec

TARGET_AUM = 5_000_000.0
TRADING_DAYS = 252
SIGNIFICANT = 1e-12


class Result(NamedTuple):
    """Lazy tables over cohort and held weights, which are persisted once something reads them (to disk
    where memory is short; lost blocks are computed again) and freed by ``release``."""

    positions: DataFrame  # scenario, date, asset_id, weight
    returns: DataFrame  # scenario, date, gross, net, cost
    trades: DataFrame  # scenario, date, asset_id, delta_weight, cost_bps
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


@dataclass(frozen=True)
class Scenario:
    """One run: other parameter values, or another book size."""

    name: str
    params: dict[str, float] = field(default_factory=dict)
    aum: float = TARGET_AUM


def calendar(panel: DataFrame) -> DataFrame:
    """``date, idx`` of all panel dates (few rows, so one ordered partition)."""
    return panel.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")))


def rebalance_dates(cal: DataFrame, rebalance: str) -> DataFrame:
    """First calendar date of every day, ISO week or month."""
    if rebalance == "daily":
        return cal
    unit = {"weekly": "week", "monthly": "month"}[rebalance]
    return cal.groupBy(F.date_trunc(unit, "date").alias("_u")).agg(F.min("date").alias("date"), F.min("idx").alias("idx")).drop("_u")


def advance(cal: DataFrame, dates: DataFrame, n: int) -> DataFrame:
    """``dates(date)`` with ``trade_date``, n calendar rows later; dates without one go."""
    later = cal.select((F.col("idx") - n).alias("idx"), F.col("date").alias("trade_date"))
    return dates.join(F.broadcast(cal), "date").join(F.broadcast(later), "idx").select("date", "trade_date")


def eligible(panel: DataFrame, spec: Spec, keep_history: bool = False) -> Column:
    """The universe filters; a filter of 0, or one whose field the panel lacks, lets all names pass.

    ADV must be known where costs depend on it. ``keep_history`` also applies min_history_days and
    require_fields, which are otherwise only declared.
    """
    f, cols, out = spec.universe.filters, panel.columns, F.lit(True)
    adv_based = spec.costs.spread_model == "adv_based"

    def least(name: str, value: float) -> Column:
        return F.col(name).isNotNull() & (F.col(name) >= value)

    if f.min_mktcap > 0 and "mktcap" in cols:
        out &= least("mktcap", f.min_mktcap)
    if "adv_20" in cols and (f.min_adv_20 > 0 or adv_based):
        out &= least("adv_20", f.min_adv_20)
    elif adv_based and "adv_20" not in cols:
        raise ValueError("adv_based costs need adv_20 in the panel")
    if f.min_price > 0 and "close" in cols:
        out &= least("close", f.min_price)
    if f.exclude_sectors and "sector" in cols:
        out &= ~F.coalesce(F.col("sector").isin(f.exclude_sectors), F.lit(False))
    if keep_history:
        for name in f.require_fields:
            out &= F.col(name).isNotNull()
        if f.min_history_days:
            out &= F.col("_age") >= f.min_history_days
    return out


def _signals(spec: Spec, panel: DataFrame, scenarios: list[Scenario], keep_history: bool) -> DataFrame:
    """Signals of all scenarios, one column each on one pass over the panel, then as rows."""
    df = panel
    if keep_history and spec.universe.filters.min_history_days:
        df = df.withColumn("_age", F.row_number().over(Window.partitionBy("asset_id").orderBy("date")))
    names = []
    made: dict[str, str] = {}
    for k, s in enumerate(scenarios):
        shape = repr(sorted(s.params.items()))
        if shape not in made:
            made[shape] = f"_signal_{k}"
            df = compile_signal(spec.with_params(**s.params), df, name=made[shape])
        names.append((s.name, made[shape]))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(c).alias("signal")) for n, c in names]))
    extra = [c for c in ("sector", "country", "vol", "beta") if c in panel.columns]
    ok = eligible(df, spec, keep_history).alias("_ok")
    return df.select("date", "asset_id", *extra, ok, each.alias("_e")).where("_ok").select("date", "asset_id", *extra, "_e.scenario", "_e.signal").where("signal is not null")


def held_weights(weights: DataFrame, rebal: DataFrame, holding: int, lag: int, last: int) -> DataFrame:
    """``scenario, trade, idx, asset_id, weight``: the mean of the last ``holding`` cohorts at each
    rebalance that still has a trade date. ``trade`` counts them from 1."""
    days = weights.select("scenario", "date").distinct().join(F.broadcast(rebal), "date")
    days = days.withColumn("seq", F.row_number().over(Window.partitionBy("scenario").orderBy("idx")))
    cohort = weights.join(days.select("scenario", "date", "seq"), ["scenario", "date"])
    span = F.explode(F.sequence(F.col("seq"), F.col("seq") + (holding - 1))).alias("trade")
    spread = cohort.select("scenario", "asset_id", "weight", span)
    at = days.select("scenario", F.col("seq").alias("trade"), (F.col("idx") + lag).alias("idx")).where(F.col("idx") <= last)
    spread = spread.join(at, ["scenario", "trade"])
    return spread.groupBy("scenario", "trade", "idx", "asset_id").agg((F.sum("weight") / F.least(F.col("trade"), F.lit(holding))).alias("weight"))


def last_known(panel: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """``asked(asset_id, idx)`` with the newest value of each field at or before ``idx``.

    Both sides go through one window by asset (an as-of join without a range condition), so names that
    have left the panel keep their last values.
    """
    known = panel.select("asset_id", "idx", F.lit(0).alias("_q"), *fields)
    wanted = asked.select("asset_id", "idx").distinct().select("*", F.lit(1).alias("_q"), *[F.lit(None).cast(panel.schema[c].dataType).alias(c) for c in fields])
    w = Window.partitionBy("asset_id").orderBy("idx", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(wanted)
    return both.select("asset_id", "idx", "_q", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in fields]).where("_q = 1").drop("_q")


def run_backtests(spec: Spec, panel: DataFrame, scenarios: list[Scenario] | None = None, replication: bool = False, costs: dict[str, RegionCosts] | None = None, keep_history: bool = False) -> Result:
    """All scenarios in one job. The panel needs ``date, asset_id, ret_1d`` and what the spec reads."""
    scenarios = scenarios or [Scenario("base")]
    lag = spec.portfolio.execution_lag
    if lag < 0 or lag < 1 and not replication:
        raise ValueError("an execution_lag below 1 is for replication only")
    if "ret_1d" not in panel.columns:
        raise ValueError("the panel lacks ret_1d")
    if spec.portfolio.holding_period < 1:
        raise ValueError("holding_period must be at least 1")
    spark = panel.sparkSession
    days = sorted(r["date"] for r in panel.select("date").distinct().collect())  # a row for each date
    cal = spark.createDataFrame([(d, k) for k, d in enumerate(days, 1)], "date date, idx int").coalesce(1)
    rebal = rebalance_dates(cal, spec.portfolio.rebalance)
    last = len(days)
    book = spark.createDataFrame([(s.name, float(s.aum)) for s in scenarios], "scenario string, aum double").coalesce(1)

    signals = _signals(spec, panel, scenarios, keep_history).join(F.broadcast(rebal.select("date")), "date")
    weights = construct_weights(signals, spec.portfolio, ("scenario",)).persist()
    held = held_weights(weights, rebal, spec.portfolio.holding_period, lag, last).persist()

    by_idx = F.broadcast(cal)
    positions = held.join(by_idx, "idx").select("scenario", "date", "asset_id", "weight")

    # changes: what a trade sets less what the one before it had set
    turns = held.select("scenario", "trade", "idx").distinct()
    gone = held.select("scenario", (F.col("trade") + 1).alias("trade"), "asset_id", (-F.col("weight")).alias("weight"))
    moves = held.select("scenario", "trade", "asset_id", "weight").unionByName(gone)
    moves = moves.groupBy("scenario", "trade", "asset_id").agg(F.sum("weight").alias("delta_weight")).where(F.abs("delta_weight") > SIGNIFICANT)
    moves = moves.join(turns, ["scenario", "trade"]).join(book, "scenario")
    priced = [c for c in ("adv_20", "close", "region") if c in panel.columns]
    if spec.costs.spread_model == "adv_based" or spec.costs.impact_model == "sqrt":
        known = last_known(panel.join(by_idx, "date"), moves, priced)
        moves = moves.join(known, ["asset_id", "idx"], "left")
    have = set(moves.columns)
    adv = F.col("adv_20") * F.col("close") if {"adv_20", "close"} <= have else F.lit(None).cast("double")
    region = F.col("region") if "region" in have else F.lit(None).cast("string")
    bps = trade_cost_bps(spec.costs, F.col("delta_weight"), adv, region, costs or DEFAULT_COSTS, F.col("aum"))
    trades = moves.withColumn("cost_bps", bps).join(by_idx, "idx")

    # daily profit and loss: the trade in force on each date
    days = cal.select("*", F.explode(F.array(*[F.lit(s.name) for s in scenarios])).alias("scenario"))
    force = days.join(turns.select("scenario", "idx", "trade"), ["scenario", "idx"], "left")
    force = force.withColumn("trade", F.last("trade", ignorenulls=True).over(Window.partitionBy("scenario").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    rets = panel.select("date", "asset_id", "ret_1d").where("ret_1d is not null")
    earned = rets.join(force.where("trade is not null"), "date").join(held.drop("idx"), ["scenario", "trade", "asset_id"])
    gross = earned.groupBy("scenario", "date").agg(F.sum(F.col("weight") * F.col("ret_1d")).alias("gross"))
    paid = trades.groupBy("scenario", "date").agg(F.sum(F.abs("delta_weight") * F.col("cost_bps") / 1e4).alias("paid"))
    short = held.groupBy("scenario", "trade").agg(F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0.0)).alias("short"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = force.join(gross, ["scenario", "date"], "left").join(paid, ["scenario", "date"], "left").join(short, ["scenario", "trade"], "left")
    cost = zero("paid") + zero("short") * (spec.costs.borrow_bps_annual / 1e4 / TRADING_DAYS)
    returns = out.select("scenario", "date", zero("gross").alias("gross"), (zero("gross") - cost).alias("net"), cost.alias("cost"))
    return Result(positions, returns, trades.select("scenario", "date", "asset_id", "delta_weight", "cost_bps"), (weights, held))


def run_backtest(spec: Spec, panel: DataFrame, **options) -> Result:
    return run_backtests(spec, panel, **options)


def panel_fields(spec: Spec) -> set[str]:
    """Fields that a backtest of the spec reads."""
    f, out = spec.universe.filters, fields_of(spec) | {"ret_1d"}
    priced = spec.costs.spread_model == "adv_based" or spec.costs.impact_model == "sqrt"
    out |= {"adv_20", "close"} if priced else set()
    out |= {"region"} if spec.costs.spread_model == "adv_based" else set()
    out |= {n for n, v in (("mktcap", f.min_mktcap), ("adv_20", f.min_adv_20), ("close", f.min_price)) if v > 0}
    out |= {"sector"} if f.exclude_sectors else set()
    return out | {n for n in spec.portfolio.neutralize if n != "beta"}
