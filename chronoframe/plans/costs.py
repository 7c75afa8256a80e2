"""Trading costs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.catalog import RegionCosts
from .spec import Costs


def _error(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("double")


def spread_bps(c: Costs, adv: Column, region: Column, table: dict[str, RegionCosts]) -> Column:
    """Half the round-trip spread: fixed, or of the first bucket that holds the dollar volume."""
    if c.spread_model == "fixed_bps":
        if c.spread_bps is None:
            raise ValueError("fixed_bps needs spread_bps")
        return F.lit(c.spread_bps / 2)
    out = F.when(adv.isNull() | region.isNull(), _error("adv_based costs need a dollar volume and a region"))
    for name, costs in table.items():
        for b in costs.adv_buckets:
            fits = region == name if b.max_adv is None else (region == name) & (adv <= b.max_adv)
            out = out.when(fits, b.spread_bps / 2)
    return out.otherwise(_error("adv_based costs know no such region"))


def impact_bps(c: Costs, dollars: Column, adv: Column) -> Column:
    """Square-root impact of a trade's dollars against the dollar volume."""
    if c.impact_model == "none":
        return F.lit(0.0)
    root = F.sqrt(F.try_divide(F.abs(dollars), adv)) * (c.impact_coeff * 1e4)
    return F.when(adv.isNull() | (adv == 0), _error("sqrt impact needs a dollar volume")).otherwise(root)


def trade_cost_bps(c: Costs, delta_weight: Column, adv: Column, region: Column, table: dict[str, RegionCosts], aum: Column) -> Column:
    return spread_bps(c, adv, region, table) + impact_bps(c, F.abs(delta_weight) * aum, adv)
