import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.plans.backtest import Scenario, advance, calendar, panel_fields, rebalance_dates, run_backtest, run_backtests
from chronoframe.plans.spec import Costs, UniverseFilters
from chronoframe.queries import BY_ADV, FIXED, book, node, spec_of

NODES = [node("n1", "clip", "sig", lo="lo", hi="hi")]
WIDE = {"lo": -1e9, "hi": 1e9}


def bdays(n, start="2021-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def panel_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, "date date, asset_id string, sig double, ret_1d double" + extra)


def spec(portfolio=None, costs=FIXED, filters=None):
    return spec_of(NODES, WIDE, portfolio=portfolio or book(rebalance="daily"), costs=costs, filters=filters)


def walk(panel: pd.DataFrame, rebal, k, lag, q, spread, borrow):
    """A plain day-by-day account of the same rules."""
    days = sorted(panel["date"].unique())
    at = {d: i for i, d in enumerate(days)}
    cohorts, planned = [], {}
    for d in rebal:
        s = panel[(panel["date"] == d) & panel["sig"].notna()]
        if s.empty:
            continue
        n = max(1, round(q * len(s)))
        order = s.sort_values(["sig", "asset_id"], ascending=[False, True])["asset_id"].tolist()
        w = {**{a: 0.5 / n for a in order[:n]}, **{a: -0.5 / n for a in order[-n:]}}
        cohorts = (cohorts + [w])[-k:]
        names = set().union(*cohorts)
        if at[d] + lag < len(days):
            planned[days[at[d] + lag]] = {a: sum(c.get(a, 0) for c in cohorts) / len(cohorts) for a in names}
    ret = {(r.date, r.asset_id): r.ret_1d for r in panel.itertuples()}
    held, out, trades, positions = {}, {}, {}, {}
    for d in days:
        paid = 0.0
        if d in planned:
            new = planned[d]
            for a in set(new) | set(held):
                dw = new.get(a, 0) - held.get(a, 0)
                if abs(dw) > 1e-12:
                    trades[(d, a)] = dw
                    paid += abs(dw) * spread / 2 / 1e4
            held = new
            positions |= {(d, a): w for a, w in new.items()}
        gross = sum(w * (0 if pd.isna(ret.get((d, a), 0.0)) else ret.get((d, a), 0.0)) for a, w in held.items())
        cost = paid + sum(-w for w in held.values() if w < 0) * borrow / 1e4 / 252
        out[d] = (gross, gross - cost, cost)
    return positions, out, trades


@pytest.mark.parametrize("rebalance, k, lag", [("daily", 1, 1), ("weekly", 3, 2), ("monthly", 2, 1)])
def test_against_a_day_by_day_account(spark, rebalance, k, lag):
    rng = random.Random(k)
    days = bdays(70, "2020-12-01")
    rows = []
    for d in days:
        for a in "ABCDEFGHIJKL":
            if rng.random() < 0.9:
                rows.append((d, a, None if rng.random() < 0.1 else rng.gauss(0, 1), None if rng.random() < 0.1 else rng.gauss(0, 0.02)))
    pdf = pd.DataFrame(rows, columns=["date", "asset_id", "sig", "ret_1d"])
    unit = {"daily": lambda d: d, "weekly": lambda d: d.isocalendar()[:2], "monthly": lambda d: (d.year, d.month)}[rebalance]
    first = {}
    for d in days:
        first.setdefault(unit(d), d)
    positions, returns, trades = walk(pdf, sorted(first.values()), k, lag, 0.2, 10.0, 50.0)
    r = run_backtest(spec(book(rebalance=rebalance, holding_period=k, execution_lag=lag, quantile=0.2)), panel_of(spark, rows))
    got = {(x["date"], x["asset_id"]): x["weight"] for x in r.positions.collect()}
    assert got.keys() == positions.keys() and all(got[i] == pytest.approx(positions[i]) for i in got)
    got = {(x["date"], x["asset_id"]): x["delta_weight"] for x in r.trades.collect()}
    assert got.keys() == trades.keys() and all(got[i] == pytest.approx(trades[i]) for i in got)
    got = {x["date"]: (x["gross"], x["net"], x["cost"]) for x in r.returns.collect()}
    assert got.keys() == returns.keys() and all(got[d] == pytest.approx(returns[d], abs=1e-12) for d in got)


def test_guards(spark):
    df = panel_of(spark, [(d, a, 1.0, 0.0) for d in bdays(3) for a in "AB"])
    with pytest.raises(ValueError, match="lag"):
        run_backtest(spec(book(execution_lag=0)), df)
    with pytest.raises(ValueError, match="ret_1d"):
        run_backtest(spec(), df.drop("ret_1d"))
    with pytest.raises(ValueError, match="adv_20"):
        run_backtest(spec(costs=BY_ADV), df)
    with pytest.raises(ValueError, match="holding"):
        run_backtest(spec(book(holding_period=0)), df)


def test_perfect_foresight_needs_lag_zero(spark):
    rng = random.Random(1)
    rows = []
    for d in bdays(60):
        for a in "ABCDEFGHIJ":
            r = rng.gauss(0, 0.02)
            rows.append((d, a, r, r))
    df = panel_of(spark, rows)
    free = Costs(spread_model="fixed_bps", spread_bps=0.0, impact_model="none", impact_coeff=0.0, borrow_bps_annual=0.0)
    wins = run_backtest(spec(book(rebalance="daily", execution_lag=0), free), df, replication=True).returns.where("gross > 0").count()
    later = run_backtest(spec(book(rebalance="daily"), free), df).returns.where("gross > 0").count()
    assert wins > 57 and later < 45


def test_liquidation_is_priced_at_the_last_known_values(spark):
    days = bdays(10)
    rows = []
    for i, d in enumerate(days):
        for k in range(6):
            if k or i < 5:
                rows.append((d, f"A{k}", float(6 - k), 0.0, 1e6 / 50 * (1 + (k == 0)), 50.0, "US"))
    df = panel_of(spark, rows, ", adv_20 double, close double, region string")
    r = run_backtest(spec(book(rebalance="daily"), BY_ADV), df)
    sold = r.trades.where("asset_id = 'A0' and delta_weight < 0").collect()
    assert len(sold) == 1 and sold[0]["date"] == days[6]
    assert sold[0]["cost_bps"] == pytest.approx(6.0 + 0.1 * math.sqrt(0.5 * 5e6 / 2e6) * 1e4)
    bought = r.trades.where("asset_id = 'A5'").first()
    assert bought["cost_bps"] == pytest.approx(12.5 + 0.1 * math.sqrt(0.5 * 5e6 / 1e6) * 1e4)


def test_adv_warm_up_and_filters(spark):
    rows = [(d, f"A{k}", float(k), 0.0, None if i < 3 else 100.0 * k, 5.0 + k, "x" if k == 7 else None) for i, d in enumerate(bdays(8)) for k in range(8)]
    df = panel_of(spark, rows, ", adv_20 double, close double, sector string")
    assert run_backtest(spec(), df).positions.select("date").distinct().count() == 7
    some = run_backtest(spec(filters=UniverseFilters(min_adv_20=200.0)), df).positions
    assert some.agg(F.min("date")).first()[0] == bdays(8)[4] and some.where("asset_id < 'A2'").count() == 0
    assert run_backtest(spec(filters=UniverseFilters(exclude_sectors=["x"])), df).positions.where("asset_id = 'A7'").count() == 0
    assert run_backtest(spec(filters=UniverseFilters(min_price=8.0)), df).positions.where("asset_id < 'A3'").count() == 0
    aged = run_backtest(spec(filters=UniverseFilters(min_history_days=4, require_fields=["adv_20"])), df, keep_history=True).positions
    assert aged.agg(F.min("date")).first()[0] == bdays(8)[4]


def test_scenarios_share_one_job_and_differ(spark):
    rng = random.Random(5)
    rows = [(d, a, rng.gauss(0, 1), rng.gauss(0, 0.01), 1e6, 50.0, "EU") for d in bdays(30) for a in "ABCDEF"]
    df = panel_of(spark, rows, ", adv_20 double, close double, region string").persist()
    s = spec(costs=BY_ADV)
    runs = [Scenario("a"), Scenario("big", aum=2.5e7), Scenario("narrow", {"lo": -0.1, "hi": 0.1})]
    got = run_backtests(s, df, runs)
    cost = {r["scenario"]: r["c"] for r in got.returns.groupBy("scenario").agg(F.sum("cost").alias("c")).collect()}
    assert cost["big"] > cost["a"] and got.returns.count() == 90
    alone = run_backtests(s, df, [Scenario("narrow", {"lo": -0.1, "hi": 0.1})])
    assert got.positions.where("scenario = 'narrow'").exceptAll(alone.positions).count() == 0
    assert panel_fields(s) == {"sig", "ret_1d", "adv_20", "close", "region"}


def test_calendar_helpers(spark):
    df = panel_of(spark, [(d, "A", 1.0, 0.0) for d in bdays(30, "2020-12-28")])
    cal = calendar(df)
    weekly = [r["date"] for r in rebalance_dates(cal, "weekly").orderBy("date").collect()]
    assert weekly[:2] == [dt.date(2020, 12, 28), dt.date(2021, 1, 4)]
    monthly = [r["date"] for r in rebalance_dates(cal, "monthly").orderBy("date").collect()]
    assert monthly == [dt.date(2020, 12, 28), dt.date(2021, 1, 1), dt.date(2021, 2, 1)]
    far = advance(cal, cal.select("date"), 28).orderBy("date").collect()
    assert len(far) == 2


def test_empty_panel(spark):
    df = panel_of(spark, [])
    r = run_backtest(spec(), df)
    assert r.positions.count() == r.returns.count() == r.trades.count() == 0
