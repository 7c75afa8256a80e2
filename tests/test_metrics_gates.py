
import math


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.plans import gates, metrics
from chronoframe.plans.backtest import Result
from chronoframe.plans.gates import GateContext, deflated_sharpe, expected_max_sharpe, factor_regression, judge, replication_ratio, run_gates

DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=500)]


def series(spark, values, gross=None, name="x"):
    rows = [(name, d, float(v), float(v if gross is None else g)) for d, v, g in zip(DAYS, values, gross if gross is not None else values)]
    return spark.createDataFrame(rows, "scenario string, date date, net double, gross double")


def with_sharpe(target, n=500, seed=0):
    x = np.random.default_rng(seed).normal(size=n)
    x = (x - x.mean()) / x.std(ddof=1)
    return 0.01 * x + 0.01 * target / math.sqrt(252)


def test_summary_by_hand(spark):
    x = [0.1, -0.2, 0.05, 0.0]
    s = metrics.summary(series(spark, x)).first()
    growth = np.cumprod(1 + np.array(x))
    assert s["n"] == 4 and s["total_return"] == pytest.approx(growth[-1] - 1)
    assert s["annualized_return"] == pytest.approx(growth[-1] ** (252 / 4) - 1)
    assert s["annualized_vol"] == pytest.approx(np.std(x, ddof=1) * math.sqrt(252))
    assert s["max_drawdown"] == pytest.approx(-0.2)
    assert metrics.summary(series(spark, [-0.2, 0.1, 0.1])).first()["max_drawdown"] == 0  # from the first value on
    assert metrics.summary(series(spark, [0.1])).first()["sharpe"] == 0 == metrics.summary(series(spark, [0.5, 0.5])).first()["sharpe"]
    assert metrics.summary(series(spark, [-1.5, 0.0])).first()["annualized_return"] == 0
    assert metrics.summary(series(spark, [])).count() == 0


def test_turnover(spark):
    rows = [("x", DAYS[0], "A", 0.5), ("x", DAYS[0], "B", -0.5), ("x", DAYS[1], "A", 0.25), ("x", DAYS[2], "C", 1.0), ("y", DAYS[0], "A", 1.0)]
    df = spark.createDataFrame(rows, "scenario string, date date, asset_id string, weight double")
    got = {r["scenario"]: r["turnover"] for r in metrics.turnover(df).collect()}
    assert got == {"x": pytest.approx((0.75 + 1.25) / 2), "y": 0.0}


def test_moments_and_newey_west(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_t(4, 80) * 0.01
    m = metrics.moments(series(spark, x)).first()
    s = pd.Series(x)
    assert (m["skew"], m["kurt"]) == (pytest.approx(s.skew()), pytest.approx(s.kurt()))
    assert metrics.moments(series(spark, [0.1, 0.2])).first()["skew"] is None
    e = x - x.mean()
    for lags in (1, 5):
        v = (e**2).sum() + sum(2 * (1 - k / (lags + 1)) * (e[k:] * e[:-k]).sum() for k in range(1, lags + 1))
        assert metrics.newey_west(series(spark, x), lags).first()["t"] == pytest.approx(x.mean() * 80 / math.sqrt(v))
    parts = [r["sharpe"] for r in metrics.subperiods(series(spark, x)).orderBy("part").collect()]
    want = [p.mean() / p.std(ddof=1) * math.sqrt(252) for p in np.array_split(x, 3)]
    assert parts == pytest.approx(want)


@pytest.mark.parametrize("name, fail, warn, good", [("G1_turnover_cost", 0.49, 0.6, 0.8), ("G3_significance", 1.9, 2.5, 3.5), ("G4_deflated_sharpe", 0.8, 0.92, 0.97), ("G7_drawdown", 3.1, 2.5, 1.0), ("G10_factor_loading", 0.6, 0.4, 0.2), ("G13_orthogonality", 0.8, 0.6, 0.1), ("G6_subperiods", 1, None, 2)])
def test_both_sides_of_thresholds(name, fail, warn, good):
    assert judge(name, fail).status == "fail" and judge(name, good).status == "pass"
    assert warn is None or judge(name, warn).status == "warn"
    edge = (gates.LOW.get(name) or gates.HIGH[name])[0]
    assert judge(name, edge).status != "fail" and judge(name, None).status == "fail" == judge(name, float("nan")).status


def test_deflated_sharpe(spark):
    x = with_sharpe(2.0)
    one, many = deflated_sharpe(series(spark, x), 1), deflated_sharpe(series(spark, x), 200)
    sr, s = 2.0 / math.sqrt(252), pd.Series(x)
    want = 0.5 * (1 + math.erf(sr * math.sqrt(499) / math.sqrt(1 - s.skew() * sr + (s.kurt() + 2) / 4 * sr**2) / math.sqrt(2)))
    assert one == pytest.approx(want) and many < one
    assert expected_max_sharpe(1, 500) == 0 < expected_max_sharpe(10, 500) < expected_max_sharpe(100, 500)
    assert deflated_sharpe(series(spark, [0.1, 0.2]), 1) is None


def test_factor_regression_against_least_squares(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(0, 0.01, (200, 3))
    y = 0.001 + f @ [0.5, -0.2, 0.0] + rng.normal(0, 0.003, 200)
    names = ["market", "size", "flat"]
    fac = spark.createDataFrame([(d, *map(float, r[:2]), 1.0) for d, r in zip(DAYS, f)], "date date, market double, size double, flat double")
    got = factor_regression(series(spark, y), fac, names)
    x = np.column_stack([np.ones(200), f[:, :2]])
    b, res, *_ = np.linalg.lstsq(x, y, rcond=None)
    t = b[0] / math.sqrt(res[0] / 197 * np.linalg.inv(x.T @ x)[0, 0])
    assert (got["alpha"], got["market"], got["size"], got["flat"]) == (pytest.approx(b[0]), pytest.approx(b[1]), pytest.approx(b[2]), 0.0)
    assert got["alpha_t"] == pytest.approx(t)
    assert factor_regression(series(spark, y[:3]), fac, names) is None


def context(spark, **change):
    rng = np.random.default_rng(7)
    fac = spark.createDataFrame([(d, float(v)) for d, v in zip(DAYS, rng.normal(0, 0.01, 500))], "date date, market double")
    good = series(spark, with_sharpe(3.0, seed=3))
    base = dict(replication=good, oos=good, capacity=good, factors=fac, factor_names=["market"], trials=1, reported_sharpe=3.0, assumption_sharpes=[2.9, 3.1], parameter_sharpes=[2.9, 3.1])
    return GateContext(**{**base, **change})


def test_runner_order_and_stop(spark):
    head = series(spark, with_sharpe(3.0), with_sharpe(3.3))
    rows = run_gates(Result(head, head, head), context(spark))
    assert len(rows) == 13 and all(r.status != "fail" for r in rows)
    assert [int(r.name[1 : r.name.index("_")]) for r in rows] == list(range(1, 14))
    stopped = run_gates(Result(head, head, head), context(spark, reported_sharpe=-3.0))
    assert [r.status for r in stopped][-1] == "fail" and len(stopped) == 2
    others = head.select(F.lit("other").alias("claim_id"), "date", "net")
    assert run_gates(Result(head, head, head), context(spark, other_claims=others))[-1].status == "fail"
    loser = series(spark, with_sharpe(-2.0), with_sharpe(-1.0))
    assert run_gates(Result(loser, loser, loser), context(spark))[0].status == "fail"


def test_unstable_and_factor_driven_series_fail(spark):
    half = np.concatenate([with_sharpe(15.0, 160, 1), with_sharpe(-3.0, 340, 2)])
    ctx = context(spark, oos=series(spark, with_sharpe(1.0)))
    head = series(spark, half)
    assert {r.name: r.status for r in run_gates(Result(head, head, head), ctx)}["G6_subperiods"] == "fail"
    fac = ctx.factors.orderBy("date").toPandas()["market"].to_numpy()
    proxy = series(spark, 0.8 * fac + 0.0001)
    fit = factor_regression(proxy, ctx.factors, ["market"])
    assert judge("G10_factor_loading", abs(fit["market"])).status == "fail"



def test_replication_ratio_keeps_the_sign_of_a_loss():
    assert replication_ratio(1.5, 3.0) == 0.5 and replication_ratio(-1.5, 3.0) == -0.5
    assert replication_ratio(-2.0, -2.0) == -1.0 and judge("G2_replication", replication_ratio(-2.0, -2.0)).status == "fail"
    assert replication_ratio(2.0, -2.0) == -1.0 and replication_ratio(2.0, None) == replication_ratio(2.0, 0.0) == 0.0
