import datetime as dt
import random

import pytest

from chronoframe.plans.portfolio import construct_weights
from chronoframe.plans.spec import Threshold
from chronoframe.queries import book

DAY = dt.date(2020, 1, 6)


def weights(spark, signals, portfolio, **extra):
    rows = [(DAY, k, None if s is None else float(s), *[v[k] for v in extra.values()]) for k, s in enumerate(signals)]
    kinds = {"vol": "double", "beta": "double", "sector": "string", "country": "string"}
    df = spark.createDataFrame(rows, "date date, asset_id long, signal double" + "".join(f", {c} {kinds[c]}" for c in extra))
    return {r["asset_id"]: r["weight"] for r in construct_weights(df, portfolio).collect()}


def filled(sizes, target, cap):
    """Scale, cut at the cap, share the rest: one round after another."""
    left, out = dict(sizes), {}
    while left:
        total = sum(left.values())
        goal = target - cap * len(out)
        scaled = {k: goal / len(left) if total <= 0 else v * goal / total for k, v in left.items()}
        over = [k for k, v in scaled.items() if v > cap + 1e-9]
        if not over:
            return {**out, **scaled}
        for k in over:
            out[k] = cap
            del left[k]
    return out


@pytest.mark.parametrize("weighting", ["equal", "rank", "signal"])
@pytest.mark.parametrize("construction", ["long_short_quantile", "top_n_bottom_n", "threshold", "rank_weighted", "long_only_quantile"])
def test_gross_and_net_are_exact(spark, construction, weighting):
    rng = random.Random(1)
    s = [rng.gauss(0, 1) for _ in range(100)]
    p = book(construction=construction, weighting=weighting, n=10, threshold=Threshold(lo=-1.0, hi=1.0), gross_leverage=1.5, net_exposure=1.5 if construction == "long_only_quantile" else 0.3)
    w = weights(spark, s, p).values()
    assert sum(map(abs, w)) == pytest.approx(1.5) and sum(w) == pytest.approx(1.5 if construction == "long_only_quantile" else 0.3)


def test_cap_against_rounds(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for d in range(60):
        day = DAY + dt.timedelta(days=d)
        n = rng.randint(2, 9)
        s = [rng.choice([0.5, 1.0, rng.paretovariate(0.7)]) for _ in range(n)]
        s += [-x for x in s]
        got = {k: x for k, x in enumerate(s)}
        for sign in (1, -1):
            leg = {k: abs(x) for k, x in got.items() if x * sign > 0}
            for k, v in filled(leg, 0.5, 0.3).items():
                want[(day, k)] = sign * v
        rows += [(day, k, x) for k, x in got.items()]
    df = spark.createDataFrame(rows, "date date, asset_id long, signal double")
    p = book(construction="threshold", threshold=Threshold(lo=0.0, hi=0.0), weighting="signal", max_position=0.3)
    got = {(r["date"], r["asset_id"]): r["weight"] for r in construct_weights(df, p).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_selection_details(spark):
    assert set(weights(spark, [5, 4, 4, 3, 2, 1, 0], book(quantile=0.2))) == {0, 6}  # round(1.4) names
    assert set(weights(spark, [1.0, 1.0, 1.0, 1.0], book(construction="top_n_bottom_n", n=1))) == {0, 3}  # ties by id
    assert weights(spark, [None, None], book()) == {}
    w = weights(spark, [3, 2, 1, 0, -1, -2], book(quantile=0.5, weighting="vol_scaled"), vol=[1.0, 2.0, 4.0, 1.0, 1.0, 1.0])
    assert w[0] == pytest.approx(0.5 * 4 / 7) and w[2] == pytest.approx(0.5 / 7)
    w = weights(spark, [2.0, 0.0, -1.0], book(construction="top_n_bottom_n", n=1, weighting="signal"))
    assert w == {0: 0.5, 2: -0.5}
    w = weights(spark, [1.0, 2.0, 3.0], book(construction="rank_weighted"))
    assert w[0] == pytest.approx(-0.5) and w[2] == pytest.approx(0.5 * 3 / 4)


def test_neutralisation(spark):
    s = [10.0 - k for k in range(10)]
    w = weights(spark, s, book(quantile=0.4, neutralize=["sector"]), sector=["a", "b"] * 5)
    for g in (0, 1):
        assert sum(v for k, v in w.items() if k % 2 == g) == pytest.approx(0)
    beta = [1 + k / 10 for k in range(10)]
    w = weights(spark, s, book(quantile=0.4, neutralize=["beta"]), beta=beta)
    assert sum(v * beta[k] for k, v in w.items()) == pytest.approx(0)
    flat = weights(spark, s, book(neutralize=["beta"]), beta=[0.0] * 10)
    assert flat == weights(spark, s, book())


@pytest.mark.parametrize(
    "signals, portfolio, extra",
    [
        ([1.0], book(), {}),
        ([1.0, 2.0, 3.0], book(construction="top_n_bottom_n", n=2), {}),
        ([1.0, 2.0], book(max_position=0.2), {}),
        ([1.0, 2.0], book(weighting="vol_scaled"), {"vol": [None, 1.0]}),
        ([1.0, 2.0], book(neutralize=["sector"]), {"sector": [None, "a"]}),
    ],
)
def test_data_errors(spark, signals, portfolio, extra):
    with pytest.raises(Exception, match="USER_RAISED|share names|reach|missing"):
        weights(spark, signals, portfolio, **extra)


@pytest.mark.parametrize("bad", [book(net_exposure=2.0), book(construction="top_n_bottom_n"), book(construction="top_n_bottom_n", n=0), book(weighting="vol_scaled"), book(neutralize=["country"]), book(construction="threshold", threshold=Threshold(lo=1.0, hi=0.0)), book(quantile=None)])
def test_plan_errors(spark, bad):
    with pytest.raises(ValueError):
        weights(spark, [1.0, 2.0], bad)
