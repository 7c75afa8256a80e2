import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import OPERATORS, timeseries
from chronoframe.plans.compiler import compile_signal, describe_signal, fields_of
from chronoframe.queries import MOMENTUM, node, spec_of

DAYS = [dt.date(2021, 1, 1) + dt.timedelta(days=k) for k in range(10)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(d, a, x) for k, d in enumerate(DAYS) for a, x in (("A", k + 1.0), ("B", 10.0 * (k + 1)), ("C", 100.0 - 10 * k))]
    df = spark.createDataFrame(rows, "date date, asset_id string, x double")
    g = F.when(F.col("asset_id") == "C", "g2").otherwise("g1")
    return df.withColumn("sector", g).withColumn("y", F.when(F.col("asset_id") == "A", F.col("x") * 10).otherwise(-F.col("x"))).persist()


def value(frame, op, *inputs, at=9, asset="A", **params):
    names = {k: [f"{k}{i}" for i in range(len(v))] if isinstance(v, list) else v if isinstance(v, str) else k for k, v in params.items()}
    flat = {n: x for k, v in params.items() if not isinstance(v, str) for n, x in (zip(names[k], v) if isinstance(v, list) else [(k, v)])}
    out = compile_signal(spec_of([node("s", op, *(inputs or ("x",)), **names)], flat), frame)
    return out.where((F.col("date") == DAYS[at]) & (F.col("asset_id") == asset)).first()["signal"]


@pytest.mark.parametrize(
    "op, params, at, want",
    [
        ("lag", {"n": 2}, 5, 4.0),
        ("diff", {"n": 2}, 5, 2.0),
        ("pct_change", {"n": 2}, 5, 0.5),
        ("rolling_mean", {"n": 3}, 5, 5.0),
        ("rolling_std", {"n": 3}, 5, 1.0),
        ("rolling_sum", {"n": 3}, 5, 15.0),
        ("rolling_max", {"n": 3}, 5, 6.0),
        ("rolling_min", {"n": 3}, 5, 4.0),
        ("rolling_zscore", {"n": 3}, 5, 1.0),
        ("rolling_rank", {"n": 3}, 5, 1.0),
        ("ewm", {"halflife": 1}, 2, (3 + 1 + 0.25) / 1.75),
        ("rolling_vol", {"n": 3}, 5, math.sqrt(252)),
        ("cs_rank", {}, 0, 1 / 3 - 0.5),
        ("cs_demean", {}, 0, -36.0),
        ("cs_zscore", {}, 0, -36 / math.sqrt(2997)),
        ("cs_winsorize", {"k": 0.5}, 0, 37 - 0.5 * math.sqrt(2997)),
        ("cs_neutralize", {"group": "sector"}, 0, -4.5),
        ("cs_scale", {}, 0, 1 / 111),
        ("log", {}, 0, 0.0),
        ("neg", {}, 0, -1.0),
        ("abs", {}, 0, 1.0),
        ("sign", {}, 0, 1.0),
        ("clip", {"lo": 2, "hi": 3}, 0, 2.0),
        ("clip", {"lo": 5, "hi": 3}, 0, 3.0),
    ],
)
def test_known_values(frame, op, params, at, want):
    assert value(frame, op, at=at, **params) == pytest.approx(want)


def test_two_and_three_inputs(frame):
    assert value(frame, "rolling_beta", "y", "x", n=3) == pytest.approx(10)
    assert value(frame, "rolling_corr", "x", "y", asset="C", n=3) == pytest.approx(-1)
    assert value(frame, "add", "x", "y", at=1) == 22 and value(frame, "sub", "x", "y", at=1) == -18
    assert value(frame, "mul", "x", "y", at=1) == 40 and value(frame, "div", "x", "y", at=1) == 0.1
    assert value(frame, "where", "x", "y", "x", at=1) == 20
    assert value(frame, "combine", "x", "y", at=1, weights=[0.5, 2.0]) == 41


def test_warm_up_and_missing_values(spark, frame):
    assert value(frame, "rolling_mean", at=1, n=3) is None and value(frame, "lag", at=1, n=2) is None
    rows = [(DAYS[k], "A", x) for k, x in enumerate([1.0, None, 0.0, -2.0, float("inf"), 3.0])]
    df = spark.createDataFrame(rows, "date date, asset_id string, x double")
    get = lambda op, at, *i, **p: value(df, op, *i, at=at, **p)
    assert get("log", 2) == -math.inf and get("log", 3) is None and get("log", 1) is None
    assert get("div", 3, "x", "x") == 1 and get("div", 2, "x", "x") is None
    assert get("pct_change", 3, n=1) == -math.inf  # -2 / 0, less one
    assert get("clip", 1, lo=0, hi=1) is None and get("where", 1, "x", "x", "x") is None
    assert get("rolling_sum", 4, n=1) is None and get("rolling_std", 5, n=1) is None
    assert get("cs_winsorize", 0, k=1) == 1.0 and get("cs_scale", 2) == 0.0
    assert get("ewm", 1, halflife=1) == 1.0  # carried over the gap


@pytest.mark.parametrize("block", [60, 400])
def test_ewm_and_rank_against_pandas(spark, monkeypatch, block):
    monkeypatch.setattr(timeseries, "EWM_BLOCK", block)
    rng = random.Random(3)
    x = [None if rng.random() < 0.2 else float(rng.randint(0, 6)) for _ in range(60)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    df = spark.createDataFrame(list(zip(days, ["A"] * 60, x)), "date date, asset_id string, x double")
    s = pd.Series(x, dtype=float)
    for h in (0.5, 3.0):
        got = compile_signal(spec_of([node("s", "ewm", "x", halflife="h")], {"h": h}), df).orderBy("date").toPandas()["signal"]
        assert np.allclose(got, s.ewm(halflife=h).mean(), equal_nan=True, rtol=1e-12 if block > 60 else 1e-9)
    got = compile_signal(spec_of([node("s", "rolling_rank", "x", n="n")], {"n": 5}), df).orderBy("date").toPandas()["signal"]
    assert np.allclose(got.astype(float), s.rolling(5).apply(lambda w: pd.Series(w).rank(pct=True).iloc[-1]), equal_nan=True)


def test_cs_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(DAYS[0], k, x) for k, x in enumerate([1.0, 2.0, 2.0, None, 5.0])], "date date, asset_id long, x double")
    got = [r["signal"] for r in compile_signal(spec_of([node("s", "cs_rank", "x")]), df).orderBy("asset_id").collect()]
    want = [None if pd.isna(v) else v for v in pd.Series([1, 2, 2, None, 5]).rank(pct=True) - 0.5]
    assert got == want


def test_no_operator_looks_ahead(spark):
    rng = random.Random(4)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    rows = [(d, a, rng.random(), rng.random(), "g", "c", "r") for d in days for a in "ABC"]
    df = spark.createDataFrame(rows, "date date, asset_id string, x double, y double, sector string, country string, region string").persist()
    early = df.where(F.col("date") <= F.lit(days[19]))
    for name, op in OPERATORS.items():
        params, values = {}, {}
        for p, kind in op.params.items():
            params[p] = "sector" if kind.startswith("choice") else ["w", "w"] if kind == "numbers" else "w"
            values["w"] = 3.0
        spec = spec_of([node("s", name, *["x", "y", "x"][: op.inputs or 2], **params)], values)
        full = compile_signal(spec, df).where(F.col("date") <= F.lit(days[19])).select("date", "asset_id", "signal")
        part = compile_signal(spec, early).select("date", "asset_id", "signal")
        assert full.exceptAll(part).count() == 0, name


def test_plan_shares_work(frame):
    spec = spec_of([node("a", "rolling_mean", "x", n="n"), node("b", "rolling_mean", "x", n="n"), node("c", "sub", "a", "b"), node("dead", "cs_rank", "x"), node("e", "add", "c", "c")], {"n": 3})
    out = compile_signal(spec, frame.select("date", "asset_id", "x"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("avg(") == 1 and "rank" not in plan
    assert fields_of(spec) == {"x"} and out.columns == ["date", "asset_id", "x", "signal"]
    with pytest.raises(KeyError):
        compile_signal(MOMENTUM, frame)


def test_description():
    assert describe_signal(MOMENTUM) == "1. Compute n1: apply pct_change to close, where n is 5.\n2. Compute n2: apply cs_zscore to n1.\n3. Compute n3: apply cs_winsorize to n2, where k is 3.\nThe signal is n3, taken with its sign turned."
    spec = spec_of([node("n1", "combine", "a", "b", weights=["u", "v"])], {"u": 0.6, "v": 0.4})
    assert "n1: apply combine to a and b, where weights is 0.6 and 0.4." in describe_signal(spec)
    assert len(OPERATORS) == 31
