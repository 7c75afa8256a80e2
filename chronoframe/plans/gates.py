"""Thirteen ordered gates over backtest results. Spark aggregates the series; what is left for the driver
is a handful of numbers and one small linear system."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pearson
from . import metrics
from .backtest import Result

# Fixed values: (fail, warn) of each gate. A value on the bad side of a bound has its status.
LOW = {"G1_turnover_cost": (0.5, 0.7), "G2_replication": (0.5, 0.75), "G3_significance": (2.0, 3.0), "G4_deflated_sharpe": (0.90, 0.95), "G5_out_of_sample": (0.0, 0.5), "G6_subperiods": (2.0, None), "G8_capacity": (0.5, 0.75), "G9_factor_residual": (1.5, 2.0), "G11_assumptions": (0.5, 0.75), "G12_parameters": (0.5, 0.75)}
HIGH = {"G7_drawdown": (3.0, 2.0), "G10_factor_loading": (0.5, 0.3), "G13_orthogonality": (0.7, 0.5)}
CAPACITY_MULTIPLE = 5
EULER = 0.5772156649015329


@dataclass(frozen=True)
class GateRow:
    name: str
    value: float | None
    threshold: float
    status: str


def judge(name: str, value: float | None) -> GateRow:
    """pass, warn or fail by strict comparison; a value that is missing fails."""
    fail, warn = LOW.get(name) or HIGH[name]
    sign = 1 if name in LOW else -1
    if value is None or math.isnan(value):
        return GateRow(name, None, fail, "fail")
    status = "fail" if sign * value < sign * fail else "warn" if warn is not None and sign * value < sign * warn else "pass"
    return GateRow(name, float(value), fail, status)


def _one(returns: DataFrame, scenario: str | None) -> DataFrame:
    return returns if scenario is None else returns.where(F.col("scenario") == scenario)


def sharpe_of(returns: DataFrame, col: str = "net") -> float:
    return returns.agg(metrics.sharpe(col).alias("s")).first()["s"] or 0.0


def expected_max_sharpe(trials: int, n: int) -> float:
    """What the best of as many worthless trials is expected to reach, a period."""
    if trials <= 1 or n < 1:
        return 0.0
    q = NormalDist().inv_cdf
    return math.sqrt(1 / n) * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * math.e)))


def deflated_sharpe(returns: DataFrame, trials: int) -> float | None:
    """Probability that the per-period Sharpe exceeds that of the best of ``trials`` by luck."""
    m = metrics.moments(returns.withColumn("scenario", F.lit("x"))).first()
    if m is None or not m["std"] or m["skew"] is None or m["kurt"] is None:
        return None
    sr = m["mean"] / m["std"]
    spread = 1 - m["skew"] * sr + (m["kurt"] + 2) / 4 * sr * sr
    return NormalDist().cdf((sr - expected_max_sharpe(max(1, trials), m["n"])) * math.sqrt(m["n"] - 1) / math.sqrt(max(spread, 1e-12)))


def factor_regression(returns: DataFrame, factors: DataFrame, names: list[str], col: str = "net") -> dict[str, float] | None:
    """``alpha, alpha_t`` and each loading, by normal equations summed in one aggregate.

    Dates that lack any factor are left out, as are factors that do not vary. None where the rows do
    not suffice.
    """
    rows = returns.select("date", F.col(col).alias("_y")).join(factors.select("date", *names), "date").dropna()
    spread = rows.agg(*[F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(n) for n in names]).first()
    used = [n for n in names if spread[n] > 0]
    terms = [F.lit(1.0), *[F.col(n).cast("double") for n in used]]
    k = len(terms)
    sums = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]] + [F.sum(a * F.col("_y")) for a in terms] + [F.sum(F.col("_y") * F.col("_y")), F.count(F.lit(1))]
    got = [0.0 if v is None else float(v) for v in rows.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()]
    n = int(got[-1])
    if n <= k:
        return None
    xx, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = got[at]
            at += 1
    xy, yy = np.array(got[at : at + k]), got[at + k]
    inverse = np.linalg.pinv(xx)
    b = inverse @ xy
    var = max(yy - b @ xy, 0.0) / (n - k)
    error = math.sqrt(max(var * inverse[0, 0], 0.0))
    return {"alpha": float(b[0]), "alpha_t": float(b[0] / error) if error else math.inf * np.sign(b[0]) if b[0] else 0.0, **{m: 0.0 for m in names}, **{m: float(x) for m, x in zip(used, b[1:])}}


@dataclass
class GateContext:
    """What the gates look at besides the headline run."""

    replication: DataFrame
    oos: DataFrame
    capacity: DataFrame
    factors: DataFrame
    factor_names: list[str]
    trials: int
    reported_sharpe: float | None
    holding_period: int = 1
    assumption_sharpes: list[float] = field(default_factory=list)
    parameter_sharpes: list[float] = field(default_factory=list)
    other_claims: DataFrame | None = None  # claim_id, date, net
    strict_sign: bool = True


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def replication_ratio(replicated: float, reported: float | None) -> float:
    """The replicated Sharpe as a share of the reported one's size. A replication that loses money keeps its
    minus sign, also where the report did; unlike signs give a negative share, no report gives 0."""
    share = _ratio(replicated, abs(reported or 0.0))
    return -abs(share) if replicated * (reported or 0.0) < 0 else share


def _robust(sharpes: list[float], headline: float) -> float:
    return sum(s > 0.5 * headline for s in sharpes) / len(sharpes) if sharpes else 0.0


def correlations(net: DataFrame, others: DataFrame) -> DataFrame:
    """``claim_id, corr`` with every other claim of at least two common dates."""
    both = net.select("date", F.col("net").alias("_own")).join(others, "date")
    return both.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_own"), F.col("net")).alias("corr")).where("n >= 2").select("claim_id", "corr")


def gate_values(head: DataFrame, c: GateContext):
    """(name, value) of each gate in order, each worked out when it is asked for. With ``strict_sign`` a
    headline Sharpe of zero or less fails the ratio gates, whose ratios would mislead."""
    net, gross = sharpe_of(head), sharpe_of(head, "gross")
    guard = (lambda v: None if net <= 0 else v) if c.strict_sign else (lambda v: v)
    yield "G1_turnover_cost", guard(_ratio(net, gross))
    yield "G2_replication", replication_ratio(sharpe_of(c.replication), c.reported_sharpe)
    yield "G3_significance", metrics.newey_west(head.withColumn("scenario", F.lit("x")), max(1, c.holding_period)).first()["t"] if head.limit(1).count() else None
    yield "G4_deflated_sharpe", deflated_sharpe(head, max(1, c.trials))
    oos = sharpe_of(c.oos)
    yield "G5_out_of_sample", oos if oos < 0 else max(0.0, _ratio(oos, net))
    parts = metrics.subperiods(head.withColumn("scenario", F.lit("x")))
    yield "G6_subperiods", float(parts.where("sharpe > 0").count())
    m = metrics.summary(head.withColumn("scenario", F.lit("x"))).first()
    yield "G7_drawdown", _ratio(abs(m["max_drawdown"]), m["annualized_vol"]) if m else None
    yield "G8_capacity", guard(_ratio(sharpe_of(c.capacity), net))
    fit = factor_regression(head, c.factors, c.factor_names)
    yield "G9_factor_residual", fit and fit["alpha_t"]
    yield "G10_factor_loading", max((abs(fit[n]) for n in c.factor_names), default=0.0) if fit else None
    yield "G11_assumptions", guard(_robust(c.assumption_sharpes, net))
    yield "G12_parameters", guard(_robust(c.parameter_sharpes, net))
    worst = correlations(head, c.other_claims).agg(F.max(F.abs("corr"))).first()[0] if c.other_claims is not None else 0.0
    yield "G13_orthogonality", worst or 0.0


def run_gates(result: Result, context: GateContext, scenario: str | None = None) -> list[GateRow]:
    """Gate rows in order, up to and including the first that fails."""
    head, out = _one(result.returns, scenario).persist(), []
    try:
        for name, value in gate_values(head, context):
            out.append(judge(name, value))
            if out[-1].status == "fail":
                break
    finally:
        head.unpersist()
    return out
