"""The evidence pack as Markdown, eleven sections in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .compiler import describe_signal
from .spec import Spec


@dataclass
class Evidence:
    claim: dict
    spec: Spec
    headline: DataFrame
    oos: DataFrame
    positions: DataFrame
    gates: list
    sweeps: dict[str, float]
    factors: dict[str, float]
    critique: str
    manifests: dict
    trials: int


def grid(head: list[str], rows) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def _num(x, digits: int = 3) -> str:
    return "n/a" if x is None else f"{x:.{digits}f}"


def render(e: Evidence) -> str:
    """Numbers come from the aggregates below; each series is reduced to one row before it is read."""
    keyed = lambda df: df.withColumn("scenario", F.lit("x"))
    head = metrics.summary(keyed(e.headline)).first()
    oos = metrics.summary(keyed(e.oos)).first()
    turn = metrics.turnover(keyed(e.positions)).first()
    parts = metrics.subperiods(keyed(e.headline)).orderBy("part").collect()
    monthly = e.headline.groupBy(F.date_trunc("quarter", "date").cast("date").alias("q")).agg((F.product(1 + F.col("net")) - 1).alias("r")).orderBy("q").collect()
    c = e.claim
    sections = [
        ("Headline", "\n\n".join([f"**Claim:** {c['claim_id']}", f"**Source:** {', '.join(c['source_authors'])} ({c['source_year']}). {c['source_title']}.", f"**Edge:** {c['edge_statement']}", f"**Mechanism:** {c['mechanism']}", f"```\n{describe_signal(e.spec)}\n```"])),
        ("Verdict table", grid(["Metric", "Value"], [("Net Sharpe", _num(head and head["sharpe"])), ("OOS Sharpe", _num(oos["sharpe"] if oos else 0.0)), ("Max drawdown", _num(head and head["max_drawdown"])), ("Turnover", _num(turn["turnover"] if turn else 0.0, 4)), ("Trial count", e.trials)])),
        ("Gate table", grid(["Gate", "Value", "Threshold", "Status"], [(g.name, _num(g.value, 4), g.threshold, g.status) for g in e.gates])),
        ("Cumulative return", grid(["Quarter", "Net return"], [(r["q"], _num(r["r"], 4)) for r in monthly])),
        ("Assumptions and alternatives", grid(["ID", "Choice", "Source says", "Alternatives"], [(a.id, a.choice, a.source_says, ", ".join(map(str, a.alternatives))) for a in e.spec.assumptions])),
        ("Parameter sweep", grid(["Alternative", "Net Sharpe"], [(k.removeprefix("sweep:"), _num(v)) for k, v in sorted(e.sweeps.items())])),
        ("Factor decomposition", grid(["Factor", "Value"], [(k, _num(v, 4)) for k, v in e.factors.items()])),
        ("Sub-period table", grid(["Sub-period", "Net Sharpe"], [(r["part"], _num(r["sharpe"])) for r in parts])),
        ("Critique", e.critique),
        ("Provenance", f"**Trial count:** {e.trials}\n\n" + grid(["Stage", "Output", "sha256"], [(s, o.path, o.sha256) for s, m in sorted(e.manifests.items()) for o in m.outputs])),
        ("Decision", "\n\n".join(f"**{x}:** ____________" for x in ("Decision", "Conditions", "Reviewer", "Decided (UTC)"))),
    ]
    body = "\n".join(f"## {k}. {title}\n\n{text}\n" for k, (title, text) in enumerate(sections, 1))
    return f"# Evidence pack {c['claim_id']}\n\n{body}"
