"""Seven stages from a source text to an evidence pack, over a write-once store.

The model writes documents (a claim, a spec, code, a critique), never data. Every number comes from a
plan in this package, and every stage reads what came before through the store's hash check.
"""

from __future__ import annotations

import ast
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import pit
from ..sources.catalog import DEFAULT_COSTS, RegionCosts, fields_table, resolve_fields
from ..sources.store import Manifest, Stage, Store
from . import gates, metrics
from .backtest import TARGET_AUM, Result, Scenario, calendar, panel_fields, rebalance_dates, run_backtests
from .compiler import compile_signal, describe_signal
from .llm_client import Client, ParseError, call_info, structured
from .report import Evidence, render
from .spec import Spec, SpecError, Strict, validate_spec

MAX_RUNS = 3
MIN_NAMES, MAX_THIN_SHARE, MIN_REBALANCES = 30, 0.10, 24
ALLOWED_IMPORTS = {"pyspark", "math", "chronoframe"}


@dataclass(frozen=True)
class Claim(Strict):
    claim_id: str
    source_type: str
    source_title: str
    source_authors: list[str]
    source_year: int
    edge_statement: str
    mechanism: str
    predicted_sign: Literal[-1, 1]
    universe_description: str
    frequency: str
    horizon_days_lo: int
    horizon_days_hi: int
    required_fields: list[str]
    source_doi: str | None = None
    formula_latex: str | None = None
    formula_location: str | None = None
    reported_sharpe: float | None = None
    reported_period_start: str | None = None
    reported_period_end: str | None = None
    reported_gross: bool | None = None
    author_caveats: list[str] = field(default_factory=list)
    tradable: bool = True
    tradability_reason: str = ""


@dataclass(frozen=True)
class Critique(Strict):
    critique: str
    verdict: Literal["proceed", "revise", "reject"]


@dataclass
class Workbench:
    """What all stages of a run share."""

    store: Store
    root: str  # field tables
    catalogue: dict
    universes: dict
    client: Client
    prompts: dict[str, str]
    costs: dict[str, RegionCosts] = field(default_factory=lambda: DEFAULT_COSTS)
    universe: str = "all"
    start: str = ""
    end: str = ""
    min_names: int = MIN_NAMES
    min_rebalances: int = MIN_REBALANCES
    allow_code: bool = False

    @property
    def spark(self):
        return self.store.spark

    def panel(self, fields, start: str | None = None, end: str | None = None) -> DataFrame:
        return pit.load_panel(self.spark, self.root, sorted(fields), self.universe, start or self.start, end or self.end, self.catalogue, self.universes)


class Refused(RuntimeError):
    """The claim has had all its runs."""


class Halted(Exception):
    def __init__(self, manifest: Manifest):
        super().__init__(manifest.halt_reason)
        self.manifest = manifest


def source_text(path: str | Path) -> str:
    """A UTF-8 text source. PDFs need a reader that is not part of this package."""
    if str(path).endswith(".pdf"):
        raise RuntimeError("PDF sources are not read; convert them to text")
    return Path(path).read_text(encoding="utf-8")


def claim_text(c: Claim) -> str:
    lines = [f"# {c.source_title}", "", f"{', '.join(c.source_authors)} ({c.source_year})", "", c.edge_statement, "", c.mechanism, "", f"Predicted sign: {c.predicted_sign}", f"Fields: {', '.join(c.required_fields)}", f"Reported Sharpe: {c.reported_sharpe}", f"Tradable: {c.tradable} ({c.tradability_reason})"]
    return "\n".join(lines) + "\n"


def _ask(w: Workbench, stage: Stage, prompt: str, context: dict, read: Callable):
    """A question of a stage: noted for its manifest, its answers in the stage's log."""
    stage.llm = call_info(w.client, w.prompts[prompt])
    return structured(w.client, w.prompts[prompt], context, read, stage.folder / "llm_raw.jsonl")


def stage_claim(w: Workbench, stage: Stage, source: str) -> Claim:
    """Extract the claim, judge whether it can be traded, check that its fields exist."""
    try:
        got = _ask(w, stage, "extract", {"source": source, "fields": sorted(w.catalogue)}, lambda d: Claim.from_dict({**d, "claim_id": stage.claim_id}))
        verdict = _ask(w, stage, "tradability", got.to_dict(), lambda d: (bool(d["tradable"]), str(d["tradability_reason"])))
    except ParseError as e:
        raise Halted(stage.halt(f"unreadable answer: {e}")) from e
    claim = Claim.from_dict({**got.to_dict(), "tradable": verdict[0], "tradability_reason": verdict[1]})
    stage.write_text("claim.json", json.dumps(claim.to_dict(), indent=2))
    stage.write_text("claim.md", claim_text(claim))
    if not claim.tradable:
        raise Halted(stage.halt(f"not tradable: {claim.tradability_reason}"))
    if unknown := sorted(set(claim.required_fields) - set(w.catalogue)):
        raise Halted(stage.halt(f"unknown fields: {unknown}"))
    stage.complete()
    return claim


def stage_data(w: Workbench, stage: Stage, claim: Claim) -> None:
    """Resolve the fields, and see that enough names have all of them on enough dates."""
    need = w.spark.createDataFrame([(f,) for f in claim.required_fields], "field string")
    resolution = resolve_fields(need, fields_table(w.spark, w.catalogue))
    stage.write_table("resolution.parquet", resolution)
    missing = [r["field"] for r in resolution.where("not resolved").collect()]
    if missing:
        stage.write_text("unmet.jsonl", "".join(json.dumps({"claim_id": claim.claim_id, "field": f}) + "\n" for f in missing))
        raise Halted(stage.halt(f"unresolved fields: {missing}"))
    cover = pit.coverage(w.panel(claim.required_fields), claim.required_fields, least=w.min_names)
    stage.write_table("coverage.parquet", cover)
    thin = cover.agg(F.avg(F.col("below").cast("double"))).first()[0]
    if thin is None or thin > MAX_THIN_SHARE:
        raise Halted(stage.halt(f"coverage: under {w.min_names} names on {'all' if thin is None else f'{thin:.0%} of'} dates"))
    stage.complete()


def stage_spec(w: Workbench, stage: Stage, claim: Claim) -> Spec:
    """A valid spec with stated assumptions."""
    try:
        spec = _ask(w, stage, "spec", claim.to_dict(), lambda d: validate_spec(Spec.from_dict(d), set(w.catalogue)))
    except ParseError as e:
        raise Halted(stage.halt(f"no valid spec: {e}")) from e
    stage.write_text("spec.json", json.dumps(spec.to_dict(), indent=2))
    stage.write_text("signal.txt", describe_signal(spec))
    stage.write_text("assumptions.json", json.dumps([a.to_dict() for a in spec.assumptions], indent=2))
    stage.complete()
    return spec


def disallowed_imports(code: str) -> list[str]:
    found = set()
    for n in ast.walk(ast.parse(code)):
        if isinstance(n, ast.Import):
            found |= {a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            found.add((n.module or ".").split(".")[0] if not n.level else ".")
    return sorted(found - ALLOWED_IMPORTS)


def signals_match(a: DataFrame, b: DataFrame, rtol: float = 1e-9) -> bool:
    """Whether two ``date, asset_id, signal`` tables agree on every key, missing values included."""
    both = a.withColumnRenamed("signal", "_a").withColumn("_ha", F.lit(1)).join(b.withColumnRenamed("signal", "_b").withColumn("_hb", F.lit(1)), ["date", "asset_id"], "full")
    near = F.abs(F.col("_a") - F.col("_b")) <= rtol * F.greatest(F.abs("_a"), F.abs("_b")) + 1e-12
    same = F.col("_ha").isNotNull() & F.col("_hb").isNotNull() & (F.col("_a").isNull() & F.col("_b").isNull() | F.coalesce((F.col("_a") == F.col("_b")) | near, F.lit(False)))
    return both.where(~same).limit(1).count() == 0


def stage_code(w: Workbench, stage: Stage, spec: Spec, panel: DataFrame) -> None:
    """A second, independently written ``compute_signal(panel)`` must agree with the compiled plan. Code
    runs only where the workbench allows it; otherwise the plan stands alone."""
    want = compile_signal(spec, panel).select("date", "asset_id", "signal")
    why = ""
    for _ in range(2 if w.allow_code else 0):
        stage.llm = call_info(w.client, w.prompts["code"])
        code = w.client.complete(w.prompts["code"], describe_signal(spec) + why)
        try:
            if bad := disallowed_imports(code):
                raise ValueError(f"imports {bad}")
            scope: dict = {}
            exec(compile(code, "signal", "exec"), scope)  # noqa: S102  opted into
            if signals_match(want, scope["compute_signal"](panel).select("date", "asset_id", "signal")):
                stage.write_text("signal.py", code)
                stage.complete()
                return
            why = "\n\nIts values differ from the plan's."
        except Exception as e:  # noqa: BLE001  whatever the code raises is the answer
            why = f"\n\nIt failed: {e}"
    if w.allow_code:
        raise Halted(stage.halt(f"signal code: {why.strip()}"))
    stage.write_text("signal.txt", describe_signal(spec))
    stage.complete()


def _write_runs(stage: Stage, name: str, r: Result) -> None:
    for part, df in zip(("positions", "returns", "trades"), r):
        stage.write_table(f"{name}_{part}.parquet", df)
    r.release()


def _window(w: Workbench, claim: Claim, name: str) -> tuple[str, str]:
    if name == "replication" and claim.reported_period_start and claim.reported_period_end:
        return claim.reported_period_start, claim.reported_period_end
    if name == "oos":
        after = w.spark.sql(f"select cast(date_add(date'{claim.reported_period_end or w.end}', 1) as string)").first()[0]
        return after, w.end
    return w.start, w.end


def stage_backtest(w: Workbench, stage: Stage, spec: Spec, claim: Claim) -> dict[str, DataFrame]:
    """Headline (with capacity and sweeps in the same job), replication at lag 0, and out of sample."""
    fields = panel_fields(spec)
    sweeps = [Scenario(f"sweep:{k}={v:g}", {k: v}) for k, p in spec.params.items() for v in p.sweep]
    runs = [Scenario("headline"), Scenario("capacity", aum=TARGET_AUM * gates.CAPACITY_MULTIPLE), *sweeps]
    panel = w.panel(fields).persist()
    main = run_backtests(spec, panel, runs, costs=w.costs)
    _write_runs(stage, "headline", main)
    n = rebalance_dates(calendar(panel), spec.portfolio.rebalance).count()
    if n < w.min_rebalances:
        raise Halted(stage.halt(f"{n} rebalances; at least {w.min_rebalances} are needed"))
    at_zero = Spec.from_dict({**spec.to_dict(), "portfolio": {**spec.to_dict()["portfolio"], "execution_lag": 0}})
    for name, s in (("replication", at_zero), ("oos", spec)):
        start, end = _window(w, claim, name)
        _write_runs(stage, name, run_backtests(s, w.panel(fields, start, end), [Scenario(name)], replication=name == "replication", costs=w.costs))
    read = {n: w.spark.read.parquet(str(stage.folder / f"{n}_returns.parquet")) for n in ("headline", "replication", "oos")}
    table = metrics.summary(read["headline"].unionByName(read["replication"]).unionByName(read["oos"]))
    stage.write_table("metrics.parquet", table)
    panel.unpersist()
    stage.complete()
    return read


def stage_evaluate(w: Workbench, stage: Stage, spec: Spec, claim: Claim, factors: DataFrame, factor_names: list[str], others: DataFrame | None = None):
    """Gates, decomposition and a critique; fails and rejections halt."""
    read = {n: w.spark.read.parquet(str(stage.read_input("5_backtest", f"{n}_returns.parquet"))) for n in ("headline", "replication", "oos")}
    by = {r["scenario"]: r["sharpe"] for r in metrics.summary(read["headline"]).collect()}
    sweeps = {k: v for k, v in by.items() if k.startswith("sweep:")}
    head = read["headline"].where("scenario = 'headline'")
    before = w.store.trial_count(claim.claim_id)
    trials = before + 4 + len(sweeps)
    context = gates.GateContext(read["replication"], read["oos"], read["headline"].where("scenario = 'capacity'"), factors, factor_names, before, claim.reported_sharpe, spec.portfolio.holding_period, list(sweeps.values()), list(sweeps.values()), others)
    rows = gates.run_gates(Result(head, head, head), context)
    fit = gates.factor_regression(head, factors, factor_names) or {}
    stage.write_text("gates.json", json.dumps([r.__dict__ for r in rows], indent=2))
    stage.write_text("sweeps.json", json.dumps(sweeps, indent=2))
    stage.write_text("factors.json", json.dumps(fit, indent=2))
    if rows[-1].status == "fail":
        raise Halted(stage.halt(f"gate {rows[-1].name} fails", trials))
    try:
        critique = _ask(w, stage, "critique", {"claim": claim.to_dict(), "signal": describe_signal(spec), "gates": [r.__dict__ for r in rows]}, Critique.from_dict)
    except ParseError as e:
        raise Halted(stage.halt(f"no critique: {e}", trials)) from e
    stage.write_text("critique.md", critique.critique)
    if critique.verdict == "reject":
        raise Halted(stage.halt("rejected by the critique", trials))
    stage.complete(trials)
    return rows, sweeps, fit, critique, trials


def stage_pack(w: Workbench, stage: Stage, evidence: Evidence) -> None:
    stage.write_text("ic_pack.md", render(evidence))
    stage.write_text("decision.json", json.dumps({"decided_utc": None, "decision": None, "conditions": None, "reviewer": None}))
    stage.complete()


def run_claim(w: Workbench, source: str, factors: DataFrame, factor_names: list[str], claim_id: str | None = None, run_id: str | None = None, progress: Callable[[str], None] = lambda _: None) -> dict[str, Manifest]:
    """All stages for one source. A stage that halts ends the run; a fourth run is refused. Returns the
    manifests of the stages that ended."""
    claim_id = claim_id or f"claim-{uuid.uuid4().hex[:12]}"
    earlier = w.store.run_ids(claim_id)
    if len(earlier) >= MAX_RUNS:
        raise Refused(f"{claim_id} has had {MAX_RUNS} runs")
    run_id = run_id or f"run-{len(earlier) + 1}-{uuid.uuid4().hex[:8]}"
    parent = earlier[-1] if earlier else None
    done: dict[str, Manifest] = {}

    def at(name: str) -> Stage:
        progress(name)
        return w.store.begin(claim_id, run_id, name, parent)

    def ended(name: str) -> None:
        done[name] = w.store.manifest(claim_id, run_id, name)

    try:
        claim = stage_claim(w, at("1_claim"), source)
        ended("1_claim")
        stage_data(w, at("2_data"), claim)
        ended("2_data")
        spec = stage_spec(w, at("3_spec"), claim)
        ended("3_spec")
        stage_code(w, at("4_code"), spec, w.panel(panel_fields(spec)))
        ended("4_code")
        stage_backtest(w, at("5_backtest"), spec, claim)
        ended("5_backtest")
        rows, sweeps, fit, critique, trials = stage_evaluate(w, at("6_evaluate"), spec, claim, factors, factor_names)
        ended("6_evaluate")
        read = lambda n: w.spark.read.parquet(str(w.store.read(claim_id, run_id, "5_backtest", n)))
        head = read("headline_returns.parquet").where("scenario = 'headline'")
        book = read("headline_positions.parquet").where("scenario = 'headline'")
        evidence = Evidence(claim.to_dict(), spec, head, read("oos_returns.parquet"), book, rows, sweeps, fit, critique.critique, dict(done), trials)
        stage_pack(w, at("7_pack"), evidence)
        ended("7_pack")
    except Halted as h:
        done[h.manifest.stage] = h.manifest
    return done


__all__ = ["Claim", "Critique", "Halted", "Refused", "SpecError", "Workbench", "run_claim"]
