import json

import pytest
from pyspark.sql import functions as F

from chronoframe.plans.compiler import compile_signal
from chronoframe.plans.llm_client import ParseError, ScriptedClient, call_info, json_text, structured
from chronoframe.plans.workflow import Refused, Workbench, disallowed_imports, run_claim, signals_match
from chronoframe.queries import book, node, spec_of
from chronoframe.sources import fixture, pit
from chronoframe.sources.store import LLMCallInfo, Store

PROMPTS = {k: k for k in ("extract", "tradability", "spec", "code", "critique")}
SPEC = spec_of([node("n1", "clip", "planted_signal_1", lo="lo", hi="hi"), node("n2", "cs_zscore", "n1")], {"lo": -100, "hi": 100}, portfolio=book(quantile=0.2, max_position=0.2)).to_dict()
SPEC["params"]["hi"]["sweep"] = [50, 80]
CLAIM = {
    "source_type": "paper",
    "source_title": "Planted",
    "source_authors": ["A. Author"],
    "source_year": 2020,
    "edge_statement": "edge",
    "mechanism": "planted",
    "predicted_sign": 1,
    "universe_description": "all",
    "frequency": "daily",
    "horizon_days_lo": 1,
    "horizon_days_hi": 5,
    "required_fields": ["planted_signal_1", "close"],
    "reported_sharpe": 2.0,
    "reported_period_start": "2015-01-01",
    "reported_period_end": "2016-12-31",
}
YES = {"tradable": True, "tradability_reason": "liquid"}
GOOD = {"critique": "Sound.", "verdict": "proceed"}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fields")
    fx = fixture.build(spark, assets=40, delisted=2)
    for n in ("close", "planted_signal_1", "ret_1d", "adv_20", "region"):
        pit.write_field(fx.fields[n], str(root), n)
    return root, fx


def bench(spark, tmp_path, data, answers, **change):
    root, fx = data
    text = [a if isinstance(a, str) else json.dumps(a) for a in answers]
    w = Workbench(Store(tmp_path / "store", spark), str(root), fx.catalogue, fx.universes, ScriptedClient(text), PROMPTS, start="2015-01-01", end="2018-12-31", **change)
    return w, fx


def test_seven_stages_end_to_end(spark, tmp_path, data):
    code = "from chronoframe.plans.compiler import compile_signal\nfrom pyspark.sql import functions as F, Window\n\ndef compute_signal(panel):\n    d = Window.partitionBy('date')\n    x = F.least(F.greatest(F.col('planted_signal_1'), F.lit(-100.0)), F.lit(100.0))\n    p = panel.select('date', 'asset_id', x.alias('x'))\n    return p.select('date', 'asset_id', ((F.col('x') - F.avg('x').over(d)) / F.stddev_samp('x').over(d)).alias('signal'))\n"
    w, fx = bench(spark, tmp_path, data, ["no json", "```json\n" + json.dumps(CLAIM) + "\n```", YES, {**SPEC, "assumptions": []}, SPEC, "import os", code, GOOD], allow_code=True)
    seen = []
    done = run_claim(w, "text", fx.factors, fixture.FACTORS, "c1", "r1", seen.append)
    assert [m.status for m in done.values()] == ["complete"] * 7, {k: m.halt_reason for k, m in done.items()}
    assert seen == ["1_claim", "2_data", "3_spec", "4_code", "5_backtest", "6_evaluate", "7_pack"]
    pack = w.store.read("c1", "r1", "7_pack", "ic_pack.md").read_text()
    assert [x for x in pack.splitlines() if x.startswith("## ")] == [f"## {k}. {t}" for k, t in enumerate(["Headline", "Verdict table", "Gate table", "Cumulative return", "Assumptions and alternatives", "Parameter sweep", "Factor decomposition", "Sub-period table", "Critique", "Provenance", "Decision"], 1)]
    assert "Compute n1: apply clip to planted_signal_1, where hi is 100; lo is -100." in pack and "G13_orthogonality" in pack
    assert w.store.trial_count("c1") == 6
    gates = json.loads(w.store.read("c1", "r1", "6_evaluate", "gates.json").read_text())
    assert len(gates) == 13 and all(g["status"] != "fail" for g in gates)

    w.client.answers = [json.dumps({**CLAIM, "required_fields": ["ghost"]}), json.dumps(YES)]
    again = run_claim(w, "text", fx.factors, fixture.FACTORS, "c1")
    assert again["1_claim"].status == "halted" and again["1_claim"].parent_run_id == "r1"
    assert w.store.trial_count("c1") == 6
    w.client.answers = ["?", "?"]
    assert "unreadable" in run_claim(w, "text", fx.factors, fixture.FACTORS, "c1")["1_claim"].halt_reason
    with pytest.raises(Refused):
        run_claim(w, "text", fx.factors, fixture.FACTORS, "c1")


@pytest.mark.parametrize(
    "answers, change, stage, why",
    [
        ([CLAIM, {"tradable": False, "tradability_reason": "no market"}], {}, "1_claim", "no market"),
        ([CLAIM, YES], {"min_names": 41}, "2_data", "coverage"),
        ([CLAIM, YES, {**SPEC, "assumptions": []}, "{}"], {}, "3_spec", "no valid spec"),
        ([CLAIM, YES, SPEC, "def compute_signal(panel):\n    raise KeyError('x')", "import socket"], {"allow_code": True}, "4_code", "socket"),
        ([CLAIM, YES, SPEC], {"min_rebalances": 10_000}, "5_backtest", "rebalances"),
        ([{**CLAIM, "reported_sharpe": -2.0}, YES, SPEC], {}, "6_evaluate", "G2_replication"),
        ([CLAIM, YES, SPEC, {"critique": "bad", "verdict": "reject"}], {}, "6_evaluate", "rejected"),
    ],
)
def test_halts(spark, tmp_path, data, answers, change, stage, why):
    w, fx = bench(spark, tmp_path, data, answers, **change)
    done = run_claim(w, "text", fx.factors, fixture.FACTORS)
    assert list(done)[-1] == stage and done[stage].status == "halted" and why in done[stage].halt_reason
    read = w.store.manifest(done[stage].claim_id, done[stage].run_id, "1_claim")
    assert read.llm == call_info(w.client, PROMPTS["tradability"])
    assert read.status == ("halted" if stage == "1_claim" else "complete")


def test_signal_comparison_and_imports(spark):
    a = spark.createDataFrame([("d", 1, 1.0), ("d", 2, None)], "date string, asset_id long, signal double")
    assert signals_match(a, a) and signals_match(a, a.withColumn("signal", F.col("signal") * (1 + 1e-12)))
    assert not signals_match(a, a.withColumn("signal", F.col("signal") * (1 + 1e-6)))
    assert not signals_match(a, a.where("asset_id = 1")) and not signals_match(a.fillna(0.0), a)
    assert disallowed_imports("import os.path\nfrom math import pi\nfrom . import x\nimport pyspark.sql") == [".", "os"]


def test_structured_answers(tmp_path):
    assert json_text("```json\n{}\n```") == "{}" == json_text("{}")
    log = tmp_path / "log.jsonl"
    c = ScriptedClient(["nope", '{"a": 1}'])
    assert structured(c, "p", {}, lambda d: d["a"], log) == 1 and len(log.read_text().splitlines()) == 2
    assert "could not be used" in c.calls[1][1]
    first, second = map(json.loads, log.read_text().splitlines())
    assert (first["answer"], first["prompt"], first["context"], first["model"], first["seed"]) == ("nope", "p", "{}", "scripted", None)
    assert second["attempt"] == 2 and second["context"].startswith("{}\n") and first["asked_utc"] <= second["asked_utc"]
    c.temperature, c.seed = 0.5, 7
    assert (call_info(c, "p").temperature, call_info(c, "p").seed) == (0.5, 7)
    assert LLMCallInfo.from_dict(call_info(c, "p").to_dict()) == call_info(c, "p")
    with pytest.raises(ParseError):
        structured(ScriptedClient(["{}", "{}"]), "p", {}, lambda d: d["a"])


def test_planted_edges_have_their_sharpe(spark, data):
    """The fixture's own measured values; they tie signal, book, timing and costs together."""
    from chronoframe.plans import metrics
    from chronoframe.plans.backtest import run_backtest

    root, fx = data
    p = pit.load_panel(spark, str(root), ["planted_signal_1", "ret_1d"], "all", "2015-01-01", "2018-12-31", fx.catalogue, fx.universes)
    spec = spec_of([node("n1", "cs_zscore", "planted_signal_1")], portfolio=book(rebalance="daily"))
    live = metrics.summary(run_backtest(spec, p).returns).first()["sharpe"]
    assert live == pytest.approx(5.36, abs=0.1) and compile_signal(spec, p).where("signal is null").count() == 0
