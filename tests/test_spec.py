import json

import pytest

from chronoframe.plans.spec import MAX_NODES, ParamSpec, Signal, SignalNode, Spec, SpecError, load_spec, validate_spec
from chronoframe.queries import MOMENTUM, VOLUME_MOMENTUM, node, spec_of
from chronoframe.sources.catalog import DEFAULT_COSTS, costs_from, fields_from, lookup, universes_from

FIELDS = {"close", "adv_20", "sector", "ret_1d"}


def test_valid_specs_and_files(tmp_path):
    for s in (MOMENTUM, VOLUME_MOMENTUM):
        assert validate_spec(s, FIELDS) is s
        (tmp_path / "s.json").write_text(json.dumps(s.to_dict()))
        assert load_spec(tmp_path / "s.json") == s
    later = spec_of([node("b", "neg", "a"), node("a", "neg", "close"), node("c", "neg", "b")])
    validate_spec(later, FIELDS)


@pytest.mark.parametrize(
    "nodes, params, message",
    [
        ([node("a", "nope", "close")], {}, "unknown op"),
        ([node("a", "add", "close")], {}, "inputs"),
        ([node("a", "combine", "close", weights=["w"])], {"w": 1}, "two or more"),
        ([node("a", "neg", "ghost")], {}, "ghost"),
        ([node("a", "lag", "close")], {}, "params"),
        ([node("a", "neg", "close", n="w")], {"w": 1}, "params"),
        ([node("a", "lag", "close", n=3.0)], {}, "must name"),
        ([node("a", "lag", "close", n="ghost")], {}, "must name"),
        ([node("a", "lag", "close", n="w")], {"w": -1}, "at least 1"),
        ([node("a", "lag", "close", n="w")], {"w": 1.5}, "whole"),
        ([node("a", "ewm", "close", halflife="w")], {"w": 0}, "range"),
        ([node("a", "combine", "close", "close", weights=["w"])], {"w": 1}, "one parameter"),
        ([node("a", "cs_neutralize", "close", group="beta")], {}, "not one of"),
        ([node("a", "neg", "b"), node("b", "neg", "a")], {}, "cycle"),
        ([node("a", "neg", "close"), node("a", "neg", "close")], {}, "repeat"),
        ([node(f"n{k}", "neg", "close") for k in range(MAX_NODES + 1)], {}, "nodes"),
    ],
)
def test_rules(nodes, params, message):
    with pytest.raises(SpecError, match=message):
        validate_spec(spec_of(nodes, params), FIELDS)


def test_output_sweep_and_strictness():
    data = MOMENTUM.to_dict()
    with pytest.raises(SpecError, match="output"):
        validate_spec(Spec.from_dict({**data, "signal": {**data["signal"], "output": "ghost"}}), FIELDS)
    with pytest.raises(SpecError, match="at least 1"):
        validate_spec(Spec.from_dict({**data, "params": {**data["params"], "n": {"value": 5, "sweep": [0]}}}), FIELDS)
    with pytest.raises(SpecError, match="assumptions"):
        validate_spec(Spec.from_dict({**data, "assumptions": []}), FIELDS)
    for bad in ({**data, "extra": 1}, {k: v for k, v in data.items() if k != "costs"}, {**data, "signal": {**data["signal"], "sign": 0}}):
        with pytest.raises(SpecError):
            Spec.from_dict(bad)
    assert MOMENTUM.with_params(n=9).params["n"] == ParamSpec(value=9.0)
    with pytest.raises(SpecError):
        MOMENTUM.with_params(ghost=1)
    with pytest.raises(SpecError):
        Signal(nodes=[SignalNode(id=1, op="neg", inputs=[])], output="a", sign=1)


def test_catalogues():
    row = {"name": "close", "source": "s", "dtype": "float64", "pit": {"event_col": "date", "knowledge_col": "knowledge_date", "lag_days": 0}, "coverage": {"start": "2010-01-01", "universes": ["all"]}}
    assert lookup(fields_from([row]), "close").pit.lag_days == 0
    with pytest.raises(ValueError, match="twice"):
        fields_from([row, row])
    with pytest.raises(KeyError):
        lookup(universes_from([{"name": "all", "member_if_present": "close"}]), "ghost")
    for buckets in ([], [{"max_adv": 1e6, "spread_bps": 1}], [{"spread_bps": 1}, {"max_adv": 1e6, "spread_bps": 1}], [{"max_adv": 2e6, "spread_bps": 1}, {"max_adv": 1e6, "spread_bps": 1}, {"spread_bps": 1}]):
        with pytest.raises(ValueError):
            costs_from([{"region": "X", "adv_buckets": buckets}])
    assert [b.spread_bps for b in DEFAULT_COSTS["US"].adv_buckets] == [25, 12, 5]
