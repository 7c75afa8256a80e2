"""Strategy specs: strict frozen records, read from mappings, and the rules they must meet."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Literal, get_args, get_origin, get_type_hints

from ..operators import OPERATORS

MAX_NODES = 12


class SpecError(ValueError):
    """A spec breaks a rule; the message names the node or field."""


def _fits(value, kind, at: str):
    origin = get_origin(kind)
    if origin in (typing.Union, types.UnionType):
        for k in get_args(kind):
            try:
                return _fits(value, k, at)
            except SpecError:
                continue
        raise SpecError(f"{at}: {value!r} is none of {kind}")
    if origin is Literal:
        if value not in get_args(kind):
            raise SpecError(f"{at}: {value!r} is not one of {get_args(kind)}")
        return value
    if origin in (list, tuple):
        if not isinstance(value, (list, tuple)):
            raise SpecError(f"{at}: a list is needed")
        return [_fits(v, get_args(kind)[0], f"{at}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            raise SpecError(f"{at}: a mapping is needed")
        return {k: _fits(v, get_args(kind)[1], f"{at}.{k}") for k, v in value.items()}
    if dataclasses.is_dataclass(kind):
        return value if isinstance(value, kind) else kind.from_dict(value, at)
    if kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind is type(None) and value is None or kind is not float and isinstance(kind, type) and isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
        return value
    raise SpecError(f"{at}: {value!r} is not {getattr(kind, '__name__', kind)}")


class Strict:
    """A dataclass that is checked when made and refuses unknown keys when read."""

    def __post_init__(self):
        hints = get_type_hints(type(self))
        for f in dataclasses.fields(self):
            object.__setattr__(self, f.name, _fits(getattr(self, f.name), hints[f.name], f"{type(self).__name__}.{f.name}"))

    @classmethod
    def from_dict(cls, data: dict, at: str | None = None):
        at = at or cls.__name__
        if not isinstance(data, dict):
            raise SpecError(f"{at}: a mapping is needed")
        names = {f.name for f in dataclasses.fields(cls)}
        if extra := sorted(set(data) - names):
            raise SpecError(f"{at}: unknown {extra}")
        need = [f.name for f in dataclasses.fields(cls) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        if missing := [n for n in need if n not in data]:
            raise SpecError(f"{at}: missing {missing}")
        return cls(**data)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


@dataclass(frozen=True)
class SignalNode(Strict):
    id: str
    op: str
    inputs: list[str]
    params: dict[str, float | str | list[str | float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Signal(Strict):
    nodes: list[SignalNode]
    output: str
    sign: Literal[-1, 1]


@dataclass(frozen=True)
class UniverseFilters(Strict):
    min_mktcap: float = 0.0
    min_adv_20: float = 0.0
    min_price: float = 0.0
    min_history_days: int = 0
    require_fields: list[str] = field(default_factory=list)
    exclude_sectors: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Universe(Strict):
    base: str
    filters: UniverseFilters = field(default_factory=UniverseFilters)


@dataclass(frozen=True)
class Threshold(Strict):
    lo: float | None = None
    hi: float | None = None


@dataclass(frozen=True)
class Portfolio(Strict):
    construction: Literal["long_short_quantile", "long_only_quantile", "top_n_bottom_n", "rank_weighted", "threshold"]
    weighting: Literal["equal", "rank", "signal", "vol_scaled"]
    gross_leverage: float
    net_exposure: float
    max_position: float
    rebalance: Literal["daily", "weekly", "monthly"]
    holding_period: int
    execution_lag: int
    quantile: float | None = None
    n: int | None = None
    threshold: Threshold = field(default_factory=Threshold)
    neutralize: list[Literal["sector", "country", "beta"]] = field(default_factory=list)


@dataclass(frozen=True)
class Costs(Strict):
    spread_model: Literal["fixed_bps", "adv_based"]
    impact_model: Literal["none", "sqrt"]
    impact_coeff: float
    borrow_bps_annual: float
    spread_bps: float | None = None


@dataclass(frozen=True)
class Assumption(Strict):
    id: str
    choice: str
    source_says: str
    alternatives: list[str | float | int | None] = field(default_factory=list)


@dataclass(frozen=True)
class ParamSpec(Strict):
    value: float
    sweep: list[float] = field(default_factory=list)


@dataclass(frozen=True)
class Spec(Strict):
    signal: Signal
    universe: Universe
    portfolio: Portfolio
    costs: Costs
    assumptions: list[Assumption]
    params: dict[str, ParamSpec] = field(default_factory=dict)

    def with_params(self, **values: float) -> Spec:
        """The same spec with other parameter values."""
        if unknown := sorted(set(values) - set(self.params)):
            raise SpecError(f"params: unknown {unknown}")
        return dataclasses.replace(self, params={k: dataclasses.replace(p, value=float(values.get(k, p.value))) for k, p in self.params.items()})


def load_mapping(path: str | Path) -> dict:
    """A JSON or YAML file (YAML where the library is there)."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need PyYAML; JSON is read without it") from e
    return yaml.safe_load(text)


def load_spec(path: str | Path) -> Spec:
    return Spec.from_dict(load_mapping(path))


def number(spec: Spec, ref: float | str) -> float:
    """A literal, or the value of a named parameter."""
    return spec.params[ref].value if isinstance(ref, str) else float(ref)


_LEAST = {"n": 1, "halflife": 0, "k": 0}


def _check_value(name: str, value: float, at: str) -> None:
    if name == "n" and (value != int(value) or value < 1):
        raise SpecError(f"{at}: n must be a whole number of at least 1, not {value}")
    if name == "halflife" and value <= 0 or name == "k" and value < 0:
        raise SpecError(f"{at}: {name} is out of range: {value}")


def _check_node(spec: Spec, node: SignalNode, known: set[str], fields: set[str]) -> None:
    at = f"node {node.id!r}"
    op = OPERATORS.get(node.op)
    if op is None:
        raise SpecError(f"{at}: unknown op {node.op!r}")
    if op.inputs is None and len(node.inputs) < 2 or op.inputs is not None and len(node.inputs) != op.inputs:
        raise SpecError(f"{at}: {node.op} takes {op.inputs or 'two or more'} inputs, not {len(node.inputs)}")
    if unknown := [i for i in node.inputs if i not in known and i not in fields]:
        raise SpecError(f"{at}: inputs {unknown} are neither nodes nor fields")
    if set(node.params) != set(op.params):
        raise SpecError(f"{at}: params {sorted(node.params)}, but {node.op} takes {sorted(op.params)}")
    for name, kind in op.params.items():
        value = node.params[name]
        if kind.startswith("choice"):
            options = kind.split(" ")[1].split("|")
            if value not in options:
                raise SpecError(f"{at}: {name}={value!r} is not one of {options}")
            continue
        refs = value if kind == "numbers" else [value]
        if not isinstance(refs, list) or kind == "numbers" and len(refs) != len(node.inputs):
            raise SpecError(f"{at}: {name} needs one parameter for each input")
        for ref in refs:
            if not isinstance(ref, str) or ref not in spec.params:
                raise SpecError(f"{at}: {name}={ref!r} must name an entry of params")
            for v in (spec.params[ref].value, *spec.params[ref].sweep):
                _check_value(name, v, at)


def validate_spec(spec: Spec, fields: set[str]) -> Spec:
    """The spec itself, or SpecError for the first rule that it breaks. ``fields`` are catalogue names."""
    nodes = spec.signal.nodes
    if not 1 <= len(nodes) <= MAX_NODES:
        raise SpecError(f"signal: {len(nodes)} nodes; 1 to {MAX_NODES} are allowed")
    by_id = {n.id: n for n in nodes}
    if len(by_id) != len(nodes):
        raise SpecError("signal: node ids repeat")
    for n in nodes:
        _check_node(spec, n, set(by_id), fields)
    left = {n.id: {i for i in n.inputs if i in by_id} for n in nodes}
    while left:  # take away what depends on nothing that is left
        free = {k for k, deps in left.items() if not deps & set(left)}
        if not free:
            raise SpecError(f"signal: a cycle through {sorted(left)}")
        left = {k: d for k, d in left.items() if k not in free}
    if spec.signal.output not in by_id:
        raise SpecError(f"signal: output {spec.signal.output!r} is not a node")
    if not spec.assumptions:
        raise SpecError("assumptions: at least one is needed")
    return spec
