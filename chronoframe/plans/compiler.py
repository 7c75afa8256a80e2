"""Signal DAG -> projections on a panel.

Nodes that the output does not need are left out, and nodes of the same operator, inputs and values are
computed once. What is left is scheduled in rounds: all nodes that are ready and share a partitioning
go into one projection, so Spark plans one exchange and one sort for them; row-wise nodes ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ASSET, DATE, OPERATORS, ROW
from .spec import Spec, number


def _values(spec: Spec, node) -> dict:
    out = {}
    for name, kind in OPERATORS[node.op].params.items():
        v = node.params[name]
        out[name] = v if kind.startswith("choice") else [number(spec, r) for r in v] if kind == "numbers" else number(spec, v)
    return out


def fields_of(spec: Spec) -> set[str]:
    """Panel columns that the signal reads."""
    by_id = {n.id: n for n in spec.signal.nodes}
    out, todo, seen = set(), [spec.signal.output], set()
    while todo:
        ref = todo.pop()
        if ref in seen:
            continue
        seen.add(ref)
        if ref not in by_id:
            out.add(ref)
            continue
        todo += by_id[ref].inputs
        if "group" in by_id[ref].params:
            out.add(by_id[ref].params["group"])
    return out


def compile_signal(spec: Spec, panel: DataFrame, keys: tuple[str, ...] = (), name: str = "signal") -> DataFrame:
    """``panel`` with the signal as a further column. ``keys`` split the panel into separate ones."""
    missing = fields_of(spec) - set(panel.columns)
    if missing:
        raise KeyError(f"the panel lacks {sorted(missing)}")
    by_id = {n.id: n for n in spec.signal.nodes}
    column: dict[str, str] = {}  # node id -> column
    made: dict[tuple, str] = {}  # structure -> column
    order: list[tuple[str, object, list[str], dict]] = []

    def plan(ref: str) -> str:
        if ref not in by_id:
            return ref
        if ref not in column:
            node = by_id[ref]
            inputs = [plan(i) for i in node.inputs]
            values = _values(spec, node)
            shape = (node.op, tuple(inputs), repr(sorted(values.items())))
            if shape not in made:
                made[shape] = f"__{name}_{len(made)}"
                order.append((made[shape], OPERATORS[node.op], inputs, values))
            column[ref] = made[shape]
        return column[ref]

    top = plan(spec.signal.output)
    df, left, scope = panel, order, ASSET
    while left:
        waiting = {o[0] for o in left}
        ready = [o for o in left if not set(o[2]) & waiting]
        now = [o for o in ready if o[1].scope in (scope, ROW)]
        if not now:
            scope = DATE if scope == ASSET else ASSET
            continue
        helpers = {out: f"{out}_h" for out, op, _, _ in now if op.prepare}
        if helpers:
            df = df.select("*", *[op.prepare(list(keys)).alias(helpers[out]) for out, op, _, _ in now if op.prepare])
        built = []
        for out, op, inputs, values in now:
            extra = {"helper": F.col(helpers[out])} if op.prepare else {}
            built.append(op.build(list(keys), *[F.col(i).cast("double") for i in inputs], **values, **extra).alias(out))
        df = df.select("*", *built)
        for out, op, _, _ in now:
            if op.settle:
                df = df.withColumn(out, op.settle(list(keys), F.col(out)))
        done = {o[0] for o in now}
        left = [o for o in left if o[0] not in done]
    return df.select(*panel.columns, (F.col(top) * float(spec.signal.sign)).alias(name))


def describe_signal(spec: Spec) -> str:
    """The DAG as numbered sentences that state every parameter's value."""

    def told(value) -> str:
        if isinstance(value, list):
            return " and ".join(told(v) for v in value)
        return value if isinstance(value, str) else f"{value:.17g}" if value != round(value, 12) else f"{value:.12g}"

    steps = []
    for number, node in enumerate(spec.signal.nodes, 1):
        settings = "; ".join(f"{name} is {told(value)}" for name, value in sorted(_values(spec, node).items()))
        steps.append(f"{number}. Compute {node.id}: apply {node.op} to {' and '.join(node.inputs)}{', where ' + settings if settings else ''}.")
    turn = "as it is" if spec.signal.sign > 0 else "with its sign turned"
    steps.append(f"The signal is {spec.signal.output}, taken {turn}.")
    return "\n".join(steps)
