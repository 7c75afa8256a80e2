"""The closed operator vocabulary: what each takes and how it becomes a Column.

An operator names the partitioning it works in (``asset`` in date order, ``date``, or ``row``) so that
the compiler can evaluate neighbours of one partitioning in one projection and save exchanges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

ASSET, DATE, ROW = "asset", "date", "row"


@dataclass(frozen=True)
class Operator:
    name: str
    inputs: int | None  # None: two or more
    scope: str
    build: Callable[..., Column]
    params: dict[str, str] = field(default_factory=dict)  # name -> number | numbers | choice a|b
    prepare: Callable[..., Column] | None = None  # a column that the builder gets as ``helper``
    settle: Callable[..., Column] | None = None  # a second pass over the built column


OPERATORS: dict[str, Operator] = {}


def operator(name: str, inputs: int | None, scope: str, **params: str):
    """Register a builder ``f(keys, *columns, **params) -> Column``."""

    def add(build):
        OPERATORS[name] = Operator(name, inputs, scope, build, params)
        return build

    return add
