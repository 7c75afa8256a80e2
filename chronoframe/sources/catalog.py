"""Catalogues: which fields exist, who is in a universe, what trading costs by region."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import Strict, load_mapping


@dataclass(frozen=True)
class PitInfo(Strict):
    event_col: str
    knowledge_col: str
    lag_days: int


@dataclass(frozen=True)
class Coverage(Strict):
    start: str
    universes: list[str]


@dataclass(frozen=True)
class FieldDef(Strict):
    name: str
    source: str
    dtype: str
    pit: PitInfo
    coverage: Coverage
    known_gaps: list[str] = field(default_factory=list)
    description: str = ""


@dataclass(frozen=True)
class UniverseDef(Strict):
    name: str
    member_if_present: str


@dataclass(frozen=True)
class AdvBucket(Strict):
    spread_bps: float
    max_adv: float | None = None


@dataclass(frozen=True)
class RegionCosts(Strict):
    region: str
    adv_buckets: list[AdvBucket]


def _named(rows: Iterable[dict], kind: type, key: str) -> dict:
    out: dict = {}
    for r in rows:
        one = kind.from_dict({k: str(v) if k == "start" else v for k, v in r.items()} if isinstance(r, dict) else r)
        if getattr(one, key) in out:
            raise ValueError(f"{kind.__name__}: {getattr(one, key)!r} is there twice")
        out[getattr(one, key)] = one
    return out


def _plain(r: dict) -> dict:
    """Dates that YAML has read as dates, as text."""
    cover = r.get("coverage")
    return r if not isinstance(cover, dict) else {**r, "coverage": {**cover, "start": str(cover.get("start"))}}


def fields_from(rows: Iterable[dict]) -> dict[str, FieldDef]:
    return _named(map(_plain, rows), FieldDef, "name")


def universes_from(rows: Iterable[dict]) -> dict[str, UniverseDef]:
    return _named(rows, UniverseDef, "name")


def costs_from(rows: Iterable[dict]) -> dict[str, RegionCosts]:
    """Regions with their buckets by rising bound; the last one must have none."""
    out = _named(rows, RegionCosts, "region")
    for r in out.values():
        bounds = [b.max_adv for b in r.adv_buckets]
        if not bounds or bounds[-1] is not None or None in bounds[:-1] or bounds[:-1] != sorted(bounds[:-1]):
            raise ValueError(f"costs of {r.region!r}: bounds must rise and the last bucket must have none")
    return out


def _rows(path: str | Path, key: str) -> list[dict]:
    data = load_mapping(path)
    return data[key] if isinstance(data, dict) and key in data else data


def load_fields(path: str | Path) -> dict[str, FieldDef]:
    return fields_from(_rows(path, "fields"))


def load_universes(path: str | Path) -> dict[str, UniverseDef]:
    return universes_from(_rows(path, "universes"))


def load_costs(path: str | Path) -> dict[str, RegionCosts]:
    return costs_from(_rows(path, "regions"))


def lookup(table: dict, name: str):
    """The entry of that name; KeyError with the known names otherwise."""
    if name not in table:
        raise KeyError(f"{name!r} is unknown; known are {sorted(table)}")
    return table[name]


def fields_table(spark: SparkSession, fields: dict[str, FieldDef]) -> DataFrame:
    rows = [(f.name, f.source, f.coverage.start, f.coverage.universes, f.pit.lag_days, f.known_gaps) for f in fields.values()]
    return spark.createDataFrame(rows, "field string, source string, coverage_start string, coverage_universes array<string>, pit_lag_days int, known_gaps array<string>")


def resolve_fields(required: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``required(field)`` left-joined with a fields table; ``resolved`` tells whether it is known."""
    known = catalogue.withColumn("_known", F.lit(True))
    out = required.select("field").join(known, "field", "left")
    return out.withColumn("resolved", F.coalesce("_known", F.lit(False))).drop("_known")


# Round-trip spreads in bps by region and dollar volume.
DEFAULT_COSTS = costs_from(
    [
        {"region": "US", "adv_buckets": [{"max_adv": 1e6, "spread_bps": 25}, {"max_adv": 1e7, "spread_bps": 12}, {"spread_bps": 5}]},
        {"region": "EU", "adv_buckets": [{"max_adv": 1e6, "spread_bps": 35}, {"max_adv": 1e7, "spread_bps": 18}, {"spread_bps": 8}]},
    ]
)
#: The same tables for the region names of the driver's data.
DRIVER_COSTS = costs_from([{"region": r, "adv_buckets": [{"spread_bps": b.spread_bps} if b.max_adv is None else {"max_adv": b.max_adv, "spread_bps": b.spread_bps} for b in DEFAULT_COSTS["US" if r == "AMERICA" else "EU"].adv_buckets]} for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
