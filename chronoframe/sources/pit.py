"""Point-in-time fields and panels.

A field table has ``date, asset_id, knowledge_date, value``, one folder of Parquet for each field. A
snapshot sees rows known by ``as_of`` and, where a value was restated, the newest of them, so a key
never fans out. All filters are on plain columns and reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import FieldDef, UniverseDef, lookup

KEY = ["date", "asset_id"]


def snapshot(rows: DataFrame, start=None, end=None, as_of=None, lag_days: int | None = None) -> DataFrame:
    """``date, asset_id, value`` as known at ``as_of`` (None: as known last).

    ``lag_days`` also drops rows that became known later than their date plus the lag.
    """
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    if as_of is not None:
        rows = rows.where(F.col("knowledge_date") <= F.lit(as_of).cast("date"))
    if lag_days is not None:
        rows = rows.where(F.col("knowledge_date") <= F.date_add("date", lag_days))
    return rows.groupBy(*KEY).agg(F.max_by("value", "knowledge_date").alias("value"))


def decision_time(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """``date, asset_id, value`` of what was known on each of ``dates``: the row of the newest event date
    among those with a knowledge date up to it. An as-of join by one window over both sides."""
    days = dates.agg(F.collect_set("date").alias("d")).scalar()  # a calendar's worth at most
    asked = rows.select("asset_id").distinct().select("asset_id", F.explode(days).alias("date"))
    known = rows.select("asset_id", F.col("knowledge_date").alias("at"), F.struct("date", "knowledge_date", "value").alias("v"))
    both = known.unionByName(asked.select("asset_id", F.col("date").alias("at"), F.lit(None).cast(known.schema["v"].dataType).alias("v")))
    w = Window.partitionBy("asset_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("best", F.max("v").over(w)).where("v is null and best is not null")
    return seen.select(F.col("at").alias("date"), "asset_id", "best.value").distinct()


def read_field(spark: SparkSession, root: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}.parquet")
    kind = dict(rows.dtypes)["value"]
    value = F.when(~F.isnan("value"), F.col("value")) if kind in ("double", "float") else F.col("value")
    return rows.select(F.to_date("date").alias("date"), "asset_id", F.to_date("knowledge_date").alias("knowledge_date"), value.alias("value"))


def write_field(rows: DataFrame, root: str, name: str) -> None:
    rows.select("date", "asset_id", "knowledge_date", "value").write.mode("errorifexists").parquet(f"{root}/{name}.parquet")


def assemble(fields: Mapping[str, DataFrame], members: DataFrame) -> DataFrame:
    """Members' ``date, asset_id`` with one column for each field; every join is on the same key, so one
    exchange of each side by (date, asset_id) serves them all."""
    base = members.select(*KEY).distinct()
    return reduce(lambda df, kv: df.join(kv[1].withColumnRenamed("value", kv[0]), KEY, "left"), fields.items(), base)


def load_panel(spark: SparkSession, root: str, fields: list[str], universe: str, start, end, catalogue: Mapping[str, FieldDef], universes: Mapping[str, UniverseDef], as_of=None, enforce_lag: bool = False) -> DataFrame:
    """The panel of a universe: an asset is in on the dates on which its membership field has a row."""
    for f in fields:
        lookup(dict(catalogue), f)
    by = lookup(dict(universes), universe).member_if_present
    tables = {}
    for f in dict.fromkeys([*fields, by]):
        lag = catalogue[f].pit.lag_days if enforce_lag and f in catalogue else None
        tables[f] = snapshot(read_field(spark, root, f), start, end, as_of, lag)
    return assemble({f: tables[f] for f in dict.fromkeys(fields)}, tables[by])


def coverage(panel: DataFrame, fields: list[str], dates: DataFrame | None = None, least: int = 30) -> DataFrame:
    """``date, n_names, below``: names with every field on each date, and whether they are too few."""
    counts = panel.dropna(subset=fields).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    cal = (dates if dates is not None else panel).select("date").distinct()
    n = F.coalesce("n", F.lit(0))
    return cal.join(counts, "date", "left").select("date", n.cast("long").alias("n_names"), (n < least).alias("below"))
