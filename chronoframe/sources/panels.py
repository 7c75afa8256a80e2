"""Panels derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier and ISO week of shipping. Prices are ratios of whole-number sums, so any
    engine and any order of rows gives the same bits."""
    line = table(spark, sf_dir, "lineitem").select(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        F.col("l_suppkey").cast("long").alias("asset_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("qty"),
    )
    week = line.groupBy("date", "asset_id").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    place = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    place = place.select(F.col("s_suppkey").cast("long").alias("asset_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    df = week.join(place, "asset_id")
    close = F.col("cents").cast("double") / F.col("qty").cast("double")
    df = df.select("date", "asset_id", close.alias("close"), F.col("qty").cast("double").alias("volume"), "country", "region", F.concat(F.lit("S"), (F.col("asset_id") % 8).cast("string")).alias("sector"))
    w = Window.partitionBy("asset_id").orderBy("date")
    full = w.rowsBetween(-19, 0)
    return df.select(
        "*",
        (F.col("close") / F.lag("close", 1).over(w) - 1).alias("ret_1d"),
        F.when(F.count("volume").over(full) == 20, F.avg("volume").over(full)).alias("adv_20"),
        (F.col("close") * 1000.0 * (1 + F.col("asset_id") % 7)).alias("mktcap"),
        F.date_add("date", (10 * (F.col("asset_id") % 4)).cast("int")).alias("knowledge_date"),
    )


def daily_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, asset_id, value_cents, n_events`` of the event table."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("user_id").cast("long").alias("asset_id"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return e.groupBy("date", "asset_id").agg(F.sum("cents").alias("value_cents"), F.count(F.lit(1)).alias("n_events"))


def market(panel: DataFrame) -> DataFrame:
    """``date, market``: the mean return of each date."""
    return panel.groupBy("date").agg(F.avg("ret_1d").alias("market")).where("market is not null")
