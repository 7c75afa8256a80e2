"""Events -> a bitemporal field table, as a stream.

Each event-time day of an asset becomes one row once the watermark has passed it; its knowledge date is
the date on which it could be written, so a later as-of read sees what was there then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``date, asset_id, knowledge_date, value`` (events a day) of ``events(ts, user_id)``. Works on a
    stream, where rows later than ``late`` are dropped, and on a table."""
    ts = F.col("ts").cast("timestamp")
    day = events.select(ts.alias("ts"), F.col("user_id").cast("long").alias("asset_id"))
    day = day.withWatermark("ts", late) if events.isStreaming else day
    out = day.groupBy(F.window("ts", "1 day").alias("w"), "asset_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    known = F.to_date(F.expr(f"w.end + interval {late}"))
    return out.select(F.to_date("w.start").alias("date"), "asset_id", known.alias("knowledge_date"), "value")


def start(events: DataFrame, path: str, checkpoint: str, late: str = "2 days") -> StreamingQuery:
    """Append finished days to a Parquet folder; stops when what is there now is read."""
    return daily_counts(events, late).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
