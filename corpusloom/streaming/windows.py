"""Windows over event time that read the same from a table and from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """(event_type, start, n, total) of tumbling windows. On a stream rows later than ``late`` behind the newest time are dropped, and windows close then."""
    e = events.where("ts IS NOT NULL")
    if e.isStreaming:
        e = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of each user's sessions: events no more than ``gap`` apart."""
    e = events.where("ts IS NOT NULL AND user_id IS NOT NULL")
    if e.isStreaming:
        e = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
