"""Timetable events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_departures(events: DataFrame, ts: str = "ts", key: str = "stop_id", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, start, n: departures by event-time window; events later than ``late`` behind the newest are left out.

    The same plan serves a batch and a stream; on a stream the state of closed windows is dropped.
    """
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), key).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("start"), "n")
