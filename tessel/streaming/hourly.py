"""Hourly observations as a stream: the batch rule of G01 over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, ts: str = "ts", key: str = "key", uid: str = "uid", late: str = "4 hours") -> DataFrame:
    """§2.11: distinct uids of each key and hour; rows later than `late` are left out, as the batch's lag leaves them to the next run."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), key).agg(F.size(F.collect_set(uid)).alias("uids"), F.count("*").alias("rows"))
