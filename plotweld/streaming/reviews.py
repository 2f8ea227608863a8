"""Review events as a stream: counts by window, and the newest status of every parcel's reviewer.

Both take any streaming table of event_id, ts, event_type and user_id; state is bounded by the watermark, or by the number of users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the status each kind of event gives.
STATUS = {"purchase": "APPROVED", "error": "REJECTED", "view": "FIELD_VERIFICATION", "signup": "CANDIDATE"}


def action_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in each window; events later than `late` are left out, as their window is closed."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def newest_status(events: DataFrame) -> DataFrame:
    """user_id and the status of the newest event that has one, in update or complete mode."""
    status = F.coalesce(*(F.when(F.col("event_type") == t, s) for t, s in STATUS.items()))
    known = events.withColumn("status", status).where("status is not null")
    return known.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
