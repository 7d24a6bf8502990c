"""The hourly roll-up of shifts as a stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_shifts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(z, hour, rs, n) of a stream events(ts, user_id, value); rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), (F.col("user_id") % 8).alias("z")).agg(F.avg("value").alias("rs"), F.count("*").alias("n")).select("z", F.col("w.start").alias("hour"), "rs", "n")
