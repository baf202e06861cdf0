"""Trending as a sliding event-time window (S3), in stream and batch form.

Windows of 7 days sliding by 1 day (aligned to midnight UTC), event counts per
item.  The stream uses a 1 hour watermark and append mode, so a window is emitted
once it is closed; late rows are dropped.  The batch form is the same
aggregation without a watermark (all windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = "7 days"
SLIDE = "1 day"
VALID = ("save", "cart", "order")


def _windowed(ev: DataFrame) -> DataFrame:
    return (ev.filter(F.col("event").isin(*VALID))
              .groupBy(F.window("ts", WINDOW, SLIDE).alias("w"), "item_id")
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "item_id", "n"))


def trending_batch(events: DataFrame) -> DataFrame:
    return _windowed(events.withColumn("ts", F.col("ts").cast("timestamp")))


def trending_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return _windowed(ev)
