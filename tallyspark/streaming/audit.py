"""Streams are an extension: daily audit counts with late rows, and intake that drops repeated content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Audit actions per day; a day is final once the stream is ``late`` past it."""
    return logs.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "action", "n")


def new_content(docs: DataFrame, key: str = "content_key", time: str = "created_at", within: str = "1 day") -> DataFrame:
    """Documents whose key has not come within the watermark; state is bounded by it."""
    return docs.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
