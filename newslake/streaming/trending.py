"""Trending tags over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WINDOW, SLIDE, DELAY, THRESHOLD = "7 days", "1 day", "1 day", 3


def trending_counts(
    tagged: DataFrame, time: str, tag: str, window: str = WINDOW, slide: str = SLIDE, threshold: int = THRESHOLD
) -> DataFrame:
    """Tags seen at least ``threshold`` times per sliding window; the same plan in batch and stream."""
    counts = tagged.groupBy(F.window(time, window, slide), F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= threshold).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tag", "n"
    )


def trending_stream(tagged: DataFrame, time: str, tag: str, delay: str = DELAY, **options) -> DataFrame:
    """The stream emits a window once the watermark has closed it; rows later than ``delay`` are dropped."""
    return trending_counts(tagged.withWatermark(time, delay), time, tag, **options)
