"""Counters of an ingest run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIRST_TITLES = 5  # fixed values: titles shown, and their length
TITLE_CHARS = 60


def ingest_summary(raw: DataFrame, articles: DataFrame, records: DataFrame, order: str = "seq") -> DataFrame:
    """Rows ``(item, pos, value)``: articles fetched, articles indexed, first titles in arrival order."""
    fetched = raw.agg(F.count("*").cast("string").alias("value")).select(
        F.lit("fetched").alias("item"), F.lit(0).alias("pos"), "value"
    )
    indexed = records.where("chunk_index = 0").agg(
        F.count_distinct("article_id").cast("string").alias("value")
    ).select(F.lit("indexed").alias("item"), F.lit(0).alias("pos"), "value")
    first = articles.orderBy(order).limit(FIRST_TITLES).agg(
        F.array_sort(F.collect_list(F.struct(order, F.substring("title", 1, TITLE_CHARS).alias("title")))).alias("t")
    ).select(F.posexplode("t").alias("i", "row"))
    titles = first.select(
        F.lit("title").alias("item"), (F.col("i") + 1).alias("pos"), F.col("row.title").alias("value")
    )
    return fetched.unionByName(indexed).unionByName(titles)


def newest(articles: DataFrame, n: int) -> DataFrame:
    """Newest articles first; ties by id."""
    return articles.orderBy(F.col("date").desc(), "article_id").limit(n)
