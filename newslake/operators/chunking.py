"""Articles to chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions.chunker import MAX_CHARS, OVERLAP, chunk_text, fixed_windows
from newslake.functions.once import computed_once
from newslake.functions.tags import detect_tags
from newslake.functions.text import chunk_id, tag_union


def chunk_articles(
    articles: DataFrame, id_column: str, text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """``(id, chunk_index, content)`` by the recursive chunker."""
    pieces = articles.select(id_column, computed_once(chunk_text(F.col(text), max_chars, overlap)).alias("_pieces"))
    return pieces.select(id_column, F.posexplode("_pieces").alias("chunk_index", "content"))


def fixed_chunks(
    articles: DataFrame, id_column: str, text: str, size: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """``(id, chunk_index, content)`` by windows of fixed size."""
    windows = fixed_windows(F.col(text), size, overlap)
    pieces = articles.select(id_column, computed_once(windows).alias("_pieces"))
    return pieces.select(id_column, F.posexplode("_pieces").alias("chunk_index", "content"))


def chunk_records(
    articles: DataFrame,
    fetched_at: Column,
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
    keywords: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One record per chunk. Tags are found once per article, in the same narrow pass over the text."""
    tagged = articles.withColumn(
        "_tags",
        tag_union(
            F.coalesce("tags", F.array().cast("array<string>")),
            detect_tags(F.col("content"), F.col("title"), keywords),
        ),
    ).withColumn("_pieces", computed_once(chunk_text(F.col("content"), max_chars, overlap)))
    rows = tagged.drop("content", "tags").select("*", F.posexplode("_pieces").alias("chunk_index", "content"))
    return rows.select(
        chunk_id(F.col("article_id"), F.col("chunk_index")).alias("chunk_id"),
        "article_id",
        "chunk_index",
        "content",
        "title",
        "source",
        "url",
        "date",
        "author",
        F.col("_tags").alias("tags"),
        "type",
        fetched_at.cast("timestamp").alias("fetched_at"),
    )


def stored_articles(records: DataFrame) -> DataFrame:
    """Articles with at least one chunk: every stored article has exactly one first chunk."""
    return records.where("chunk_index = 0").agg(F.count_distinct("article_id").alias("stored"))
