"""The ingest gate: rows with a url and content become typed articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions.text import article_id
from newslake.schemas import article_columns


def _reason(raw: DataFrame) -> Column:
    text_date = dict(raw.dtypes).get("date") == "string"
    bad_date = F.col("date").isNotNull() & F.col("date").try_cast("timestamp").isNull() if text_date else F.lit(False)
    return (
        F.when(F.coalesce("url", F.lit("")) == "", "no_url")
        .when(F.coalesce("content", F.lit("")) == "", "no_content")
        .when(F.col("title").isNull(), "no_title")
        .when(bad_date, "bad_date")
    )


def ingest_gate(raw: DataFrame, default_source: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Articles of type batch from the rows that have url, content, title and no unreadable date."""
    author = F.col("author") if "author" in raw.columns else F.lit(None)
    return raw.where(_reason(raw).isNull()).select(
        *keep,
        *article_columns(
            article_id=article_id(F.col("url")),
            title=F.col("title"),
            source=F.coalesce("source", F.lit(default_source)),
            date=F.col("date").try_cast("timestamp"),
            content=F.col("content"),
            url=F.col("url"),
            author=author,
        ),
    )


def gate_rejects(raw: DataFrame) -> DataFrame:
    """Rows the gate refuses, with the first reason that applies."""
    return raw.withColumn("reason", _reason(raw)).where(F.col("reason").isNotNull())
