"""Batch ingests: landed payloads to chunk records, with vectors into the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.operators.chunking import chunk_records
from newslake.operators.dedupe import dedupe
from newslake.operators.ranking import first_per_group
from newslake.operators.upsert import upsert_chunks
from newslake.operators.vectorise import vectorise
from newslake.sources.gate import ingest_gate
from newslake.sources.newsapi import newsapi_articles
from newslake.sources.scraped import scraped_articles


def scrape_batch(payloads: DataFrame, **tuning) -> DataFrame:
    """Articles of a scrape. Dedupe comes before the gate, so rows without url collapse to one first."""
    raw = scraped_articles(payloads).withColumn("seq", F.struct("seq", "pos"))
    return ingest_gate(dedupe(raw, **tuning), keep=("seq",))


def news_batch(payloads: DataFrame, pages_per_topic: int | None = None) -> DataFrame:
    """Articles of a news run. This path has no dedupe; equal ids meet in the upsert."""
    return ingest_gate(newsapi_articles(payloads, pages_per_topic), "NewsAPI", keep=("topic", "page", "pos"))


def indexed_batch(articles: DataFrame, fetched_at: Column, order: str = "seq") -> DataFrame:
    """Chunk records of a batch; of articles with one id the last one counts."""
    last = first_per_group(articles, ["article_id"], [F.col(order).desc()], 1, rank="_rank")
    return chunk_records(last.drop("_rank"), fetched_at)


def ingest_to_index(
    existing: DataFrame | None, articles: DataFrame, fetched_at: Column, idf: DataFrame, order: str = "seq"
) -> DataFrame:
    """The chunk table after a batch: its records with their vectors, in place of records of the same id.

    ``existing`` has the vectors too; ``idf`` is the model they were made with.
    """
    records = vectorise(indexed_batch(articles, fetched_at, order), idf)
    return records if existing is None else upsert_chunks(existing, records)
