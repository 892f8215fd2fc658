"""Schemas of the landed payloads and of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEWSAPI_ARTICLE = (
    "source STRUCT<id: STRING, name: STRING>, author STRING, title STRING, description STRING, "
    "url STRING, urlToImage STRING, publishedAt STRING, content STRING"
)
NEWSAPI_ENVELOPE = (
    "STRUCT<status: STRING, code: STRING, message: STRING, totalResults: INT, "
    "articles: ARRAY<STRUCT<source: STRUCT<id: STRING, name: STRING>, author: STRING, title: STRING, "
    "description: STRING, url: STRING, urlToImage: STRING, publishedAt: STRING, content: STRING>>>"
)
GITHUB_RELEASES = (
    "ARRAY<STRUCT<draft: BOOLEAN, name: STRING, tag_name: STRING, html_url: STRING, body: STRING, "
    "published_at: STRING, created_at: STRING>>"
)
_FEED_ITEM = (
    "ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _VALUE: STRING>>, "
    "`content:encoded`: STRING, content: STRING, description: STRING, summary: STRING, "
    "pubDate: STRING, published: STRING, updated: STRING>>"
)
# An item may sit in the channel (RSS 2.0) or below the root (RSS 1.0); entries are Atom.
FEED_DOCUMENT = (
    f"STRUCT<channel: STRUCT<item: {_FEED_ITEM}, entry: {_FEED_ITEM}>, "
    f"item: {_FEED_ITEM}, entry: {_FEED_ITEM}, _corrupt: STRING>"
)
HN_ITEM = (
    "id BIGINT, type STRING, time BIGINT, title STRING, url STRING, score INT, descendants INT, `by` STRING"
)

ARTICLE_COLUMNS = {
    "article_id": "STRING",
    "title": "STRING",
    "source": "STRING",
    "date": "TIMESTAMP",
    "content": "STRING",
    "url": "STRING",
    "author": "STRING",
    "tags": "ARRAY<STRING>",
    "type": "STRING",
}
ARTICLE = ", ".join(f"{name} {kind}" for name, kind in ARTICLE_COLUMNS.items())
CHUNK = (
    "chunk_id STRING, article_id STRING, chunk_index INT, content STRING, title STRING, source STRING, "
    "url STRING, date TIMESTAMP, author STRING, tags ARRAY<STRING>, type STRING, fetched_at TIMESTAMP"
)
CARD = "STRUCT<title: STRING, source: STRING, date: STRING, snippet: STRING, url: STRING, tags: ARRAY<STRING>>"


def article_columns(**given: Column) -> list[Column]:
    """The article columns in order; those not given are null, tags are empty, type is batch."""
    defaults = {"tags": F.array().cast("array<string>"), "type": F.lit("batch")}
    return [
        given.get(name, defaults.get(name, F.lit(None))).cast(kind.lower()).alias(name)
        for name, kind in ARTICLE_COLUMNS.items()
    ]
