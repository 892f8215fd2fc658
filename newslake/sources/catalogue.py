"""The source and topic dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Repositories, feeds and topics that are watched by default.
GITHUB_REPOS = [
    "vercel/next.js",
    "openai/openai-python",
    "remix-run/remix",
    "withastro/astro",
    "chroma-core/chroma",
    "langchain-ai/langchain",
    "anthropics/anthropic-sdk-python",
    "vuejs/core",
    "tiangolo/fastapi",
    "vercel/vercel",
]
FEEDS = [
    "https://dev.to/feed",
    "https://css-tricks.com/feed/",
    "https://blog.logrocket.com/feed/",
    "https://changelog.com/feed",
]
TOPICS = [
    ("python", "Python"),
    ("javascript", "JavaScript"),
    ("ai-ml", "AI/ML"),
    ("devops", "DevOps"),
    ("web", "Web"),
]


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "slug STRING, label STRING")


def release_urls(repos: DataFrame) -> DataFrame:
    """Releases endpoint of each repository."""
    url = F.concat(F.lit("https://api.github.com/repos/"), F.col("repo"), F.lit("/releases"))
    return repos.select(url.alias("url"))


def default_urls(spark: SparkSession) -> DataFrame:
    """Feeds, then release endpoints."""
    feeds = spark.createDataFrame([(u,) for u in FEEDS], "url STRING")
    repos = spark.createDataFrame([(r,) for r in GITHUB_REPOS], "repo STRING")
    return feeds.unionByName(release_urls(repos))


def with_topic_label(rows: DataFrame, slug: str) -> DataFrame:
    """Add ``label`` of the topic named by ``slug``, the slug itself where the catalogue has none."""
    known = topics(rows.sparkSession).select(F.col("slug").alias(slug), "label")  # a fixed list of five
    return rows.join(F.broadcast(known), slug, "left").withColumn("label", F.coalesce("label", slug))
