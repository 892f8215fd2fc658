"""News API payloads, landed as ``(topic, page, http_status, body)``, to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions.dates import parse_iso
from newslake.functions.html import with_markdown
from newslake.functions.once import computed_once
from newslake.functions.text import article_id, first_filled, present_or
from newslake.operators.dedupe import dedupe
from newslake.operators.ranking import first_per_group
from newslake.schemas import NEWSAPI_ENVELOPE, article_columns
from newslake.session import small_side

# Fixed values of the fetch contracts.
PAGES_PER_TOPIC = 2  # as many a fetcher asks for; pages that have landed are all taken unless a limit is given
FRESH_DAYS = 7
FRESH_PER_TOPIC = 5
DEFAULT_SOURCE = "NewsAPI"


# As much of a body as tells whether a page is good; the whole envelope is parsed once, for accepted pages.
MARKS = "status STRING, articles ARRAY<STRUCT<url: STRING>>"


def page_marks(payloads: DataFrame) -> DataFrame:
    """``topic page`` with ``failed`` (http status or status) and ``bad`` (failed, unreadable or without articles)."""
    seen = payloads.select("topic", "page", "http_status", computed_once(F.from_json("body", MARKS)).alias("seen"))
    ok = F.coalesce((F.col("http_status") < 400) & (F.col("seen.status") == "ok"), F.lit(False))
    some = F.coalesce(F.size("seen.articles") > 0, F.lit(False))
    return seen.select("topic", "page", (~ok).alias("failed"), (~(ok & some)).alias("bad"))


def parse_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("envelope", computed_once(F.from_json("body", NEWSAPI_ENVELOPE)))


def accept_page_prefix(payloads: DataFrame, pages_per_topic: int | None = None) -> DataFrame:
    """Pages of each topic before its first bad one; of the first ``pages_per_topic``, if a limit is given.

    The first bad page is a partial aggregate per topic over narrow marks. It has a row per topic at most; below the
    bound of ``small_side`` it is sent to the pages, so that no body is shuffled.
    """
    pages = payloads if pages_per_topic is None else payloads.where(F.col("page") <= pages_per_topic)
    first_bad = page_marks(pages).where("bad").groupBy("topic").agg(F.min("page").alias("first_bad"))
    kept = pages.join(small_side(first_bad, "first-bad"), "topic", "left").where(
        F.col("first_bad").isNull() | (F.col("page") < F.col("first_bad"))
    )
    return parse_pages(kept).select("topic", "page", "http_status", "body", "envelope")


def page_articles(accepted: DataFrame) -> DataFrame:
    """One row per article of the accepted pages, with its page and position."""
    rows = accepted.select("topic", "page", F.posexplode("envelope.articles").alias("pos", "raw"))
    return rows.select("topic", "page", "pos", "raw.*")


def normalise_articles(raw: DataFrame) -> DataFrame:
    """Batch form: constant source, text date, articles without content dropped."""
    content = first_filled(F.col("description"), F.col("content"))
    return raw.where(content != "").select(
        *[c for c in ("topic", "page", "pos") if c in raw.columns],
        article_id(F.coalesce("url", F.lit(""))).alias("article_id"),
        "title",
        F.lit(DEFAULT_SOURCE).alias("source"),
        F.col("publishedAt").alias("date"),
        content.alias("content"),
        F.coalesce("url", F.lit("")).alias("url"),
        "author",
    )


def newsapi_articles(payloads: DataFrame, pages_per_topic: int | None = None) -> DataFrame:
    return normalise_articles(page_articles(accept_page_prefix(payloads, pages_per_topic)))


def typed_articles(raw: DataFrame) -> DataFrame:
    """Typed form: source by name, parsed date, empty content kept."""
    url = F.coalesce("url", F.lit(""))
    return raw.select(
        *article_columns(
            article_id=article_id(url),
            title=F.coalesce("title", F.lit("")),
            source=F.coalesce("source.name", F.lit(DEFAULT_SOURCE)),
            date=parse_iso(F.col("publishedAt")),
            content=first_filled(F.col("description"), F.col("content")),
            url=url,
            author=F.col("author"),
        )
    )


def source_name(article_json: Column) -> Column:
    """Source name of one article object; the default applies only where the key is missing."""
    source = F.get_json_object(article_json, "$.source")
    name = F.get_json_object(source, "$.name")
    return F.when(source.isNull(), F.lit(DEFAULT_SOURCE)).otherwise(
        present_or(source, "name", name, F.lit(DEFAULT_SOURCE))
    )


def newest_per_topic(
    payloads: DataFrame, as_of: Column, days: int = FRESH_DAYS, n: int = FRESH_PER_TOPIC
) -> DataFrame:
    """Newest ``n`` articles per topic since ``as_of - days`` (whole dates).

    A topic with any failed or not-ok page is left out whole.
    """
    failed = small_side(page_marks(payloads).where("failed").select("topic").distinct(), "failed-topics")
    raw = page_articles(parse_pages(payloads.join(failed, "topic", "left_anti")))
    since = F.to_date(as_of - F.make_dt_interval(days=F.lit(days)))
    dated = raw.withColumn("_date", parse_iso(F.col("publishedAt"))).where(F.to_date("_date") >= since)
    order = [F.col("_date").desc(), article_id(F.coalesce("url", F.lit("")))]
    return first_per_group(dated, ["topic"], order, n, rank="topic_rank").drop("_date")


def clean_fresh(raw: DataFrame, *columns: Column | str) -> DataFrame:
    """Fresh form with ``columns`` in front: url and content required, HTML content cleaned, topic as tag."""
    content = first_filled(F.col("description"), F.col("content"))
    filled = raw.withColumn("_content", content).where((F.col("_content") != "") & (F.coalesce("url", F.lit("")) != ""))
    is_html = F.contains("_content", F.lit("<"))
    filled = with_markdown(filled.withColumn("_html", F.when(is_html, F.col("_content"))), "_html", "_clean")
    topic = first_filled(F.col("topic"))
    return filled.select(
        *columns,
        *article_columns(
            article_id=article_id(F.col("url")),
            title=first_filled(F.col("title")),
            source=F.coalesce(F.nullif("source.name", F.lit("")), F.lit(DEFAULT_SOURCE)),
            date=parse_iso(F.col("publishedAt")),
            content=F.coalesce("_clean", "_content"),
            url=F.col("url"),
            tags=F.when(topic != "", F.array(topic)).otherwise(F.array().cast("array<string>")),
            type=F.lit("online"),
        ),
    )


def fresh_articles(raw: DataFrame, order: list[str]) -> DataFrame:
    """``clean_fresh``, then deduped. ``order`` names the columns that give the arrival order."""
    return dedupe(clean_fresh(raw, F.struct(*order).alias("seq")))
