"""Scraped payloads, landed as ``(seq, url, http_status, content_type, body)``, to articles and rejects.

``seq`` is the arrival number of a payload; with ``pos``, the place within it, it orders the articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions.dates import normalise_date
from newslake.functions.html import with_markdown, with_page_title
from newslake.functions.once import computed_once
from newslake.functions.text import WHITE, first_filled, netloc, repo_name, source_host, strip, url_path
from newslake.schemas import FEED_DOCUMENT, GITHUB_RELEASES


def payload_route(url: Column, content_type: Column, body: Column) -> Column:
    """``github``, ``feed`` or ``html``."""
    kind = F.coalesce(content_type, F.lit(""))
    head = F.lower(F.substring(F.ltrim(body, F.lit(WHITE)), 1, 200))
    github = (netloc(url) == "api.github.com") & F.contains(url_path(url), F.lit("/releases"))
    feed = (
        kind.rlike("xml|rss|atom")
        | F.startswith(head, F.lit("<?xml"))
        | F.contains(head, F.lit("<rss"))
        | F.contains(head, F.lit("<feed"))
    )
    return F.when(github, "github").when(feed, "feed").otherwise("html")


def route_payloads(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("route", payload_route(F.col("url"), F.col("content_type"), F.col("body")))


def _release_columns(release: Column, endpoint: Column) -> dict[str, Column]:
    label = F.coalesce(F.nullif(release["name"], F.lit("")), F.nullif(release["tag_name"], F.lit("")), F.lit("release"))
    return {
        "title": strip(F.concat(repo_name(endpoint), F.lit(" "), label)),
        "url": F.coalesce(release["html_url"], endpoint),
        "content": first_filled(release["body"]),
        "source": F.lit("GitHub"),
        "date": normalise_date(first_filled(release["published_at"], release["created_at"])),
    }


def _item_columns(item: Column, endpoint: Column) -> dict[str, Column]:
    """Columns of a feed item; ``content`` is still markup."""
    link = F.try_element_at(item["link"], F.lit(1))
    bodies = ("content:encoded", "content", "description", "summary")
    dates = ("pubDate", "published", "updated")
    return {
        "title": strip(first_filled(item["title"])),
        "url": first_filled(link["_href"], strip(link["_VALUE"])),
        "content": first_filled(*[strip(item[name]) for name in bodies]),
        "source": source_host(endpoint),
        "date": normalise_date(first_filled(*[strip(item[name]) for name in dates])),
    }


def _feed_array(doc: Column) -> Column:
    """All items of a parsed feed, or all its entries if it has no item."""
    def all_of(kind: str) -> Column:
        return F.concat(F.coalesce(doc["channel"][kind], F.array()), F.coalesce(doc[kind], F.array()))

    return F.when(F.size(all_of("item")) > 0, all_of("item")).otherwise(all_of("entry"))


def _parse_feed(body: Column) -> Column:
    return F.from_xml(body, FEED_DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt"})


def github_releases(payloads: DataFrame) -> DataFrame:
    """Releases that are no drafts, titled with their repository."""
    parsed = payloads.select(
        "seq", F.col("url").alias("endpoint"), computed_once(F.from_json("body", GITHUB_RELEASES)).alias("releases")
    )
    rows = parsed.select("seq", "endpoint", F.posexplode("releases").alias("pos", "release"))
    rows = rows.where(~F.coalesce("release.draft", F.lit(False)))
    columns = _release_columns(F.col("release"), F.col("endpoint"))
    return rows.select("seq", "endpoint", "pos", *[c.alias(name) for name, c in columns.items()])


def feed_items(payloads: DataFrame) -> DataFrame:
    """RSS items of a feed, or its Atom entries if it has no item."""
    parsed = payloads.select(
        "seq", F.col("url").alias("endpoint"), computed_once(_parse_feed(F.col("body"))).alias("doc")
    )
    parsed = parsed.select("seq", "endpoint", computed_once(_feed_array(F.col("doc"))).alias("items"))
    rows = parsed.select("seq", "endpoint", F.posexplode("items").alias("pos", "item"))
    columns = _item_columns(F.col("item"), F.col("endpoint"))
    rows = rows.select("seq", "endpoint", "pos", *[c.alias(name) for name, c in columns.items()])
    return _with_clean_content(rows)


def _with_clean_content(rows: DataFrame) -> DataFrame:
    return with_markdown(rows.withColumnRenamed("content", "_raw"), "_raw", "content").select(
        "seq", "endpoint", "pos", "title", "url", "content", "source", "date"
    )


def html_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One article per page: title, Markdown content, host as source, no date."""
    rows = pages.select(
        "seq", F.col("url").alias("endpoint"), F.lit(0).alias("pos"), "url", F.col(body).alias("content"),
        source_host(F.col("url")).alias("source"), F.lit(None).cast("timestamp").alias("date"),
    )
    return _with_clean_content(with_page_title(rows, "content", "url", "title"))


def payload_rejects(payloads: DataFrame) -> DataFrame:
    """Payloads that give no article because they failed or cannot be read, with the reason."""
    routed = route_payloads(payloads)
    failed = F.coalesce(F.col("http_status") >= 400, F.lit(True)) | F.col("body").isNull()
    bad_json = (F.col("route") == "github") & F.from_json("body", GITHUB_RELEASES).isNull()
    bad_xml = (F.col("route") == "feed") & _parse_feed(F.col("body"))["_corrupt"].isNotNull()
    reason = F.when(failed, "failed").when(bad_json, "bad_json").when(bad_xml, "bad_xml")
    return routed.select("url", "route", computed_once(reason).alias("reason")).where(F.col("reason").isNotNull())


def scraped_articles(payloads: DataFrame) -> DataFrame:
    """Articles of every readable payload; an unreadable one costs only itself.

    All routes share one scan and one cleaning step, instead of a scan of the payloads per route.
    """
    github, feed, html = (F.col("route") == name for name in ("github", "feed", "html"))
    readable = payloads.where((F.col("http_status") < 400) & F.col("body").isNotNull())
    routed = readable.select(
        "seq", F.col("url").alias("endpoint"), "body",
        computed_once(payload_route(F.col("url"), F.col("content_type"), F.col("body"))).alias("route"),
    )
    parsed = routed.select(
        "seq", "endpoint", "route", F.when(html, F.col("body")).alias("page"),
        computed_once(F.when(github, F.from_json("body", GITHUB_RELEASES))).alias("releases"),
        computed_once(F.when(feed, _parse_feed(F.col("body")))).alias("doc"),
    )
    listed = with_page_title(parsed, "page", "endpoint", "page_title").select(
        "seq", "endpoint", "route", "page", "page_title", "releases", computed_once(_feed_array(F.col("doc"))).alias("items")
    )
    nothing = {name: F.lit(None).cast(listed.schema[name].dataType.elementType) for name in ("releases", "items")}
    entries = (
        F.when(github, F.transform("releases", lambda r: F.struct(r.alias("release"), nothing["items"].alias("item"))))
        .when(feed, F.transform("items", lambda i: F.struct(nothing["releases"].alias("release"), i.alias("item"))))
        .otherwise(F.array(F.struct(nothing["releases"].alias("release"), nothing["items"].alias("item"))))
    )
    rows = listed.select("seq", "endpoint", "route", "page", "page_title", computed_once(entries).alias("entries"))
    rows = rows.select("seq", "endpoint", "route", "page", "page_title", F.posexplode("entries").alias("pos", "entry"))
    rows = rows.where(~F.coalesce("entry.release.draft", F.lit(False)))
    release = _release_columns(F.col("entry.release"), F.col("endpoint"))
    item = _item_columns(F.col("entry.item"), F.col("endpoint"))
    page = {
        "title": F.col("page_title"), "url": F.col("endpoint"), "content": F.col("page"),
        "source": source_host(F.col("endpoint")), "date": F.lit(None).cast("timestamp"),
    }
    columns = {name: F.when(github, release[name]).when(feed, item[name]).otherwise(page[name]) for name in page}
    rows = rows.select("seq", "endpoint", "pos", "route", *[c.alias(name) for name, c in columns.items()])
    # Release notes are Markdown already.
    rows = with_markdown(rows.withColumn("_markup", F.when(~github, F.col("content"))), "_markup", "_clean")
    return rows.withColumn("content", F.coalesce("_clean", "content")).select(
        "seq", "endpoint", "pos", "title", "url", "content", "source", "date"
    )
