from __future__ import annotations

import json

from pyspark.sql import functions as F

from newslake.plans.ingest import indexed_batch, news_batch, scrape_batch
from newslake.sources import catalogue, gate, hackernews, newsapi, scraped

ARTICLE = {
    "source": {"id": "tn", "name": "Tech News"},
    "author": "J. Doe",
    "title": "A new model",
    "description": "A short summary.",
    "url": "https://tn.example/2026/a",
    "publishedAt": "2026-06-09T10:30:00Z",
    "content": "The first characters only",
}
PAYLOAD = "topic STRING, page INT, http_status INT, body STRING"


def page(articles, status="ok", **more):
    return json.dumps({"status": status, "articles": articles, **more})


def payloads(spark, *rows):
    return spark.createDataFrame(list(rows), PAYLOAD)


def test_normalised_article(spark):
    (row,) = newsapi.newsapi_articles(payloads(spark, ("ai", 1, 200, page([ARTICLE])))).collect()
    assert row["source"] == "NewsAPI" and row["content"] == "A short summary."
    assert row["date"] == ARTICLE["publishedAt"] and row["author"] == "J. Doe"


def test_typed_article(spark):
    bare = {**ARTICLE, "description": None, "content": None, "publishedAt": "soon", "source": {"id": "x"}}
    second = {**ARTICLE, "description": ""}
    raw = newsapi.page_articles(newsapi.parse_pages(payloads(spark, ("ai", 1, 200, page([ARTICLE, bare, second])))))
    rows = {r["content"]: r for r in newsapi.typed_articles(raw).collect()}
    assert rows["A short summary."]["source"] == "Tech News" and rows["A short summary."]["date"].year == 2026
    assert rows[""]["date"] is None and rows[""]["source"] == "NewsAPI"
    assert "The first characters only" in rows


def test_articles_without_content_are_dropped(spark):
    bare = {**ARTICLE, "description": None, "content": None}
    assert newsapi.newsapi_articles(payloads(spark, ("ai", 1, 200, page([bare])))).count() == 0


def test_no_payloads_and_errors_give_no_rows(spark):
    assert newsapi.newsapi_articles(payloads(spark)).count() == 0
    bad = payloads(spark, ("ai", 1, 401, page([], "error", code="apiKeyInvalid")), ("b", 1, 200, "{cut"), ("c", 1, 200, page([])))
    assert newsapi.newsapi_articles(bad).count() == 0


def test_pages_before_the_first_failure_are_kept(spark):
    ten = [{**ARTICLE, "url": f"https://x.example/{i}"} for i in range(10)]
    rows = payloads(
        spark,
        ("python", 1, 200, page(ten)), ("python", 2, 400, page([], "error")), ("python", 3, 200, page(ten)),
        ("web", 1, 200, page(ten)), ("web", 2, 200, page(ten)), ("web", 3, 200, page(ten)),
    )
    got = newsapi.newsapi_articles(rows).groupBy("topic").count().collect()
    assert {r["topic"]: r["count"] for r in got} == {"python": 10, "web": 30}
    got = newsapi.newsapi_articles(rows, 2).groupBy("topic").count().collect()
    assert {r["topic"]: r["count"] for r in got} == {"python": 10, "web": 20}


def test_news_batch_indexes_an_id_once(spark):
    rows = payloads(spark, ("a", 1, 200, page([ARTICLE])), ("b", 1, 200, page([{**ARTICLE, "title": "Later"}, {**ARTICLE, "url": ""}])))
    articles = news_batch(rows).withColumn("seq", F.struct("topic", "page", "pos"))
    assert articles.count() == 2
    (record,) = indexed_batch(articles, F.lit("2026-06-10")).collect()
    assert record["title"] == "Later" and record["chunk_id"].endswith("-0") and record["type"] == "batch"


def test_newest_per_topic(spark):
    dated = [{**ARTICLE, "url": f"https://x.example/{i}", "publishedAt": f"2026-06-{i:02d}T05:00:00Z"} for i in range(1, 12)]
    rows = payloads(spark, ("ai", 1, 200, page(dated)), ("web", 1, 200, page(dated)), ("web", 2, 500, None))
    top = newsapi.newest_per_topic(rows, F.lit("2026-06-09 10:00:00").cast("timestamp")).orderBy("topic_rank").collect()
    assert [(r["topic"], r["url"][-2:]) for r in top] == [("ai", s) for s in ("11", "10", "/9", "/8", "/7")]
    late = newsapi.newest_per_topic(rows, F.lit("2026-06-17 23:00:00").cast("timestamp"))
    assert sorted(r["url"][-2:] for r in late.collect()) == ["10", "11"]


def test_fresh_articles(spark):
    raw = [
        {**ARTICLE, "description": "<p>Some <b>bold</b></p>"},
        {**ARTICLE, "title": "Copy by url"},
        {**ARTICLE, "url": "https://y.example", "description": "5 * 3"},
        {**ARTICLE, "url": "", "title": "no url"},
        {**ARTICLE, "url": "https://z.example", "title": None, "source": None, "description": None, "content": "c"},
    ]
    pages = newsapi.parse_pages(payloads(spark, ("ai", 1, 200, page(raw))))
    rows = newsapi.fresh_articles(newsapi.page_articles(pages), ["page", "pos"]).collect()
    got = {r["url"]: (r["title"], r["source"], r["content"], r["tags"], r["type"]) for r in rows}
    assert got == {
        ARTICLE["url"]: ("A new model", "Tech News", "Some **bold**", ["ai"], "online"),
        "https://z.example": ("", "NewsAPI", "c", ["ai"], "online"),
    }


def test_hacker_news(spark):
    now = 1_700_000_000
    item = ("s1", 1, 10, "story", now - 100, "T", "https://t", 5, None, None)
    rows = [
        item, ("s1", 2, 11, "comment", now, "T", "https://t", 1, 1, "x"), ("s1", 3, 12, "story", now - 90_000, "old", "https://t", 1, 1, "x"),
        ("s1", 4, 13, "story", now, "", "https://t", 1, 1, "x"), ("s1", 5, 14, "story", now - 86_400, "edge", "https://t", None, 7, "me"),
        ("s1", 6, 15, "story", now, "past the top", "https://t", 1, 1, "x"), ("s1", 0, 16, "story", None, "no time", "https://t", 1, 1, "x"),
    ]
    items = spark.createDataFrame(
        rows, "snapshot STRING, pos INT, id BIGINT, type STRING, time BIGINT, title STRING, url STRING, score INT, descendants INT, `by` STRING"
    )
    got = hackernews.recent_stories(items, F.timestamp_seconds(F.lit(now)), top=6).orderBy("feed_rank").collect()
    assert [(r["article_id"], r["content"], r["author"]) for r in got] == [
        ("hn-10", "T (Score: 5 points, 0 comments)", "anonymous"), ("hn-14", "edge (Score: 0 points, 7 comments)", "me"),
    ]
    assert {r["type"] for r in got} == {"online"}


RSS = """<?xml version="1.0"?><rss xmlns:content="http://c"><channel><title>feed</title>
<item><title> One </title><link>https://f.example/1</link><content:encoded><![CDATA[<p>Full <b>text</b></p>]]></content:encoded>
<description>short</description><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Two</title><link>https://f.example/2</link><description>&lt;i&gt;only&lt;/i&gt; this</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">E</title><link rel="x" href="https://a.example/1"/>
<link href="https://a.example/other"/><summary>sum</summary><published></published><updated>2024-01-15T10:00:00Z</updated></entry></feed>"""
RELEASES = json.dumps([
    {"draft": True, "name": "no"},
    {"draft": False, "name": "", "tag_name": "v1", "html_url": "https://g.example/1", "body": "notes", "published_at": None, "created_at": "2024-01-15T10:00:00Z"},
    {"draft": False, "name": "Two"},
])
API = "https://api.github.com/repos/o/r/releases"
PAGE = "<html><head><title>t</title></head><body><h1>Head</h1><p>Body</p></body></html>"
LANDED = "seq BIGINT, url STRING, http_status INT, content_type STRING, body STRING"


def landed(spark):
    return spark.createDataFrame(
        [
            (1, "https://www.f.example/rss", 200, "text/plain", RSS), (2, "https://a.example/atom", 200, "application/atom+xml", ATOM),
            (3, API, 200, "application/json", RELEASES), (4, "https://www.p.example/x", 200, None, PAGE),
            (5, "https://e.example", 500, None, "x"), (6, API + "?page=2", 200, None, '[{"dra'),
            (7, "https://b.example/rss", 200, "text/xml", "<rss><chan"), (8, "https://n.example", 200, None, None),
        ],
        LANDED,
    )


def test_routes(spark):
    got = {r["seq"]: r["route"] for r in scraped.route_payloads(landed(spark)).collect()}
    assert got == {1: "feed", 2: "feed", 3: "github", 4: "html", 5: "html", 6: "github", 7: "feed", 8: "html"}


def test_scraped_articles_and_rejects(spark):
    rows = scraped.scraped_articles(landed(spark)).orderBy("seq", "pos").collect()
    got = [(r["seq"], r["title"], r["url"], r["content"], r["source"], r["date"] and r["date"].isoformat()) for r in rows]
    ten = "2024-01-15T10:00:00"
    assert got == [
        (1, "One", "https://f.example/1", "Full **text**", "f.example", ten),
        (1, "Two", "https://f.example/2", "*only* this", "f.example", None),
        (2, "E", "https://a.example/1", "sum", "a.example", ten),
        (3, "o/r v1", "https://g.example/1", "notes", "GitHub", ten),
        (3, "o/r Two", API, "", "GitHub", None),
        (4, "Head", "https://www.p.example/x", "# Head\n\nBody", "p.example", None),
    ]
    bad = {r["url"]: r["reason"] for r in scraped.payload_rejects(landed(spark)).collect()}
    assert bad == {
        "https://e.example": "failed", API + "?page=2": "bad_json", "https://b.example/rss": "bad_xml", "https://n.example": "failed"
    }


def test_scrape_batch_dedupes_before_the_gate(spark):
    articles = scrape_batch(landed(spark)).collect()
    assert sorted(r["title"] for r in articles) == ["E", "Head", "One", "Two", "o/r v1"]
    assert {r["type"] for r in articles} == {"batch"}


def test_gate(spark):
    raw = spark.createDataFrame(
        [("", "c", "t", None), ("u", "", "t", None), ("u", "c", None, None), ("u", "c", "t", "soon"), ("u", "c", "t", "2024-01-15T10:00:00Z")],
        "url STRING, content STRING, title STRING, date STRING",
    ).withColumn("source", F.lit("s"))
    (row,) = gate.ingest_gate(raw).collect()
    assert row["date"].isoformat() == "2024-01-15T10:00:00" and row["tags"] == []
    assert [r["reason"] for r in gate.gate_rejects(raw).collect()] == ["no_url", "no_content", "no_title", "bad_date"]


def test_catalogue(spark):
    assert {"Python", "JavaScript", "AI/ML", "DevOps", "Web"} == {r["label"] for r in catalogue.topics(spark).collect()}
    urls = [r["url"] for r in catalogue.default_urls(spark).collect()]
    assert len(urls) == 14 and "https://api.github.com/repos/vuejs/core/releases" in urls
