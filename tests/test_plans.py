"""The plans the operators are meant to have."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from newslake.operators import search, upsert
from newslake.operators.chunking import chunk_records
from newslake.operators.ranking import first_per_group
from newslake.operators.vectorise import fit_idf
from newslake.sources import newsapi
from newslake.sources.gate import ingest_gate
from newslake.sources.scraped import feed_items, html_pages, scraped_articles
from newslake.workload import views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_type_filter_and_columns_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a-0", "online", "text", [1.0]), ("b-0", "chat", "text", [1.0])], "chunk_id STRING, type STRING, content STRING, embedding ARRAY<FLOAT>"
    )
    chunks = upsert.read_snapshot(spark, upsert.write_snapshot(rows, str(tmp_path)))
    questions = spark.createDataFrame([("q", [1.0])], "question_id STRING, embedding ARRAY<FLOAT>")
    hits = search.top_k_of_type(questions, chunks, "online", 4)
    text = plan(hits)
    assert re.search(r"PartitionFilters: \[[^\]]*type#\d+ = online", text)
    assert "ReadSchema: struct<chunk_id:string,embedding:array<float>>" in text
    assert [r["chunk_id"] for r in hits.collect()] == ["a-0"]


def test_records_are_made_without_a_shuffle(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://x.example", "<h1>a</h1><p>b</p>")], "seq INT, url STRING, body STRING")
    pages.write.parquet(str(tmp_path / "pages"))
    articles = ingest_gate(html_pages(spark.read.parquet(str(tmp_path / "pages"))))
    text = plan(chunk_records(articles, F.lit("2024-06-01")))
    assert "Exchange" not in text
    # The ladder runs once, although the gate, the tags and the chunker all read its result.
    assert text.count("<blockquote") == 1


def test_feeds_are_parsed_once(spark, sf_dir):
    payloads = views.feed_payloads(spark, sf_dir)
    assert plan(feed_items(payloads)).count("from_xml(") == 1


def test_groups_are_limited_before_the_shuffle(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 2)
    text = plan(first_per_group(rows, ["g"], [F.col("id")], 3, rank="r"))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_idf_moves_counts_only(spark):
    texts = spark.createDataFrame([("some text",)], "content STRING")
    text = plan(fit_idf(texts))
    shuffled = text[: text.index("MapInArrow")]
    assert text.count("Exchange") == 1 and "partial_sum" in shuffled and "content" not in shuffled


def test_payload_routes_share_one_scan(spark, tmp_path):
    landed = spark.createDataFrame([(1, "https://x.example", 200, "", "<p>a</p>")], "seq INT, url STRING, http_status INT, content_type STRING, body STRING")
    landed.write.parquet(str(tmp_path / "landed"))
    text = plan(scraped_articles(spark.read.parquet(str(tmp_path / "landed"))))
    assert [text.count(part) for part in ("FileScan", "from_xml(", "from_json(", "<blockquote")] == [1, 1, 1, 1]


def test_news_pages_are_parsed_once_and_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 1, 200, '{"status": "ok", "articles": [{"url": "u", "description": "d"}]}'), ("a", 2, 429, "{}")],
        "topic STRING, page INT, http_status INT, body STRING",
    )
    rows.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    for df in (newsapi.newsapi_articles(pages), newsapi.accept_page_prefix(pages)):
        text = plan(df)
        assert text.count("from_json(") == 1 and "Exchange hashpartitioning(topic" not in text
    assert newsapi.newsapi_articles(pages).count() == 1
