"""The flagship query: raw web pages in, answer cards out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newslake.functions.text import join_tags
from newslake.operators.chunking import chunk_records
from newslake.operators.context import RETRIEVED, build_cards, context_items
from newslake.operators.search import fetch, top_k
from newslake.operators.vectorise import fit_idf, vectorise
from newslake.plans.answer import embed_questions
from newslake.session import materialise
from newslake.sources.gate import ingest_gate
from newslake.sources.scraped import html_pages
from newslake.workload import views


def page_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the best page chunks for every benchmark text.

    The chunk records are written once: the idf, the vectors and the cards all read them.
    """
    articles = ingest_gate(html_pages(views.page_payloads(spark, sf_dir)))
    records = materialise(chunk_records(articles, F.lit("2024-06-01").cast("timestamp")), "records")
    idf = materialise(fit_idf(records), "idf")
    chunks = vectorise(records.select("chunk_id", "content"), idf)
    asked = views.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("question_id"), F.col("text").alias("query")
    )
    hits = top_k(embed_questions(asked, idf), chunks)
    cards = build_cards(context_items(fetch(hits, records, ["chunk_id"]), RETRIEVED, "rank"))
    return cards.withColumn("tags", join_tags(F.col("tags")))
