"""One query per operator, each over the whole of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.functions import tags as tag_functions
from newslake.functions.chunker import MAX_CHARS, register_split_text
from newslake.functions.dates import normalise_date
from newslake.functions.html import strip_tag_pairs, with_boilerplate_cut, with_markdown
from newslake.functions.text import (
    article_id,
    chunk_article,
    chunk_index,
    expand_query,
    extract_answer,
    is_recent,
    join_tags,
    repo_name,
    source_host,
    split_tags,
    tag_union,
)
from newslake.operators import cells, chunking, context, neighbours, search, sparse, summary, tagging, upsert, vectorise
from newslake.operators.dedupe import dedupe
from newslake.plans import answer, ingest
from newslake.session import materialise, new_folder
from newslake.sources import catalogue, gate, hackernews, newsapi, scraped
from newslake.streaming import fresh as fresh_stream
from newslake.streaming import index as index_stream
from newslake.streaming import trending as trending_stream
from newslake.workload import views

FETCHED = "2024-06-01"


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def fetched() -> Column:
    return F.lit(FETCHED).cast("timestamp")


def last_date(docs: DataFrame) -> Column:
    return docs.agg(F.max("date").alias("d")).scalar()


# Sources

def newsapi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.newsapi_payloads(spark, sf_dir, views.STOPS)
    return newsapi.newsapi_articles(pages, pages_per_topic=None)


def newsapi_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the fetch limit of pages, as a fetcher would have landed them."""
    pages = views.newsapi_payloads(spark, sf_dir, views.STOPS)
    return newsapi.newsapi_articles(pages, pages_per_topic=newsapi.PAGES_PER_TOPIC)


def accept_page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.newsapi_payloads(spark, sf_dir, views.STOPS)
    kept = newsapi.accept_page_prefix(pages, pages_per_topic=None)
    return kept.select("topic", "page", F.size("envelope.articles").alias("n_articles"))


def newsapi_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = newsapi.parse_pages(views.newsapi_payloads(spark, sf_dir, views.STOPS)).where("not bad")
    typed = newsapi.typed_articles(newsapi.page_articles(pages))
    return typed.select("article_id", "title", "source", stamp("date").alias("date"), "content", "url")


def fresh_top_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.newsapi_payloads(spark, sf_dir, views.FAILED_TOPICS)
    top = newsapi.newest_per_topic(pages, last_date(views.docs(spark, sf_dir)))
    return top.select("topic", "topic_rank", F.coalesce("url", F.lit("")).alias("url"), "publishedAt")


def fresh_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_newsapi(spark, sf_dir).select("doc_id", "topic", "article.*")
    kept = newsapi.fresh_articles(raw, order=["doc_id"])
    return kept.select(
        "article_id", "title", "source", stamp("date").alias("date"), "content", "url",
        join_tags(F.col("tags")).alias("tags"), "type",
    )


def _raw_columns(rows: DataFrame) -> DataFrame:
    return rows.select("endpoint", "pos", "title", "url", "content", "source", stamp("date").alias("date"))


def github_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_columns(scraped.github_releases(views.github_payloads(spark, sf_dir)))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_columns(scraped.feed_items(views.feed_payloads(spark, sf_dir)))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scraped.html_pages(views.page_payloads(spark, sf_dir)).select("url", "title", "content", "source")


def route_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scraped.route_payloads(views.payloads(spark, sf_dir)).select("url", "route")


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scraped.payload_rejects(views.broken_payloads(spark, sf_dir))


def hn_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.hn_items(spark, sf_dir)
    stories = hackernews.recent_stories(items, views.snapshot_time())
    return stories.select(
        F.col("snapshot").cast("string").alias("snapshot"), "feed_rank", "article_id", "title", "source",
        stamp("date").alias("date"), "content", "url", "author", "type",
    )


def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = views.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("repo"))
    return catalogue.default_urls(spark).unionByName(catalogue.release_urls(watched.distinct()))


def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per topic of the catalogue; one of six slugs is not in it."""
    slugs = F.array(*[F.lit(x) for x, _ in catalogue.TOPICS], F.lit("other"))
    rows = views.table(spark, sf_dir, "documents").select(F.get(slugs, (F.col("doc_id") % 6).cast("int")).alias("slug"))
    return catalogue.with_topic_label(rows, "slug").groupBy("slug", "label").agg(F.count("*").alias("n"))


def _gate_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return views.docs(spark, sf_dir).select(
        "doc_id",
        F.when(n % 17 == 0, F.lit("")).when(n % 23 != 0, F.col("url")).alias("url"),
        F.when(n % 10 != 0, F.col("content")).alias("content"),
        F.when(n % 19 != 0, F.col("title")).alias("title"),
        F.col("source"),
        F.when(n % 29 == 0, F.lit("soon")).otherwise(views.iso_z(F.col("date"))).alias("date"),
    )


def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = gate.ingest_gate(_gate_input(spark, sf_dir), keep=("doc_id",))
    return kept.select("doc_id", "article_id", "title", "source", stamp("date").alias("date"), "content", "url", "type")


def gate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_rejects(_gate_input(spark, sf_dir)).select("doc_id", "reason")


# Scalar functions

def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", article_id(F.col("url")).alias("article_id"))


def default_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    name = F.to_json(F.struct(F.struct(F.col("source").alias("name")).alias("source")))
    body = F.when(n % 3 == 0, name).when(n % 3 == 1, F.lit('{"source": {"id": null}}')).otherwise(
        F.lit('{"source": {"name": null}}')
    )
    return views.table(spark, sf_dir, "documents").select("doc_id", newsapi.source_name(body).alias("name"))


def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", strip_tag_pairs(F.col("html")).alias("html"))


def strip_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole boilerplate removal: elements, and subtrees marked by class or id, however they nest."""
    return with_boilerplate_cut(views.marked_pages(spark, sf_dir), "html", "cut").select("page_id", F.col("cut").alias("html"))


def pages_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_markdown(views.table(spark, sf_dir, "pages"), "html", "markdown").select("page_id", "markdown")


def nested_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_markdown(views.rich_fragments(spark, sf_dir), "html", "markdown").select("doc_id", "markdown")


def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    date = F.col("date")
    rfc = F.date_format(date, "d MMM yyyy HH:mm:ss")
    text = (
        F.when(n % 6 == 0, views.iso_z(date))
        .when(n % 6 == 1, F.concat(F.lit("Tue, "), rfc, F.lit(" GMT")))
        .when(n % 6 == 2, F.concat(rfc, F.lit(" +0200")))
        .when(n % 6 == 3, F.concat(F.lit(" "), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:30 ")))
        .when(n % 6 == 4, F.date_format(date, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("about "), rfc))
    )
    return views.docs(spark, sf_dir).select("doc_id", stamp(normalise_date(text)).alias("date"))


def url_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", source_host(F.col("url")).alias("source"))


def repo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = views.payloads(spark, sf_dir)
    return every.select("url", repo_name(F.col("url")).alias("repo"))


def detect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.docs(spark, sf_dir)
    builtin = tag_functions.detect_tags(F.col("content"), F.col("title"))
    prose = tag_functions.detect_tags(F.col("content"), F.col("title"), views.PROSE_KEYWORDS)
    return docs.select("doc_id", join_tags(builtin).alias("tags"), join_tags(prose).alias("prose_tags"))


def tag_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = tag_functions.detect_tags(F.col("content"), F.col("title"), views.PROSE_KEYWORDS)
    own = F.array("source", F.lit("French"), "lang")
    return views.docs(spark, sf_dir).select("doc_id", join_tags(tag_union(own, prose)).alias("tags"))


def split_tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    csv = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit(" , ")).otherwise(
        F.concat(F.lit(" "), "source", F.lit(" ,, "), "lang", F.lit(", "), F.substring("text", 1, 20))
    )
    parts = split_tags(csv)
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(parts).alias("n"), F.array_join(parts, "|").alias("tags")
    )


def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = F.when(F.col("turn") % 2 == 0, F.array(F.lit("python"), "role")).otherwise(F.array())
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", expand_query(F.col("text"), topics).alias("query")
    )


def parse_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    id_text = n.cast("string")
    chunk = F.when(n % 4 == 0, F.concat(F.lit("hn-"), id_text, F.lit("-"), (n % 9).cast("string"))).when(
        n % 4 == 1, F.concat("event_type", F.lit("-"), id_text)
    ).when(n % 4 == 2, F.concat(id_text, F.lit("-"), "event_type")).otherwise(id_text)
    return views.table(spark, sf_dir, "events").select(
        "event_id", chunk_article(chunk).alias("article_id"),
        chunk_index(chunk).cast("string").alias("chunk_index"),
    )


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = context.question_turns(views.table(spark, sf_dir, "conversations"))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    records = context.chat_records(turns, key, fetched())
    return records.select("article_id", "title", "source", stamp("date").alias("date"), "content", "url", "author", "type")


def extract_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = views.model_replies(spark, sf_dir)
    return replies.select("conv_id", "turn", extract_answer(F.col("raw")).alias("answer"))


def recent_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.docs(spark, sf_dir)
    return docs.where(is_recent(F.col("date"), last_date(docs))).select("doc_id", "title", stamp("date").alias("date"))


def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = views.docs(spark, sf_dir).withColumns({
        "date": F.when(F.col("doc_id") % 3 != 0, F.col("date")), "tags": F.array("source", "lang"),
    })
    return context.export_documents(dated)


def import_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export read back."""
    rows = context.import_documents(export_documents(spark, sf_dir))
    return rows.select(
        "article_id", "title", "source", stamp("date").alias("date"), "content", "url", F.size("tags").alias("n_tags"),
        F.array_join("tags", "|").alias("tags"), "type",
    )


# Table functions

def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_articles(views.table(spark, sf_dir, "documents"), "doc_id", "text")


def split_text_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker as a SQL table function."""
    register_split_text(spark)
    documents = views.table(spark, sf_dir, "documents")
    return spark.sql(
        "SELECT d.doc_id, c.chunk_index, c.content FROM {documents} d, LATERAL split_text(d.text, 1200, 120) c",
        documents=documents,
    )


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the chunks of every text, whole texts compared."""
    texts = views.table(spark, sf_dir, "documents").withColumn("pieces", chunking.chunk_text(F.col("text")))
    first, last = F.try_element_at("pieces", F.lit(1)), F.try_element_at("pieces", F.lit(-1))
    short = F.length("text") <= MAX_CHARS
    return texts.select(
        "doc_id",
        short.alias("short"),
        F.when(short, F.size("pieces")).otherwise(0).alias("pieces_if_short"),
        F.forall("pieces", lambda p: F.length(p) <= MAX_CHARS).alias("all_fit"),
        F.forall("pieces", lambda p: F.contains("text", p)).alias("all_from_text"),
        F.startswith("text", first).alias("starts"),
        F.endswith("text", last).alias("ends"),
        (F.aggregate("pieces", F.lit(0), lambda n, p: n + F.length(p)) >= F.length("text") - F.size("pieces")).alias("covers"),
    )


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(views.table(spark, sf_dir, "documents"), "doc_id", "text")


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.docs(spark, sf_dir)
    records = chunking.chunk_records(docs.drop("seq", "lang"), fetched(), keywords=views.PROSE_KEYWORDS)
    return records.groupBy("article_id").agg(
        F.min("chunk_id").alias("first_id"),
        (F.max("chunk_index") + 1 == F.count("*")).alias("dense"),
        F.max(join_tags(F.col("tags"))).alias("tags"),
        F.max(stamp("fetched_at")).alias("fetched_at"),
        F.max("type").alias("type"),
    )


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.docs(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 6 != 0, F.col("content")).otherwise("  "))
    return chunking.stored_articles(chunking.chunk_records(docs, fetched()))


# Search

def _dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(views.vector_questions(spark, sf_dir), views.chunk_vectors(spark, sf_dir))


def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense_hits(spark, sf_dir)


def topk_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks = views.vector_questions(spark, sf_dir), views.chunk_vectors(spark, sf_dir)
    return search.top_k_of_type(questions, chunks, "online", search.ONLINE_HITS)


def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks = views.vector_questions(spark, sf_dir), views.chunk_vectors(spark, sf_dir)
    hits = search.top_k_of_type(questions, chunks, "chat", search.HISTORY_HITS)
    found = search.fetch(hits, chunks.drop("embedding"), ["chunk_id"])
    return found.select("question_id", "rank", "content", "title", stamp("date").alias("date"))


def neighbor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_ids(materialise(_dense_hits(spark, sf_dir), "hits"))


def neighbor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = materialise(_dense_hits(spark, sf_dir), "hits")
    found = neighbours.neighbour_chunks(hits, views.chunk_vectors(spark, sf_dir).drop("embedding"))
    return found.select("question_id", "pos", "chunk_id", "content", "title", "distance")


def tag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tag_functions.keyword_table(spark, {**tag_functions.TAG_KEYWORDS, **views.PROSE_KEYWORDS})
    return tagging.tag_join(views.table(spark, sf_dir, "documents"), words, "doc_id", "text")


def tag_join_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of several thousand keywords: the first three words of every document, tagged by their length."""
    documents = views.table(spark, sf_dir, "documents")
    words = documents.select(F.explode(F.slice(F.split(F.lower("text"), " "), 1, 3)).alias("keyword")).distinct()
    words = words.where("length(keyword) > 0").select(
        F.concat(F.lit("length "), F.length("keyword").cast("string")).alias("tag"), "keyword"
    )
    return tagging.tag_join(documents, words, "doc_id", "text")


def topk_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = views.doc_windows(spark, sf_dir).select("chunk_id", "content")
    counted = materialise(sparse.term_counts(windows), "counts")
    idf = materialise(sparse.idf_of_counts(counted), "idf")
    questions = sparse.term_counts(views.user_turns(spark, sf_dir), "query")
    return sparse.top_k_sparse(sparse.weigh(questions, idf), sparse.weigh(counted, idf))


def _cells(spark: SparkSession, sf_dir: str) -> cells.CellIndex:
    return cells.build_cells(views.chunk_vectors(spark, sf_dir).select("chunk_id", "embedding"))


def topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search over chunks stored by cell."""
    return cells.search_cells(_cells(spark, sf_dir), views.vector_questions(spark, sf_dir), exact=True)


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of the nearest cells only, for all questions, against the exact one."""
    index, questions = _cells(spark, sf_dir), views.vector_questions(spark, sf_dir)
    found = cells.search_cells(index, questions, probes=cells.probes_for(index, questions))
    both = cells.recall(found, search.top_k(questions, views.chunk_vectors(spark, sf_dir)))
    return both.select("n_wanted", (F.col("n_found") >= cells.TARGET_RECALL * F.col("n_wanted")).alias("reached"))


def topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, chunks = views.vector_questions(spark, sf_dir), views.chunk_vectors(spark, sf_dir)
    return search.top_k_approximate(questions, chunks, dims=64)


# Dedupe, aggregates, context

def dedupe_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(views.dedupe_input(spark, sf_dir))


def _upsert_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document is on file; the odd ones arrive again, changed, two times over."""
    rows = views.docs(spark, sf_dir).select(
        F.concat(F.col("article_id"), F.lit("-0")).alias("chunk_id"), "article_id", "content", "doc_id",
        fetched().alias("fetched_at"), F.lit(0).alias("seq"),
    )
    again = rows.where("doc_id % 2 = 1").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({
        "content": F.concat(F.col("seq").cast("string"), "content"),
        "fetched_at": F.col("fetched_at") + F.make_dt_interval(days=F.lit(1)),
    })
    new = again.withColumns({"chunk_id": F.concat("article_id", F.lit("-1"))})
    return rows, again.unionByName(new)


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, updates = _upsert_rows(spark, sf_dir)
    merged = upsert.upsert_chunks(rows, updates, order=("fetched_at", "seq"))
    return merged.select("chunk_id", "article_id", "content", stamp("fetched_at").alias("fetched_at"), "seq")


def upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same into a table partitioned by bucket, the updates two times over."""
    rows, updates = _upsert_rows(spark, sf_dir)
    table = f"{new_folder(spark, 'table')}/chunks"
    for part in (rows, updates, updates):
        upsert.upsert_buckets(part, table, order=("fetched_at", "seq"))
    merged = upsert.read_buckets(spark, table)
    return merged.select("chunk_id", "article_id", "content", stamp("fetched_at").alias("fetched_at"), "seq")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context items per source: its chat articles as hits, its online ones as fresh articles."""
    docs = views.docs(spark, sf_dir).withColumns({
        "question_id": F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 60).cast("string")),
        "pos": (F.col("doc_id") % 60).cast("int"),
        "tags": tag_functions.detect_tags(F.col("content"), F.col("title"), views.PROSE_KEYWORDS),
        "title": F.when(F.col("doc_id") % 19 != 0, F.col("title")),
        "source": F.when(F.col("doc_id") % 13 != 0, F.col("source")),
    })
    hits = context.context_items(docs.where("type = 'chat'"), context.RETRIEVED, "pos")
    near = context.context_items(docs.where("type = 'batch'"), context.ENRICHED, "pos")
    fresh = context.context_items(docs.where("type = 'online'"), context.NEWS, "pos")
    return context.combine_context(hits, near, fresh)


def combine_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).withColumn("tags", join_tags(F.col("tags")))


def build_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.build_cards(_items(spark, sf_dir)).withColumn("tags", join_tags(F.col("tags")))


def card_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = context.card_lists(_items(spark, sf_dir))
    return lists.select(
        "question_id", "n_cards",
        F.array_join(F.transform("cards", lambda c: F.concat(c["title"], F.lit("|"), c["snippet"])), "\n").alias("snippets"),
        join_tags(F.col("trending")).alias("trending"),
    )


def trending_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    trending = tagging.trending_tags(context.build_cards(_items(spark, sf_dir)))
    return trending.withColumn("trending", join_tags(F.col("trending")))


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.prompt_context(_items(spark, sf_dir))


def articles_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = views.docs(spark, sf_dir).withColumn(
        "tags", tag_functions.detect_tags(F.col("content"), F.col("title"), views.PROSE_KEYWORDS)
    )
    return tagging.tag_counts(tagged)


def articles_by_tag_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = views.docs(spark, sf_dir).withColumn("tags", F.array("source", "lang"))
    return tagging.tag_listing(tagged)


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _gate_input(spark, sf_dir)
    articles = gate.ingest_gate(raw, keep=("doc_id",))
    return summary.ingest_summary(raw, articles, chunking.chunk_records(articles, fetched()), order="doc_id")


def newest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.newest(views.docs(spark, sf_dir), 30).select("article_id", "title", stamp("date").alias("date"))


def _fresh_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = views.newsapi_payloads(spark, sf_dir, views.FAILED_TOPICS)
    top = newsapi.newest_per_topic(pages, last_date(views.docs(spark, sf_dir)))
    # Within a question the topics' own articles are deduped; the news of one topic arrive in rank order.
    news = newsapi.clean_fresh(top, "topic", "topic_rank")
    stories = hackernews.recent_stories(views.hn_items(spark, sf_dir), views.snapshot_time())
    return materialise(news, "news"), materialise(stories, "stories")


def _answer_context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    questions = views.asked(spark, sf_dir)
    vectors = views.vector_questions(spark, sf_dir).join(questions.select("question_id"), "question_id", "left_semi")
    chunks = materialise(views.chunk_vectors(spark, sf_dir), "chunks")
    items = answer.question_context(questions, vectors, chunks, *_fresh_parts(spark, sf_dir))
    return questions, items


def _shown_answers(out: DataFrame) -> DataFrame:
    return out.select(
        "question_id", "status", "answer", "n_cards", join_tags(F.col("trending")).alias("trending"),
        F.array_join(F.transform("cards", lambda c: F.concat_ws("|", c["title"], c["source"], c["date"], c["snippet"], c["url"], join_tags(c["tags"]))), "\n").alias("cards"),
        F.get_json_object("payload", "$.context").alias("context"),
    )


def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, items = _answer_context(spark, sf_dir)
    return _shown_answers(answer.answer_questions(questions, items))


def _question_loop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Only answered turns are chats here; the documents of that type count as batch articles."""
    questions = materialise(views.turn_questions(spark, sf_dir), "turns")
    docs = views.docs(spark, sf_dir).replace("chat", "batch", "type")
    chunks = materialise(chunking.chunk_records(docs, fetched(), keywords=views.PROSE_KEYWORDS), "records")
    counted = materialise(sparse.term_counts(chunks.select("chunk_id", "type", "content")), "counts")
    idf = materialise(sparse.idf_of_counts(counted), "idf")
    chats = materialise(answer.chat_chunks(questions, F.col("question_id"), views.PROSE_KEYWORDS), "chats")
    news, stories = _fresh_parts(spark, sf_dir)
    past, items = answer.question_loop(questions, chunks, chats, idf, news, stories, counted=counted)
    return questions, chats, past, items


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier answered questions that each user turn finds, in any conversation: those stored before it was asked."""
    questions, chats, past, _ = _question_loop(spark, sf_dir)
    found = search.fetch(past, chats.select("chunk_id", "article_id", "content", "stored_at"), ["chunk_id"])
    return found.select("question_id", "rank", "article_id", "content", stamp("stored_at").alias("stored_at"), "distance")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop for all user turns: expanded questions, the index as of each turn, answers stored and found again."""
    questions, _, _, items = _question_loop(spark, sf_dir)
    return _shown_answers(answer.answer_questions(questions, items))


def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the questions have items; statuses and answers of all."""
    n = F.col("doc_id")
    questions = views.docs(spark, sf_dir).select(
        F.concat("source", F.lit(":"), F.floor(n / 60).cast("string"), F.when(n % 2 == 0, "").otherwise("x")).alias("question_id"),
        n.alias("no"),
        F.col("title").alias("question"),
        (n % 7 != 0).alias("llm_configured"),
        F.when(n % 5 != 0, F.concat(F.lit(" "), "title", F.lit("\n"))).alias("raw_answer"),
    )
    lists = context.card_lists(_items(spark, sf_dir))
    asked = questions.withColumnRenamed("question_id", "topic").withColumn("question_id", F.col("no").cast("string"))
    per_question = lists.withColumnRenamed("question_id", "topic").join(asked.select("topic", "question_id"), "topic").drop("topic")
    out = context.compose_responses(asked, per_question)
    return out.select("question_id", "status", "answer", "n_cards", join_tags(F.col("trending")).alias("trending"))


# Vectors

def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stretched, then brought back to length 1; one row per component."""
    stretched = views.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2)).alias("embedding")
    )
    rows = vectorise.normalise_vectors(stretched).select("vec_id", F.posexplode("embedding").alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 6) + 0.0)


def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialise(sparse.term_counts(docs, "text"), "counts")
    rows = sparse.postings(sparse.weigh(counted, sparse.idf_of_counts(counted)), "doc_id")
    return rows.withColumn("weight", F.round("weight", 6))


def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the next one."""
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = vectors.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    similar = vectorise.pair_similarity(pairs, vectors, "vec_id")
    return similar.withColumn("similarity", F.round("similarity", 6) + 0.0)


# Streams

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = views.table(spark, sf_dir, "events").schema
    events = fresh_stream.file_stream(spark, f"{sf_dir}/events.parquet", schema)
    return events.withColumn("date", F.col("ts").cast("timestamp"))


def stream_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals file by file with the window of seven days: late ones are dropped, and an article counts again when
    its window has passed."""
    arrivals = materialise(views.event_arrivals(spark, sf_dir), "arrivals")
    folder = new_folder(spark, "fresh")
    for n in sorted(r["file"] for r in arrivals.select("file").distinct().collect()):
        arrivals.where(F.col("file") == n).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
    stream = fresh_stream.file_stream(spark, f"{folder}/landed", arrivals.schema, files_per_trigger=1)
    fresh_stream.run_to_files(fresh_stream.fresh_stream(stream), f"{folder}/out", f"{folder}/state")
    rows = spark.read.schema(arrivals.schema).parquet(f"{folder}/out")
    return rows.select("file", "article_id", "user_id", "event_type", stamp("date").alias("date"))


def stream_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = trending_stream.trending_stream(_event_stream(spark, sf_dir), "date", "event_type")
    folder = new_folder(spark, "trending")
    fresh_stream.run_to_files(stream, f"{folder}/out", f"{folder}/state")
    rows = spark.read.schema("window_start TIMESTAMP, window_end TIMESTAMP, tag STRING, n BIGINT").parquet(f"{folder}/out")
    return rows.select(stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "tag", "n")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents land in three parts, the last with changed texts; every chunk of the index afterwards."""
    documents = views.table(spark, sf_dir, "documents")
    changed = documents.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" Updated later.")))
    parts = [documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1"), changed]
    folder = new_folder(spark, "index")
    landed, table = f"{folder}/landed", f"{folder}/chunks"
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(landed)
        stream = fresh_stream.file_stream(spark, landed, documents.schema)
        columns = views.docs(spark, sf_dir).columns
        articles = views.as_articles(stream).select(*columns, fetched().alias("fetched_at"))
        index_stream.start_index(articles, table, f"{folder}/state").awaitTermination()
    return upsert.read_buckets(spark, table).select(
        "chunk_id", "article_id", "chunk_index", "title", "source", join_tags(F.col("tags")).alias("tags"), "content"
    )


# Whole ingests

def scrape_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads to gated articles, counted per source."""
    articles = ingest.scrape_batch(views.payloads(spark, sf_dir))
    return articles.groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("article_id").alias("n_ids"), F.sum(F.length("content")).alias("chars")
    )


def news_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed news pages to indexed chunk records."""
    articles = ingest.news_batch(views.newsapi_payloads(spark, sf_dir, views.STOPS)).withColumn(
        "seq", F.struct("topic", "page", "pos")
    )
    records = ingest.indexed_batch(articles, fetched())
    return records.where("chunk_index = 0").select("article_id", "title", "source", stamp("date").alias("date"), "type")


def full_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two news runs a day apart, from landed pages to the chunk table with vectors; every chunk afterwards."""
    idf = materialise(vectorise.fit_idf(views.table(spark, sf_dir, "documents"), "text"), "idf")
    index = None
    for day, stops in enumerate((views.FAILED_TOPICS, views.STOPS), 1):
        articles = ingest.news_batch(views.newsapi_payloads(spark, sf_dir, stops)).withColumn(
            "seq", F.struct("topic", "page", "pos")
        )
        index = ingest.ingest_to_index(index, articles, F.lit(f"2024-06-{day:02d}").cast("timestamp"), idf)
        index = materialise(index, "chunks")
    return index.select(
        "chunk_id", "article_id", "chunk_index", "content", stamp("fetched_at").alias("fetched_at"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("n_dims"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        newsapi_normalize, newsapi_first_pages, accept_page_prefix, newsapi_format, fresh_normalize, fresh_top_per_topic,
        github_releases, feed_items, page_articles, route_payloads, rejects, hn_stories, source_catalogue, topic_labels,
        ingest_gate, gate_rejects, article_ids, default_fields, strip_boilerplate, strip_marked, pages_to_markdown, nested_markdown,
        normalize_dates, url_source, repo_names, detect_tags, tag_unions, split_tag_lists, expand_queries,
        parse_chunk_ids, chat_records, extract_answers, recent_articles, export_documents, import_documents, chunk_documents,
        split_text_udtf,
        chunk_coverage, chunk_fixed, chunk_records, stored_articles, topk_cosine, topk_online, chat_context,
        neighbor_ids, neighbor_chunks, tag_join, tag_join_words, topk_sparse, topk_cells, ivf_recall, topk_lsh, dedupe_articles, upsert_chunks, upsert_table,
        combine_context, build_cards, card_snippets, trending_tags, prompt_context, articles_by_tag,
        articles_by_tag_listing, ingest_summary, newest_articles, answer_questions, chat_history, chat_turns, response_status,
        normalize_vectors, hash_vectors, pairwise_similarity, stream_fresh, stream_upsert, stream_trending,
        scrape_batch, news_batch, full_ingest,
    )
}
# Names of the blueprint where they differ from the functions above.
QUERIES["repo_name"] = QUERIES.pop("repo_names")
QUERIES["tag_union"] = QUERIES.pop("tag_unions")
QUERIES["split_tags"] = QUERIES.pop("split_tag_lists")
QUERIES["expand_query"] = QUERIES.pop("expand_queries")
