"""Inputs of the queries, derived at run time from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslake.functions.tags import detect_tags
from newslake.functions.text import article_id
from newslake.schemas import article_columns
from newslake.session import prepare, spread

# Words that are frequent in the generated prose, as a second tag dictionary.
PROSE_KEYWORDS = {
    "English": ["the", "and", "with"],
    "French": ["eau", "ment"],
    "German": ["keit", "ung", "sch"],
    "Spanish": ["ción", "ado"],
}
PAGE_SPAN = 400  # documents per landed page: numbers of one page lie within this span
FEED_SPAN = 100


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, TEXT_KEYS[name]) if name in TEXT_KEYS else rows


def as_articles(documents: DataFrame) -> DataFrame:
    """Every document as an article; works on a stream of documents too."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string"))
    kind = F.element_at(F.array(F.lit("batch"), F.lit("online"), F.lit("chat")), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents.select(
        "doc_id",
        F.col("doc_id").alias("seq"),
        "lang",
        *article_columns(
            article_id=article_id(url),
            title=F.substring("text", 1, 40),
            source=F.col("source"),
            date=F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600),
            content=F.col("text"),
            url=url,
            type=kind,
        ),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(table(spark, sf_dir, "documents"))


def iso_z(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def raw_newsapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of news API articles, with the gaps such payloads have."""
    n = F.col("doc_id")
    text = F.when(n % 4 == 0, F.concat(F.lit("<p>"), "content", F.lit("</p>"))).otherwise(F.col("content"))
    return docs(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("topic"),
        F.struct(
            F.struct(F.lit(None).cast("string").alias("id"), F.when(n % 13 != 0, F.col("source")).alias("name")).alias("source"),
            F.lit(None).cast("string").alias("author"),
            F.when(n % 19 != 0, F.col("title")).alias("title"),
            F.when(n % 5 == 4, F.lit("")).when(n % 5 != 0, text).alias("description"),
            F.when(n % 17 != 0, F.col("url")).alias("url"),
            F.lit(None).cast("string").alias("urlToImage"),
            F.when(n % 11 == 0, F.lit("yesterday")).otherwise(iso_z(F.col("date"))).alias("publishedAt"),
            F.when(n % 7 != 0, text).alias("content"),
        ).alias("article"),
    )


def newsapi_payloads(spark: SparkSession, sf_dir: str, bad: str) -> DataFrame:
    """Landed pages: one per topic and span of document numbers, so a page has a bounded size.

    ``bad`` is a SQL condition on ``number`` (of the topic) and ``page``.
    """
    raw = raw_newsapi(spark, sf_dir).withColumn("page", F.floor(F.col("doc_id") / PAGE_SPAN).cast("int") + 1)
    pages = raw.groupBy("topic", "page").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "article"))).alias("rows")
    ).withColumn("number", F.substring("topic", 4, 9).cast("int")).withColumn("bad", F.expr(bad))
    body = F.to_json(F.struct(
        F.lit("ok").alias("status"), F.size("rows").alias("totalResults"),
        F.transform("rows", lambda r: r["article"]).alias("articles"),
    ))
    return pages.select(
        "topic", "page",
        F.when(F.col("bad"), 429).otherwise(200).alias("http_status"),
        F.when(F.col("bad"), F.lit('{"status": "error", "code": "maximumResultsReached"}')).otherwise(body).alias("body"),
    )


STOPS = "(number + page) % 5 = 0"
FAILED_TOPICS = "number % 5 = 4"


def github_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    release = F.struct(
        (n % 9 == 0).alias("draft"),
        F.when(n % 4 == 1, F.lit("")).when(n % 4 != 0, F.col("title")).alias("name"),
        F.when(n % 8 != 0, F.concat(F.lit("v"), n.cast("string"))).alias("tag_name"),
        F.when(n % 10 != 0, F.col("url")).alias("html_url"),
        F.when(n % 7 != 0, F.col("content")).alias("body"),
        F.when(n % 6 != 0, iso_z(F.col("date"))).alias("published_at"),
        iso_z(F.col("date") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
    )
    rows = docs(spark, sf_dir).withColumn("span", F.floor(n / FEED_SPAN)).withColumn("release", release)
    lists = rows.groupBy("source", "lang", "span").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "release"))).alias("rows"), F.min("doc_id").alias("seq")
    )
    url = F.concat(F.lit("https://api.github.com/repos/"), "source", F.lit("/"), "lang", F.lit("/releases?page="), "span")
    return lists.select(
        "seq", url.alias("url"), F.lit(200).alias("http_status"), F.lit("application/json").alias("content_type"),
        F.to_json(F.transform("rows", lambda r: r["release"])).alias("body"),
    )


def xml_text(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of one source and span of documents, RSS and Atom in turn."""
    n = F.col("doc_id")
    html = F.concat(F.lit("<h2>"), "lang", F.lit("</h2><p>"), "content", F.lit("</p>"))
    rfc = F.concat(F.date_format("date", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))

    def item(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    rss = item(
        "<item><title>", xml_text(F.col("title")), "</title><link>", F.col("url"), "</link>",
        F.when(n % 3 == 0, item("<content:encoded>", xml_text(html), "</content:encoded>")).otherwise(F.lit("")),
        "<description>", xml_text(F.col("content")), "</description><pubDate>Mon, ", rfc, "</pubDate></item>",
    )
    atom = item(
        "<entry><title>", xml_text(F.col("title")), '</title><link href="', F.col("url"), '"/>',
        F.when(n % 3 == 0, item('<content type="html">', xml_text(html), "</content>")).otherwise(F.lit("")),
        "<summary>", xml_text(F.col("content")), "</summary><updated>", iso_z(F.col("date")), "</updated></entry>",
    )
    rows = docs(spark, sf_dir).withColumn("span", F.floor(n / FEED_SPAN).cast("int"))
    rows = rows.withColumn("item", F.when(F.col("span") % 2 == 0, rss).otherwise(atom))
    lists = rows.groupBy("source", "span").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("rows"), F.min("doc_id").alias("seq")
    )
    items = F.array_join(F.transform("rows", lambda r: r["item"]), "")
    body = F.when(
        F.col("span") % 2 == 0,
        item('<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
             "<title>feed</title>", items, "</channel></rss>"),
    ).otherwise(item('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>', items, "</feed>"))
    url = F.concat(F.lit("https://www."), "source", F.lit(".example.org/feed/"), "span")
    return lists.select(
        "seq", url.alias("url"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("content_type"),
        body.alias("body"),
    )


def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), "url", F.lit(200).alias("http_status"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("body"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scraped payloads; their arrival numbers interleave and are made unique."""
    parts = [github_payloads(spark, sf_dir), feed_payloads(spark, sf_dir), page_payloads(spark, sf_dir)]
    out = None
    for i, part in enumerate(parts):
        order = F.struct("seq", F.lit(i).alias("kind"), F.col("url").alias("at"))
        part = part.withColumn("seq", order)
        out = part if out is None else out.unionByName(part)
    return out


def broken_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads with failed fetches and cut bodies among them."""
    n = F.col("seq.seq") % 5
    cut = F.col("seq.kind") < 2
    return payloads(spark, sf_dir).withColumns({
        "http_status": F.when(n == 2, 500).otherwise(F.col("http_status")),
        "body": F.when((n == 1) & cut, F.expr("substring(body, 1, length(body) - 5)")).otherwise(F.col("body")),
    })


def hn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of one snapshot per day, newest first."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("snapshot"),
        (-n).alias("pos"),
        n.alias("id"),
        F.when(F.col("event_type") == "error", "comment").otherwise("story").alias("type"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"),
        F.col("event_type").alias("title"),
        F.when(n % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("https://hn.example.org/"), n.cast("string"))).alias("url"),
        F.floor("value").cast("int").alias("score"),
        F.when(n % 4 != 0, (n % 50).cast("int")).alias("descendants"),
        F.when(n % 5 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("by"),
    )


def snapshot_time() -> Column:
    """A snapshot is read one hour after its day."""
    return F.col("snapshot").cast("timestamp") + F.make_dt_interval(days=F.lit(1), hours=F.lit(1))


def dedupe_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with urls and titles that collide: 256 values of each."""
    n = F.col("doc_id").cast("string")
    key = lambda mark: F.concat(F.lit(mark), F.substring(F.md5(F.concat(n, F.lit(mark)).cast("binary")), 1, 2))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), key("u").alias("url"), F.lit("s").alias("source"), key("t").alias("title")
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with dense vectors: four documents in a row form one article."""
    n = F.col("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    article = F.concat(F.lit("a"), F.floor(n / 4).cast("string"))
    return docs(spark, sf_dir).join(vectors, "doc_id").select(
        F.concat(article, F.lit("-"), (n % 4).cast("string")).alias("chunk_id"),
        article.alias("article_id"),
        (n % 4).cast("int").alias("chunk_index"),
        "content", "title", "source", "url", "date", "author",
        detect_tags(F.col("content"), F.col("title"), PROSE_KEYWORDS).alias("tags"),
        "type",
        F.lit("2024-06-01").cast("timestamp").alias("fetched_at"),
        "embedding",
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a question."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("question_id"), "embedding"
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text side of ``vector_questions``: one per vector that has a document."""
    n = F.col("doc_id")
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 30).cast("int"))
    return docs(spark, sf_dir).join(ids, "doc_id").select(
        F.concat(F.lit("q"), n.cast("string")).alias("question_id"),
        F.col("title").alias("question"),
        F.array("source", F.concat(F.lit("src"), (n % 20).cast("string"))).alias("topics"),
        day.alias("snapshot"),
        (n % 7 != 0).alias("llm_configured"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.to_json(F.struct(F.col("title").alias("answer"))))
        .otherwise(F.concat(F.lit("  "), "title")).alias("raw_answer"),
    )


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a text question."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("query"),
    )


def doc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into fixed windows."""
    from newslake.operators.chunking import fixed_chunks

    rows = fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns; every third one wrapped as a JSON object, every seventh as another JSON value."""
    n = F.col("conv_id") + F.col("turn")
    wrapped = F.to_json(F.struct(F.col("text").alias("answer"), F.col("role").alias("by")))
    raw = F.when(n % 3 == 0, wrapped).when(n % 7 == 0, F.to_json(F.array("text"))).otherwise(
        F.concat(F.lit(" \n"), "text", F.lit("\t "))
    )
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", raw.alias("raw")
    )


def turn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question of its conversation's hour; the reply that follows is the model's raw answer."""
    conv, turn = F.col("conv_id"), F.col("turn")
    replies = model_replies(spark, sf_dir).select("conv_id", (turn - 1).alias("turn"), F.col("raw").alias("raw_answer"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").join(replies, ["conv_id", "turn"], "left")
    topics = F.array(F.concat(F.lit("src"), (conv % 20).cast("string")), F.concat(F.lit("src"), (turn % 20).cast("string")))
    time = F.timestamp_seconds(F.lit(1706745600) + conv * 3600 + turn * 60)
    return asked.select(
        F.concat_ws(":", conv.cast("string"), turn.cast("string")).alias("question_id"),
        F.col("text").alias("question"),
        F.when(conv % 3 != 0, topics).otherwise(F.array().cast("array<string>")).alias("topics"),
        time.alias("asked_at"),
        (time + F.make_dt_interval(mins=F.lit(1))).alias("stored_at"),
        F.date_add(F.lit("2024-01-01").cast("date"), (conv % 30).cast("int")).alias("snapshot"),
        F.lit(True).alias("llm_configured"),
        "raw_answer",
    )


ARRIVAL_DAYS, LATE_FILES = 4, 3


def event_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals of articles, one per user and kind, in files of four days each; every tenth comes three files
    late. In a file each article arrives once."""
    url = F.concat(F.lit("https://events.example.org/"), F.col("user_id").cast("string"), F.lit("/"), "event_type")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    late = F.when(F.col("event_id") % 10 == 3, LATE_FILES).otherwise(0)
    rows = table(spark, sf_dir, "events").withColumn("file", (F.floor(day / ARRIVAL_DAYS) + late).cast("int"))
    return rows.groupBy("file", article_id(url).alias("article_id"), "user_id", "event_type").agg(
        F.min(F.col("ts").cast("timestamp")).alias("date")
    )


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with boilerplate as sites have it: marked by class or id, and nested in elements of its own kind."""
    n = F.col("page_id").cast("string")
    banner = F.concat(
        F.lit('<div class="big cookie-banner">Accept <div>our <div id="x'), n, F.lit('">many</div></div> cookies<br></div>')
    )
    promo = F.concat(
        F.lit("<section data-n='1' id='top-advert-"), n,
        F.lit("'><h2>Buy</h2><section><p>now</p><img src=\"a.png\"></section></section>"),
    )
    menu = F.lit('<nav><ul><li>a</li></ul><nav class="sub">b<aside>c</aside></nav>d</nav>')
    kept = F.lit('<div class="Cookies are fine"><section>kept</section></div>')
    extra = F.when(F.col("page_id") % 3 == 0, F.concat(banner, kept)).when(
        F.col("page_id") % 3 == 1, F.concat(promo, menu)
    ).otherwise(F.concat(F.lit("<div>"), menu, banner, F.lit("</div>"), kept, promo))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.replace("html", F.lit("<article>"), F.concat(extra, F.lit("<article>"))).alias("html")
    )


def rich_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fragments with nested emphasis, nested lists, a table and the whole text preformatted."""
    n, text = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit("<nav>menu</nav><h2>"), "source", F.lit("</h2><p>Some <b>bold <i>"), "lang", F.lit("</i> and <code>"), n,
        F.lit("</code></b> text, <em>see <a href='https://e.org/?a=1&amp;b=2'>this</a></em></p><ol start=3><li>one</li><li>two<ul><li>"),
        "source", F.lit("</li><li>b</li></ul></li><li>last</li></ol><table><tr><th>a</th><th>b|c</th></tr><tr><td>"), "lang",
        F.lit("</td><td><b>"), n, F.lit("</b></td></tr></table><pre>"), text, F.lit("</pre><p>end</p>"),
    ).alias("html"))
