"""Question context: union of sources, cards, prompt text, status, chat records, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslake.functions.dates import iso_or_empty
from newslake.functions.once import computed_once
from newslake.functions.text import (
    CARD_SNIPPET_CHARS,
    CHAT_ANSWER_CHARS,
    CHAT_TITLE_CHARS,
    PROMPT_CONTENT_CHARS,
    article_id,
    extract_answer,
    head,
    join_tags,
    split_tags,
)
from newslake.schemas import article_columns

# Defaults and texts of the answers.
INDEX_TITLE, INDEX_SOURCE, FRESH_SOURCE = "Sans titre", "interne", "newsapi"
INDEX_SECTION, FRESH_SECTION = "## Index interne", "## Actualité fraîche"
NO_SOURCE = "(aucune source disponible)"
EMPTY_ANSWER = (
    "Aucun article ne couvre encore ce sujet dans l'index ou dans "
    "l'actualité collectée. Lance une ingestion pour alimenter la veille."
)
DEGRADED_ANSWER = "%d article(s) trouvé(s) pour : %s. LLM non configuré — voici les sources brutes."
FAILED_ANSWER = "Synthèse indisponible (erreur LLM). %d article(s) référencé(s)."
TRENDING_FROM = 3

RETRIEVED, ENRICHED, NEWS, STORIES, HISTORY = range(5)  # order of the groups in a context
ITEM = ("question_id", "group_no", "pos", "title", "source", "date", "content", "url", "tags")


def context_items(rows: DataFrame, group_no: int, pos: str, date: Column | None = None) -> DataFrame:
    """Rows of one source in the common form. ``date`` is text, as exported."""
    exported = iso_or_empty(F.col("date")) if date is None else date
    return rows.select(
        "question_id", F.lit(group_no).alias("group_no"), F.col(pos).cast("int").alias("pos"),
        "title", "source", exported.alias("date"), "content", "url", "tags",
    )


def history_items(chats: DataFrame) -> DataFrame:
    """Earlier questions found by search: no url, no tags."""
    rows = chats.where(F.coalesce("content", F.lit("")) != "").withColumns({
        "source": F.lit("ChatHistory"), "url": F.lit(""), "tags": F.array().cast("array<string>"),
    })
    return context_items(rows, HISTORY, "rank")


def combine_context(*parts: DataFrame) -> DataFrame:
    """All parts one after the other; nothing is deduped across them. ``(group_no, pos)`` is the order."""
    out = parts[0].select(*ITEM)
    for part in parts[1:]:
        out = out.unionByName(part.select(*ITEM))
    return out


def build_cards(items: DataFrame) -> DataFrame:
    """One card per context item, as rows."""
    indexed = F.col("group_no") <= ENRICHED
    return items.select(
        "question_id",
        "group_no",
        "pos",
        F.coalesce("title", F.lit(INDEX_TITLE)).alias("title"),
        F.coalesce("source", F.when(indexed, INDEX_SOURCE).otherwise(FRESH_SOURCE)).alias("source"),
        "date",
        head(F.coalesce("content", F.lit("")), CARD_SNIPPET_CHARS).alias("snippet"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def gather_items(items: DataFrame) -> DataFrame:
    """``(question_id, items)``: the items of a question as an array in context order.

    Contents are cut to their prompt length before the shuffle, and the k of each source bounds the array.
    """
    opening = head(F.col("content"), PROMPT_CONTENT_CHARS).alias("content")
    item = F.struct("group_no", "pos", "title", "source", "date", opening, "url", "tags")
    return items.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _context_text(items: Column) -> Column:
    """Numbered sections of one gathered array."""
    def lines(kept: Column, mark: str, with_url: bool) -> Column:
        def line(x: Column, i: Column) -> Column:
            t = {name: F.coalesce(x[name], F.lit("")) for name in ("title", "source", "date", "content", "url")}
            parts = [F.lit(f"[{mark}"), (i + 1).cast("string"), F.lit("] "), t["title"], F.lit(" — "),
                     t["source"], F.lit(" ("), t["date"], F.lit(")\n"), t["content"]]
            if with_url:
                parts += [F.lit("\n"), t["url"]]
            return F.concat(*parts)

        return F.transform(kept, line)

    none = F.array().cast("array<string>")

    def section(kept: Column, title: str, mark: str, with_url: bool) -> Column:
        return F.when(F.size(kept) > 0, F.concat(F.array(F.lit(title)), lines(kept, mark, with_url))).otherwise(none)

    indexed = F.filter(items, lambda x: x["group_no"] <= ENRICHED)
    fresh = F.filter(items, lambda x: x["group_no"] > ENRICHED)
    parts = F.concat(section(indexed, INDEX_SECTION, "", False), section(fresh, FRESH_SECTION, "F", True))
    return F.array_join(parts, "\n\n")


def prompt_context(items: DataFrame) -> DataFrame:
    """Context text per question."""
    return gather_items(items).select("question_id", _context_text(F.col("items")).alias("context"))


def card_lists(items: DataFrame) -> DataFrame:
    """``(question_id, n_cards, cards, trending, context)`` from one shuffle of the items.

    Cards are in context order. The tag counts come from the gathered cards themselves.
    """
    def card(x: Column) -> Column:
        source = F.when(x["group_no"] <= ENRICHED, INDEX_SOURCE).otherwise(FRESH_SOURCE)
        return F.struct(
            F.coalesce(x["title"], F.lit(INDEX_TITLE)).alias("title"),
            F.coalesce(x["source"], source).alias("source"),
            x["date"].alias("date"),
            head(F.coalesce(x["content"], F.lit("")), CARD_SNIPPET_CHARS).alias("snippet"),
            F.coalesce(x["url"], F.lit("")).alias("url"),
            F.coalesce(x["tags"], F.array().cast("array<string>")).alias("tags"),
        )

    lists = gather_items(items).withColumns({
        "cards": computed_once(F.transform("items", card)),
        "_tags": computed_once(F.flatten(F.filter(F.transform("items", lambda x: x["tags"]), lambda t: t.isNotNull()))),
    })
    frequent = F.filter(
        F.array_distinct("_tags"), lambda t: F.size(F.filter("_tags", lambda u: u == t)) >= TRENDING_FROM
    )
    return lists.select(
        "question_id", F.size("items").alias("n_cards"), "cards", F.array_sort(frequent).alias("trending"),
        _context_text(F.col("items")).alias("context"),
    )


def prompt_payload(question: Column, topics: Column, context: Column) -> Column:
    """The JSON message for a question, with or without sources."""
    shown = F.coalesce(context, F.lit(NO_SOURCE))
    return F.to_json(F.struct(question.alias("question"), topics.alias("topics"), shown.alias("context")))


def compose_responses(questions: DataFrame, lists: DataFrame) -> DataFrame:
    """``(question_id, status, answer, n_cards, cards, trending, payload)``.

    ``questions`` has ``llm_configured`` and ``raw_answer`` (null when the call failed). A failed call
    still has status ok; only a missing configuration degrades.
    """
    joined = questions.join(lists, "question_id", "left")
    n = F.coalesce("n_cards", F.lit(0))
    ready = F.coalesce("llm_configured", F.lit(False))
    status = F.when(n == 0, "empty").when(~ready, "degraded").otherwise("ok")
    answer = (
        F.when(n == 0, EMPTY_ANSWER)
        .when(~ready, F.format_string(DEGRADED_ANSWER, n, F.col("question")))
        .when(F.col("raw_answer").isNull(), F.format_string(FAILED_ANSWER, n))
        .otherwise(extract_answer(F.col("raw_answer")))
    )
    none = F.array()
    topics = F.col("topics") if "topics" in questions.columns else none.cast("array<string>")
    return joined.select(
        "question_id", status.alias("status"), answer.alias("answer"), n.alias("n_cards"),
        F.coalesce("cards", none).alias("cards"), F.coalesce("trending", none).alias("trending"),
        prompt_payload(F.col("question"), topics, F.col("context")).alias("payload"),
    )


def question_turns(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it, by equi-join on the turn number.

    A join instead of a window per conversation: a very long conversation is no hot group.
    """
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(replies, ["conv_id", "turn"])


def chat_records(answered: DataFrame, key: Column, date: Column) -> DataFrame:
    """Answered questions as articles of type chat. ``key`` makes the id reproducible."""
    question, answer = F.col("question"), F.col("answer")
    return answered.select(
        *article_columns(
            article_id=F.md5(F.concat(question, key.cast("string")).cast("binary")),
            title=F.concat(F.lit("Q: "), head(question, CHAT_TITLE_CHARS)),
            source=F.lit("ChatHistory"),
            date=date,
            content=F.concat(F.lit("Q: "), question, F.lit("\nA: "), head(answer, CHAT_ANSWER_CHARS)),
            url=F.lit(""),
            author=F.lit("user"),
            type=F.lit("chat"),
        )
    )


def export_documents(articles: DataFrame) -> DataFrame:
    """Articles in document form: csv tags, empty text for an absent date, type online."""
    return articles.select(
        F.col("content").alias("page_content"), "title", "source", iso_or_empty(F.col("date")).alias("date"),
        "url", join_tags(F.col("tags")).alias("tags"), F.lit("online").alias("type"),
    )


def import_documents(documents: DataFrame) -> DataFrame:
    """Documents back to articles: csv tags to a list, empty texts of date and tags to null and an empty list."""
    return documents.select(
        *article_columns(
            article_id=article_id(F.coalesce("url", F.lit(""))),
            title=F.col("title"),
            source=F.col("source"),
            date=F.try_to_timestamp(F.nullif("date", F.lit(""))),
            content=F.col("page_content"),
            url=F.col("url"),
            tags=split_tags(F.col("tags")),
            type=F.col("type"),
        )
    )
