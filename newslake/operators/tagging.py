"""Tags over tables: keyword join, trending tags, articles by tag."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 4 << 20  # of keywords, as much as an automaton holds at a time


def tag_join(
    articles: DataFrame, keywords: DataFrame, id_column: str, text: str, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``(id, tag)`` for every article row that holds a keyword of the tag; ``keywords`` is ``(tag, keyword)``.

    The same test as ``detect_tags``: a keyword is looked for in the lower-cased text and a blank after it, so an
    empty keyword fits every row, and a row that stands twice gives its tags twice. Null keywords fit nothing.

    One automaton finds all keywords of a slice of the dictionary in one pass over each text; texts are not shuffled.
    A slice holds whole tags and at most ``slice_bytes`` (a single larger tag is one slice), so the driver never
    holds more than that of a dictionary of any size; more slices mean more passes and the same rows.
    """
    words = keywords.where("tag IS NOT NULL AND keyword IS NOT NULL").select("tag", "keyword")
    total = words.agg(F.sum(F.octet_length("keyword") + 1)).first()[0] or 0
    slices = -(-total // slice_bytes)
    seen = articles.select(
        F.col(id_column), F.lower(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(" "))).alias("_text")
    )
    found = [_tagged(seen, id_column, part) for part in _slices(words, slices)]
    if not found:
        return seen.select(id_column, F.lit(None).cast("string").alias("tag")).where(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _slices(words: DataFrame, slices: int) -> Iterator[dict[str, list[str]]]:
    """The dictionary in ``slices`` parts by hash of the tag, one on the driver at a time."""
    for k in range(slices):
        part: dict[str, list[str]] = {}
        for row in words.where(F.pmod(F.xxhash64("tag"), F.lit(slices)) == k).toLocalIterator():
            part.setdefault(row["tag"], []).append(row["keyword"])
        if part:
            yield part


def _tagged(seen: DataFrame, id_column: str, words: dict[str, list[str]]) -> DataFrame:
    tags_of: dict[str, list[str]] = {}
    for tag in sorted(words):
        for word in dict.fromkeys(words[tag]):
            tags_of.setdefault(word, []).append(tag)
    always = tags_of.pop("", [])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, tags in tags_of.items():
            automaton.add_word(word, tags)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for text in batch["_text"]:
                hits = set(always)
                if tags_of:
                    for _, tags in automaton.iter(text):
                        hits.update(tags)
                found.append(sorted(hits))
            yield pd.DataFrame({"_id": batch[id_column], "tags": found})

    kind = seen.schema[id_column].dataType.simpleString()
    rows = seen.mapInPandas(find, f"_id {kind}, tags array<string>")
    return rows.select(F.col("_id").alias(id_column), F.explode("tags").alias("tag"))


def trending_tags(cards: DataFrame, by: tuple[str, ...] = ("question_id",), threshold: int = 3) -> DataFrame:
    """Sorted tags that occur at least ``threshold`` times over the cards of a group.

    A tag twice in one card counts twice. Groups without such a tag give no row.
    """
    counts = cards.select(*by, F.explode("tags").alias("tag")).groupBy(*by, "tag").count()
    frequent = counts.where(F.col("count") >= threshold)
    return frequent.groupBy(*by).agg(F.array_sort(F.collect_list("tag")).alias("trending"))


def tag_counts(articles: DataFrame) -> DataFrame:
    """Articles per tag."""
    return articles.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_articles"))


def tag_listing(articles: DataFrame) -> DataFrame:
    """The grouping itself as rows ``(tag, article)``: no list has to fit in one task."""
    return articles.select(F.explode("tags").alias("tag"), "article_id", "title")
